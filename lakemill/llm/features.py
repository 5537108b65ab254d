"""Hashed byte n-grams of whole texts, as term counts, and bounded labelled samples to fit models on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, written

#: Terms of a vector; fixed, so every vector and model is bounded.
TERMS = 4096
#: The last terms of a style vector count bytes in repeated grams and repeated lines.
EXTRA = 2
#: Rows of a sample: 16 KB of counts each go to the driver.
SAMPLE = 8000


def raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def grams(data: np.ndarray, n: int, salt: int, terms: int) -> np.ndarray:
    """Counts of all n-grams, hashed to ``terms`` (a power of two); blocks bound the memory of very long texts."""
    out, bits = np.zeros(terms, np.float32), terms.bit_length() - 1
    for at in range(0, max(0, len(data) - n + 1), 1 << 20):
        part = data[at : at + (1 << 20) + n - 1].astype(np.uint32)
        h = np.full(len(part) - n + 1, salt, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + part[j : len(part) - n + 1 + j] + np.uint32(1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out += np.bincount(h >> np.uint32(32 - bits), minlength=terms)
    return out


def letters(text: str | None) -> np.ndarray:
    """Byte 3- and 2-grams of the lower-cased words, set apart by one blank: what tells languages apart."""
    data = raw((text or "").lower())
    data = np.where(((data >= 97) & (data < 123)) | (data >= 128), data, 32).astype(np.uint8)
    if len(data):
        data = data[np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))]
    return np.concatenate((grams(data, 3, 7, TERMS // 2), grams(data, 2, 11, TERMS // 2)))


def kinds() -> np.ndarray:
    """Byte -> kind: letters, capitals, digits, blanks, line ends, bytes over 127; other ASCII as itself."""
    kind = np.arange(256, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[[9, 11, 12, 13, 32]], kind[10], kind[128:] = 1, 2, 3, 4, 5, 1
    return kind


KINDS = kinds()


def style(text: str | None) -> np.ndarray:
    """3- and 2-grams of character kinds, and what is repeated: what tells prose from junk."""
    data = raw(text)
    kind = KINDS[data]
    out = np.concatenate((grams(kind, 3, 5, TERMS // 2), grams(kind, 2, 13, TERMS // 2)))
    lines = (text or "").split("\n")
    repeated = 0
    if len(data) >= 16:
        h = data.astype(np.uint64)
        for k in (1, 2, 4, 8):
            h = h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[k:]
        h = np.sort(h)
        repeated = int((h[1:] == h[:-1]).sum())
    out[-EXTRA:] = repeated, sum(map(len, lines)) - sum(map(len, set(lines)))
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows; tf is the root of a term's share of the text. Rows without terms stay zero."""
    share = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * idf
    return (share / np.maximum(np.linalg.norm(share, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def inverse_frequency(counts: np.ndarray) -> np.ndarray:
    return np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1


def bounded_sample(rows: DataFrame, docs: DataFrame, per_label: int) -> DataFrame:
    """(label, text) of at most ``per_label`` rows of each label, those with the least digest of doc_id. rows: doc_id, label.
    With many labels fewer rows of each are taken, but one at least, so that about ``SAMPLE`` rows are in it at most.

    Only ids are ranked, and of a frequent label only those whose digest can be among the least: about twice as many rows
    as are kept. The ids chosen are written and broadcast if they are few, so that no text is shuffled.
    """
    counts = written(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label_counts")
    per_label = max(1, min(per_label, SAMPLE // max(1, counts.count())))
    counts = small(counts).withColumnRenamed("label", "counted")
    digest = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))
    low = rows.withColumn("digest", digest).join(counts, F.col("label") == F.col("counted")).where(F.col("digest").cast("double") * F.col("n") < (2 * per_label + 50) * float(1 << 52)).dropDuplicates(["label", "doc_id"])
    best = W.partitionBy("label").orderBy("digest", "doc_id")
    ids = low.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_label).select(F.col("doc_id").alias("sample_id"), "label")
    ids = small(written(ids, "sample_ids"))
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("sample_id")).dropDuplicates(["label", "doc_id"])
    return found.select("label", "text")


def collected(sample: DataFrame, features):
    """(labels, counts) of a bounded sample; counts are made on the executors."""
    import pandas as pd

    def count(batches):
        for b in batches:
            yield pd.DataFrame({"label": b["label"].astype(str), "counts": [features(t).astype(np.float32).tobytes() for t in b["text"]]})

    rows = sample.mapInPandas(count, "label string, counts binary").toPandas()
    rows = rows.sort_values(["label", "counts"], kind="stable")
    if not len(rows):
        return [], np.zeros((0, TERMS), np.float32)
    return list(rows["label"]), np.stack([np.frombuffer(x, np.float32) for x in rows["counts"]])
