"""Language identification by the nearest of several centroids per language.

TF-IDF vectors of letter n-grams from a bounded sample of each language are clustered (spherical k-means); a document
gets the language of the centroid with the greatest cosine. A document further from its centroid than nearly all learned
texts is flagged as rejected.

Edge cases: null text, or text without a letter, is ``und`` with score 0; a language with fewer texts than clusters has a
centroid per text; nothing to learn from: every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .features import bounded_sample, collected, inverse_frequency, letters, weighted

#: Texts that are learned from, of each language at most.
PER_LANGUAGE = 400
CENTROIDS, ROUNDS = 4, 12
#: Share of learned texts, of 40 letters or more, that may be further from their centroid than the rejection distance.
REJECTED = 0.002
BLOCK = 512


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids; starts are chosen far from each other."""
    starts = [0]
    while len(starts) < min(k, len(x)):
        starts.append(int((x @ x[starts].T).max(axis=1).argmin()))
    c = x[starts].copy()
    for _ in range(ROUNDS):
        nearest = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (nearest == i).any():
                c[i] = x[nearest == i].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labels: list[str], counts: np.ndarray, centroids: int = CENTROIDS) -> dict:
    names, which = np.unique(np.array(labels), return_inverse=True)
    idf = inverse_frequency(counts)
    x = weighted(counts, idf)
    each = [cluster(x[which == i], centroids) for i in range(len(names))]
    c = np.concatenate(each)
    near = (x @ c.T).max(axis=1)[counts.sum(axis=1) >= 40]
    return {"idf": idf, "names": names.tolist(), "centroids": c, "of": np.repeat(np.arange(len(names)), [len(e) for e in each]), "least": float(np.quantile(near, REJECTED)) if len(near) else 0.0}


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per input row."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", F.col("lang").alias("label"))
    found = collected(bounded_sample(rows, docs, per_language), letters)
    model = docs.sparkSession.sparkContext.broadcast(fit(*found) if found[0] else None)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at : at + BLOCK]
                known = np.array([m is not None and has_letter(t) for t in part["text"]], bool)
                name, score = np.array(["und"] * len(part), object), np.zeros(len(part))
                if known.any():
                    cosine = weighted(np.stack([letters(t) for t in part["text"][known]]), m["idf"]) @ m["centroids"].T
                    best = cosine.argmax(axis=1)
                    name[known] = [m["names"][m["of"][i]] for i in best]
                    score[known] = cosine.max(axis=1).clip(0, 1)
                rejected = ~known | (score < (m["least"] if m else 1))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "lang_pred": name, "score": score, "rejected": rejected})

    df = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return df.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
