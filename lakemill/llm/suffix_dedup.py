"""Removal of every byte covered by a 200-byte string that starts anywhere else, by suffix and common-prefix arrays.

Equal strings meet in one shard: a string's key is the least hash of its 64-byte grams, so runs of neighbouring starts
with one key form an item (its bytes, from the first start to the end of the last string). Keys that occur once in the
whole table cannot hold a repeat. Items of the other keys are made from the texts that have them; equal items are merged
and counted. A key with one distinct item needs no sort: its strings all repeat if it occurs again, and none does if its
gram has one place. The distinct items of the other keys
are dealt to shards by key and sorted by ``induced.suffix_array``, where a string starts again somewhere iff its suffix
shares 200 bytes with a neighbour. A shard may be far larger than the memory given: its text, arrays and queues lie on disk.

Hot keys are cut twice more, so that no key fills a shard however many texts share a passage: one with very many items by
a second, longer gram; one whose distinct items are still large by the whole string, where equal strings are equal items
again and only their digests travel.
Copies of whole texts are settled by digest and take part once.

Edge cases: null text is empty; under 200 bytes nothing is removed; repeated rows are copies of each other; overlapping
repeats within one text count; cuts may fall inside a character, whose remaining bytes the text form drops.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, rows_of, small, whole_text, with_row, written
from .induced import BLOCK, MEMORY, array, spans, suffix_array

LENGTH = 200
GRAM, LONG_GRAM = 64, 128
#: Bits of a gram's place within a window of a long text.
PLACE = 21
#: Occurrences of a key from which its items are cut again.
HOT = 512
#: Bytes of items in a shard at most, about; there are as many shards as shuffle partitions at least.
SHARD = 64 << 20
#: Bytes of a key's distinct items above which it is cut down to single strings.
KEY_BYTES = 8 << 20
#: Rows that a worker holds together.
PART = 256
#: Parts that the items holding one string are dealt into.
PARTS = 256
EMPTY = hashlib.sha256(b"").hexdigest()


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def runs(data, gram: int, length: int = LENGTH):
    """Runs of starts whose strings have the same least gram: (first start, end, key, places of that gram).

    Of equal hashes the leftmost gram counts, so a text that repeats itself has its grams at several places. Hashes are
    compared by their upper bits, with the place below; long texts are taken in windows of ``1 << PLACE`` starts.
    """
    if len(data) < length:
        return (np.empty(0, np.int64),) * 4
    m, h, k = 0x9E3779B97F4A7C15, data.astype(np.uint64) + np.uint64(1), 1
    while k < gram:  # a gram's hash from those of its halves, which may overlap
        step = k if 2 * k <= gram else gram - k
        h, m = h[:-step] * np.uint64(m) + h[step:], (m * m + gram) % (1 << 64)
        k += step
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width, low, places = length - gram + 1, np.uint64((1 << PLACE) - 1), []
    for at in range(0, len(data) - length + 1, 1 << PLACE - 1):
        part = h[at : at + (1 << PLACE - 1) + width - 1]
        v, k = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * k <= width:
            v = np.minimum(v[:-k], v[k:])
            k *= 2
        if k < width:
            v = np.minimum(v[: k - width], v[width - k :])
        places.append((v & low).astype(np.int64) + at)
    place = np.concatenate(places)
    head = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    key = h[place[head]]
    merge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    first = head[merge]
    return first, np.append(first[1:], len(place)), key[merge].view(np.int64), np.diff(merge, append=len(head))


def items_of(text: bytes, keys: dict[int, bool], length: int = LENGTH):
    """(key, first start, bytes, places of the gram) for the runs whose key is wanted; keys maps to whether the key is hot."""
    data = np.frombuffer(text, np.uint8)
    for lo, hi, key, places in zip(*(x.tolist() for x in runs(data, GRAM, length)), strict=True):
        if key not in keys:
            continue
        if not keys[key]:
            yield key, lo, text[lo : hi + length - 1], places
            continue
        for a, b, second, places in zip(*(x.tolist() for x in runs(data[lo : hi + length - 1], LONG_GRAM, length)), strict=True):
            yield key ^ (second * 31 & 0x7FFFFFFFFFFFFFFF), lo + a, text[lo + a : lo + b + length - 1], places


class Shard:
    """Distinct items in scratch files: their text, one after the other with a sign between, and their names and counts."""

    KIND = np.dtype([("name", "S32"), ("size", "<i8"), ("n", "<i8")])

    def __init__(self) -> None:
        self.text, self.records, self.size = tempfile.TemporaryFile(), tempfile.TemporaryFile(), 0

    def add(self, rows: Iterable[tuple[str, bytes, int]]) -> None:
        rows = list(rows)
        for _, x, _ in rows:
            self.text.write(np.append(np.frombuffer(x, np.uint8).astype(np.uint16) + 2, np.uint16(1)).tobytes())
            self.size += len(x) + 1
        self.records.write(np.array([(name, len(x), n) for name, x, n in rows], self.KIND).tobytes())

    def found(self, length: int = LENGTH, memory: int = MEMORY, **how) -> Iterator[tuple[str, list[int]]]:
        """For each item, the starts that begin again anywhere, flat as [from, to, from, to ...]."""
        if not self.size:
            return
        self.text.write(np.zeros(1, np.uint16).tobytes())
        self.text.flush()
        order, shared = suffix_array(np.memmap(self.text, np.uint16, "r", shape=(self.size + 1,)), length, memory, **how)
        hit = array(self.size + 1, np.int8, memory)
        for a, b in spans(len(order)):
            same = a + np.flatnonzero(np.asarray(shared[a:b]) >= length)
            hit[order[same]] = 1
            hit[order[same - 1]] = 1
        del order, shared
        self.records.seek(0)
        at = 0
        while raw_rows := self.records.read(self.KIND.itemsize * 1024):
            for name, size, n in np.frombuffer(raw_rows, self.KIND).tolist():
                mine = np.ones(size - length + 1, np.int8) if n > 1 else hit[at : at + size - length + 1]
                yield name.decode(), np.flatnonzero(np.diff(mine, prepend=0, append=0)).tolist()
                at += size + 1


def repeats(items: list[bytes], counts: list[int], length: int = LENGTH, **how) -> list[list[int]]:
    """For each distinct item, the starts that begin again anywhere, flat as [from, to, from, to ...]."""
    shard = Shard()
    shard.add(("", x, n) for x, n in zip(items, counts, strict=True))
    return [s for _, s in shard.found(length, **how)]


def merged(spans: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Starts [from, to) as maximal runs of covered bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted(zip(spans[::2], spans[1::2], strict=True)):
        end = hi + length - 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def left(text: bytes, spans: list[int]) -> str:
    """What stays of a text; no spans: it is a copy, of which nothing stays unless it is short."""
    covered = merged(spans) if spans else [(0, len(text))] if len(text) >= LENGTH else []
    return without(text, covered).decode("utf-8", "ignore")


def keyed(docs: DataFrame) -> DataFrame:
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), PART):
                b, found = whole.iloc[i : i + PART], []
                texts = [raw(t) for t in b["text"]]
                for t in texts:
                    _, _, key, places = runs(np.frombuffer(t, np.uint8), GRAM)
                    key, which = np.unique(key, return_inverse=True)
                    found.append((key, np.bincount(which, weights=places).astype(np.int32)))
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_bytes": [len(t) for t in texts], "sha": [hashlib.sha256(t).hexdigest() for t in texts], "keys": [k for k, _ in found], "times": [n for _, n in found]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(key, "doc_id long, n_bytes long, sha string, keys array<long>, times array<int>")


def make_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for b in batches:
        for i in range(0, len(b), 64):
            part, rows = b.iloc[i : i + 64], []
            for sha, text, keys, hot in zip(part["sha"], part["text"], part["keys"], part["hot"], strict=True):
                wanted = dict(zip(keys.tolist(), hot.tolist(), strict=True))
                rows += [(sha, lo, key, xxhash.xxh3_128_hexdigest(x), len(x), places, x) for key, lo, x, places in items_of(raw(text), wanted)]
            yield pd.DataFrame(rows, columns=["sha", "start", "key", "item", "size", "places", "bytes"])


def sort_shard(batches: Iterator) -> Iterator:
    """(item, spans) of a shard's items that have any; its rows are streamed to disk."""
    import pyarrow as pa

    shard = Shard()
    for b in batches:
        for i in range(0, len(b), 4 * PART):
            shard.add(zip(*(c.to_pylist() for c in b.slice(i, 4 * PART).select(["item", "bytes", "n"]).columns), strict=True))
    rows = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], ["item", "spans"])

    for name, found in shard.found():
        if found:
            rows.append((name, found))
        if len(rows) == 4 * PART:
            yield batch()
            rows = []
    yield batch()


def single_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal strings of each item: (item, its occurrences, first start, end, digest of the string)."""
    import xxhash

    for b in batches:
        for i in range(0, len(b), 64):
            part, rows = b.iloc[i : i + 64], []
            for item, n, x in zip(part["item"], part["n"].tolist(), part["bytes"], strict=True):
                data = np.frombuffer(x, np.uint8)
                for lo, hi, _, _ in zip(*(v.tolist() for v in runs(data, LENGTH)), strict=True):
                    one = hi - lo == 1 or not (data[lo : hi + LENGTH - 2] != data[lo + 1 : hi + LENGTH - 1]).any()
                    for a, z in [(lo, hi)] if one else [(k, k + 1) for k in range(lo, hi)]:
                        rows.append((item, n, a, z, xxhash.xxh3_128_digest(x[a : a + LENGTH])))
            yield pd.DataFrame(rows, columns=["item", "n", "from", "to", "string"])


def counted_spans(unique: DataFrame) -> DataFrame:
    """(item, spans) as sort_shard has them, for items of keys that are cut down to single strings."""
    each = unique.select("item", "n", "bytes").mapInPandas(single_strings, "item string, n long, from long, to long, string binary")
    # A string that very many items hold is dealt by part, so that its rows never meet in one task.
    each = written(each.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))), "single_strings")
    counts = each.groupBy("string", "part").agg(F.sum(F.col("n") * (F.col("to") - F.col("from"))).alias("times"))
    often = counts.groupBy("string").agg(F.sum("times").alias("times")).where("times > 1").select("string")
    often = counts.select("string", "part").join(often, "string")
    found = each.join(often, ["string", "part"]).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    return found.select("item", F.flatten(F.transform("runs", lambda r: F.array(r["from"], r["to"]))).alias("spans"))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_bytes, sha) of every row; (sha, copies) of every text; (sha, text, spans of starts) of single texts with repeats."""
    spark = docs.sparkSession
    rows = written(keyed(docs), "text_keys")
    # Keys travel with a 60-bit stand-in for the text: two texts that share one would only get some keys too many.
    text_id = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("text_id")
    each = rows.groupBy("sha").agg(F.first("keys").alias("keys"), F.first("times").alias("times"))
    each = each.select(text_id, F.explode(F.arrays_zip("keys", "times")).alias("k")).select("text_id", F.col("k.keys").alias("key"), F.col("k.times").alias("times"))
    often = each.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key", (F.col("n") >= HOT).alias("hot"))
    wanted = each.select("text_id", "key").join(often, "key").groupBy("text_id").agg(F.collect_list("key").alias("keys"), F.collect_list("hot").alias("hot"))  # a text's own keys
    texts = written(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")), "texts")
    wanted = written(wanted.join(texts.select(text_id, "sha", "first", "copies"), "text_id").drop("text_id"), "wanted_keys").withColumnRenamed("sha", "wanted_sha")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = F.col("doc_id").eqNullSafe(F.col("first")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("wanted_sha"))
    body = written(body.join(wanted.hint("shuffle_hash"), found).select(F.col("wanted_sha").alias("sha"), "text", "keys", "hot", "copies"), "candidates")

    items = written(body.select("sha", "text", "keys", "hot").mapInPandas(make_items, "sha string, start long, key long, item string, size long, places long, bytes binary"), "items")
    # Repeated rows of one id were read again above: they are copies, which need no spans of their own.
    each = items.groupBy("item").agg(F.first("key").alias("key"), F.first("size").alias("size"), F.first("places").alias("places"), F.count(F.lit(1)).alias("n"))
    keys = each.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("items"), F.max("n").alias("n"), F.max("places").alias("places"), F.first("item").alias("item"))
    # A string that begins twice within one item has its gram at two places.
    alone = (F.col("items") == 1) & ((F.col("n") > 1) | (F.col("places") == 1))
    keys = written(keys.withColumn("equal", alone), "item_keys")
    equal = keys.where("equal and n > 1").select("item", F.array(F.lit(0).cast("long"), F.col("size") - LENGTH + 1).alias("spans"))
    large = written(keys.where(~F.col("equal") & (F.col("size") > KEY_BYTES)).select("key"), "large_keys")
    total = keys.where(~F.col("equal") & (F.col("size") <= KEY_BYTES)).agg(F.sum("size")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    unique = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("bytes").alias("bytes"))
    some = large.limit(1).count() > 0
    light = unique.join(keys.where("equal").select("item"), "item", "left_anti")
    light = light.join(small(large), "key", "left_anti") if some else light
    found = light.repartition(shards, "key").select("item", "n", "bytes").mapInArrow(sort_shard, "item string, spans array<long>").unionByName(equal)
    if some:
        of_large = items.join(small(large), "key", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"))
        found = found.unionByName(counted_spans(of_large))
    sorted_ = written(found, "item_spans")
    at = items.select("sha", "start", "item").join(sorted_, "item")
    spans = at.select("sha", F.transform("spans", lambda x: x + F.col("start")).alias("spans")).groupBy("sha").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    single = body.where("copies = 1").select("sha", "text").join(spans, "sha")
    return rows.select("doc_id", "n_bytes", "sha"), texts.select("sha", "copies"), single


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row."""
    rows, texts, single = repeated_spans(docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sha, text, spans in zip(b["sha"], b["text"], b["spans"], strict=True):
                covered = merged(spans.tolist())
                out.append((sha, sum(y - x for x, y in covered), len(covered), hashlib.sha256(without(raw(text), covered)).hexdigest()))
            yield pd.DataFrame(out, columns=["sha", "n_removed", "n_spans", "kept_sha256"])

    done = written(single.mapInPandas(cut, "sha string, n_removed long, n_spans long, kept_sha256 string"), "cut_texts")
    whole = texts.where("copies > 1").select("sha", F.lit(True).alias("copied"))
    known = written(done.join(whole, "sha", "full"), "text_results")
    out = rows.join(known, "sha", "left")
    gone = F.coalesce(F.col("copied"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    pick = lambda a, b, c: F.when(gone, a).otherwise(F.coalesce(b, c))
    return out.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0)).alias("n_removed"),
        pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"), pick(F.lit(EMPTY), "kept_sha256", "sha").alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text, and n_chars, if there, counted anew."""
    rows, texts, single = repeated_spans(docs)
    named = texts.where("copies > 1").select("sha", F.array().cast("array<long>").alias("spans")).unionByName(single.select("sha", "spans"))
    # What is cut goes to a text by its id too: copies are spread over as many tasks as their ids.
    named = rows.select("doc_id", "sha").join(written(named, "cut_spans"), "sha").groupBy("doc_id", "sha").agg(F.first("spans").alias("spans"))
    named = written(named, "cut_rows").withColumnRenamed("sha", "cut_sha").withColumnRenamed("doc_id", "cut_id")
    own = with_row(docs, F.col("doc_id").cast("long").alias("id"), F.sha2(whole_text().cast("binary"), 256).alias("sha"))
    joined = own.join(named.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("sha") == F.col("cut_sha")), "left")

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else left(raw(t), s.tolist()) for t, s in zip(text, spans, strict=True)])

    text = F.col(f"{ROW}.text")
    out = joined.withColumn("cut", kept(text, "spans")).withColumn(ROW, F.col(ROW).withField("text", F.col("cut")))
    if "n_chars" in docs.columns:
        out = out.withColumn(ROW, F.col(ROW).withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType)))
    return rows_of(out)
