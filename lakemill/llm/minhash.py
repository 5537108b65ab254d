"""Near-duplicates by circulant MinHash, banding and exact Jaccard checks.

Coordinate k of a signature is the minimum over a document's shingles x of pi((sigma(x) + k) mod 2^32): one permutation
sigma applied once, and one permutation pi that is only shifted. 48 bands of 5 coordinates miss a pair at 0.75 with a
probability of about two in a million. Texts with equal shingle sets form one class first, so copies never make pairs.

Pairs are checked in rounds on whole shingle sets: each class against the bucket minimum that it meets most often; against
its other bucket minima; in buckets that still hold several components, against the set with the fewest shingles of its
own; last, what is outside a bucket's largest component against all of the bucket. A pair within one component can't
change the result, and a pair that lone shingles or bitmaps of the sets rule out is no link, so no link is lost.

Edge cases: null, empty or blank text has no shingles and stays alone; under five words the whole sequence is one
shingle; rows that share a doc_id are one document, whose texts' components are joined, but ``kept_documents`` decides on
each of its texts; a null doc_id never represents a component that has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, whole_text, with_row, written
from .graph import components, roots
from .words import mix, slices, words

WORDS = 5
PERCENT = 75
BANDS, ROWS = 48, 5
#: Bits of a set's bitmap, a power of two.
BITS = 1024
#: Rows whose sets a worker holds together.
PART = 256
#: Nodes from here on stand for documents without an id.
NO_ID = 1 << 62
SIGNED = "doc_id long, n_shingles long, set_key string, bands array<long>"


class Shingler:
    """Texts -> their distinct shingles as sorted unsigned 64-bit hashes."""

    def __init__(self, words: int = WORDS) -> None:
        self.n = words
        self.weights = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def sets(self, column) -> Iterator[np.ndarray]:
        """One array per row of an Arrow string column without nulls."""
        for data, offsets in slices(column):
            _, _, h, first = words(data, offsets)
            out = self.hashed(h, self.n) if len(h) >= self.n else h[:0]
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                few = 0 < hi - lo < self.n
                found = np.sort(self.hashed(h[lo:hi], hi - lo) if few else out[lo : max(lo, hi - self.n + 1)])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found

    def hashed(self, h: np.ndarray, m: int) -> np.ndarray:
        """Hashes of all runs of m words."""
        out = np.full(len(h) - m + 1, m, dtype=np.uint64)
        for j in range(m):
            out += h[j : len(h) - m + 1 + j] * self.weights[j]
        return mix(out)

    def __call__(self, text: str | None) -> np.ndarray:
        import pyarrow as pa

        return next(self.sets(pa.array([text or ""])))


class Circulant:
    """shingles -> one 64-bit key per band."""

    WIDTH = 1024

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a, self.b = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
        self.shift = (np.arange(k, dtype=np.uint32) * self.a)[:, None]  # pi starts with a product, so the shift is added after it
        self.z, self.t = np.empty((k, self.WIDTH), np.uint32), np.empty((k, self.WIDTH), np.uint32)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.weights = mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xDA942042E4DD58B5)) | np.uint64(1)

    def signature(self, shingles):
        sigma = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
        y, best = sigma * self.a, None
        for at in range(0, len(y), self.WIDTH):
            part = y[at : at + self.WIDTH]
            z, t = self.z[:, : len(part)], self.t[:, : len(part)]
            np.add(part, self.shift, out=z)
            np.right_shift(z, 15, out=t)
            np.bitwise_xor(z, t, out=z)
            np.multiply(z, self.b, out=z)
            least = z.min(axis=1)
            best = least if best is None else np.minimum(best, least)
        return best

    def __call__(self, shingles):
        if not len(shingles):
            return np.empty(0, dtype=np.int64)
        s = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        return mix((s * self.weights).sum(axis=1, dtype=np.uint64) ^ self.salt).view(np.int64)


def set_key(shingles) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(shingles.tobytes())


def signed(docs: DataFrame) -> DataFrame:
    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler, circulant = Shingler(), Circulant()
        for b in batches:
            for ids, sets in parts(b.column(0), shingler.sets(b.column(1))):
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets]), lists([circulant(s) for s in sets])], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, SIGNED)


def parts(column, found: Iterator, n: int = PART) -> Iterator[tuple]:
    """A column and what was found for its rows, n rows at a time: no batch's sets are held together."""
    for at in range(0, len(column), n):
        yield column.slice(at, n), list(islice(found, n))


def lists(arrays: list[np.ndarray]):
    """Arrow lists of 64-bit numbers."""
    import pyarrow as pa

    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *(a.view(np.int64) for a in arrays)])))


def bitmap(shingles):
    """BITS bits, set where a shingle falls, as signed 64-bit words. A bit that only one of two sets has is a shingle the
    other lacks, which bounds what they share from above."""
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler()
        for b in batches:
            for _, found in parts(b.column(0), shingler.sets(b.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found]), lists(found), lists([bitmap(s) for s in found])], ["set_key", "shingles", "bits"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sets, "set_key string, shingles array<long>, bits array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b), with their columns, whose whole sets are alike enough; a pair may come twice. Nothing above the joins
    needs a key's rows together, so the partition of a set that many others are compared with can be split."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").where(alike).select(*pairs.columns)


def bits_allow(x: str, y: str, percent: int) -> Column:
    """What two sets of ``n`` shingles can share at most by their bitmaps is enough for a link; true where a bitmap is missing.

    A shared bit is counted once for both sides, and the sum stands here once: a join whose generated method has more than
    8000 bytes is never compiled and takes some fifty times as long a pair."""
    shared = sum((F.bit_count(F.get(f"{x}.bits", F.lit(i)).bitwiseAND(F.get(f"{y}.bits", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    most = shared + F.least(F.col(f"{x}.n") - F.col(f"{x}.ones"), F.col(f"{y}.n") - F.col(f"{y}.ones"))
    return F.coalesce((100 + percent) * most >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n")), F.lit(True))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links (a, b) between them: only the links are searched, and their components looked up."""
    top = components(links).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return written(found.join(top, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")


def still_open(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The entries, with their component c, of buckets that hold more than one."""
    placed = entries.drop("c").join(found.select("node", F.col("component").alias("c")), "node")
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    return placed.join(mixed, "bucket", "left_semi")


def last_rounds(entries: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The components with the pairs of open buckets that may still be links."""
    # Shingles that no other open set has bound what a set can share; many sets can then have no partner at all.
    body = sets.join(entries.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    lone = body.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("k")).where("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    entries = entries.join(lone, "node", "left").withColumn("common", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
    # An id with several texts has several sets, for which no bound is kept.
    own_bits = sets.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.first("bits").alias("bits"))
    own_bits = own_bits.withColumn("ones", sum((F.bit_count(F.get("bits", F.lit(i))) for i in range(BITS // 64)), F.lit(0)))
    entries = entries.join(own_bits, "node").withColumn("bits", F.when(F.col("k") == 1, F.col("bits"))).withColumn("common", F.when(F.col("k") == 1, F.col("common")).otherwise(F.col("n"))).drop("k")
    entries = written(entries.where(100 * F.col("common") >= percent * F.col("n")), "open_buckets")

    def possible() -> Column:
        enough = (100 + percent) * F.least("x.common", "y.common") >= percent * (F.col("x.n") + F.col("y.n"))
        return (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") != F.col("y.c")) & enough & bits_allow("x", "y", percent)

    def joined(pairs: DataFrame) -> DataFrame:
        """Links between components; the pairs x, y are checked once each."""
        pairs = pairs.select(*(f(f"x.{c}", f"y.{c}").alias(f"{c}{i}") for c in ("node", "c") for i, f in enumerate((F.least, F.greatest)))).distinct()
        return verified(pairs.withColumnsRenamed({"node0": "a", "node1": "b"}), sets, percent).select(F.col("c0").alias("a"), F.col("c1").alias("b"))

    # The set of a bucket with the fewest lone shingles is nearest to what the bucket's sets have in common.
    middle = entries.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "c", "common", "bits", "ones"), F.struct(F.col("common") / F.col("n"), -F.col("node"))).alias("m")).select("bucket", "m.*")
    middle = written(middle, "middles")  # so that the join has plain exchanges below it, and a hot bucket's partition can be split
    found = merged(found, joined(entries.alias("x").join(middle.alias("y"), possible())))

    # What is left of a bucket beside its largest component is compared with all of the bucket.
    entries = written(still_open(entries, found), "open_buckets")
    largest = entries.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("most"))
    rest = written(entries.join(written(largest, "largest"), "bucket").where("c <> most").drop("most"), "rest_of_buckets")
    return merged(found, joined(rest.alias("x").join(entries.alias("y"), possible())))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    sig = written(signed(docs), "signatures")
    first = sig.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    no_id = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("set_key"), 3)
    classes = written(first.withColumn("node", F.coalesce("first", no_id)), "classes")
    nodes = classes.select("set_key", "node", "first")

    entries = classes.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").drop("last")
    shared = written(entries.join(buckets, "bucket"), "buckets")

    fetch = shared.select("node").distinct()
    wanted = nodes.join(fetch, "node", "left_semi")
    ids = wanted.select(F.col("first").alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = shingle_sets(texts).groupBy("set_key").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits"))
    sets = written(sets.join(wanted.select("set_key", "node"), "set_key").select("node", "shingles", "bits"), "shingle_sets")

    # A node has a spoke for each other node that is the least of one of its buckets; the first spoke is met most often.
    spokes = shared.where("node <> center").repartition("node").groupBy("node", "center").agg(F.count(F.lit(1)).alias("bands"))
    spokes = written(spokes.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("bands"), "center"))).drop("bands"), "spokes")
    pairs = spokes.where("place = 1").select(F.col("center").alias("a"), F.col("node").alias("b"))
    tops = roots(written(verified(pairs, sets, percent).select(F.col("b").alias("node"), F.col("a").alias("parent")).distinct(), "parents"))
    found = written(sets.select("node").distinct().join(tops, "node", "left").select("node", F.coalesce("parent", "node").alias("component")), "components")

    of = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(name + "_component"))
    rest = spokes.where("place > 1").join(of("node"), "node").join(of("center"), "center").where("node_component <> center_component")
    rest = verified(rest.withColumnsRenamed({"center": "a", "node": "b"}), sets, percent)
    found = merged(found, rest.select(F.col("center_component").alias("a"), F.col("node_component").alias("b")))

    entries = written(still_open(shared.select("bucket", "node", "n"), found), "open_buckets")
    if entries.limit(1).count():
        found = last_rounds(entries, sets, found, percent)
    mine = nodes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))

    # An id with several texts links their classes.
    several = sig.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo < hi").select("doc_id")
    if several.limit(1).count():
        mine = written(mine, "places")
        own = sig.join(several, "doc_id", "left_semi").select("doc_id", "set_key").join(mine, "set_key").select("doc_id", "component").distinct()
        least = own.groupBy("doc_id").agg(F.min("component").alias("a"))
        mine = merged(mine.withColumnRenamed("set_key", "node"), own.join(least, "doc_id").select("a", F.col("component").alias("b"))).withColumnRenamed("node", "set_key")

    out = sig.select("doc_id", "n_shingles", "set_key").join(mine, "set_key", "left")
    component = F.when(F.col("component") >= NO_ID, F.lit(None)).otherwise(F.coalesce("component", "doc_id")).cast("long")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with their columns: one of each component. Rows without an id all stay unless their texts are equal.

    Of an id with several texts each text is decided on alone: all but one get a stand-in for the id, above all ids.
    """
    rows = with_row(docs, F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    repeated = rows.groupBy("id").count().where("count > 1").limit(1).count()
    if not repeated:
        kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
        return rows_of(rows.drop("text").join(kept.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("kept_id")), "left_semi"))
    own = rows.withColumn("text_key", F.sha2(F.col("text").cast("binary"), 256))
    first = own.where("id is not null").groupBy(F.col("id").alias("of")).agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"))
    first = written(first.where("lo < hi").select("of", "lo"), "ids_with_texts")
    stand_in = F.lit(NO_ID >> 1) + F.shiftrightunsigned(F.xxhash64("id", "text_key"), 3)
    own = own.join(first, F.col("id") == F.col("of"), "left").withColumn("row_id", F.when(F.col("text_key") != F.col("lo"), stand_in).otherwise(F.col("id")))
    own = written(own.drop("of", "lo", "id"), "rows_by_text")
    kept = near_duplicates(own.select(F.col("row_id").alias("doc_id"), "text"), percent).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    out = own.join(kept.hint("shuffle_hash"), F.col("row_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return rows_of(out.dropDuplicates(["row_id", "text_key"]))
