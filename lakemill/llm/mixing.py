"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the documents over its actual share. Each document draws a uniform number from
the digest of seed and id and inverts the Poisson distribution with its source's rate as mean; it is exploded by the
count it gets, and copies are dealt and sorted by another digest. The draw depends on nothing else, so a lost executor
repeats it exactly.

Edge cases: a null source is a source of its own; sources without a target keep ``rest`` as their weight; a target for a
source that has no documents is left out and the other weights are scaled up; null doc_id and repeated rows draw alike;
empty table: no rows. A rate above ``MAX_RATE`` is split over several draws, whose Poisson counts add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, rows_of, small, with_row, written

SEED = "mix-1"
#: Inverting sums up to this many terms; the tail beyond is below any double for rates up to MAX_RATE.
MAX_RATE, TERMS = 100.0, 300
#: Share of the result that each named source should have; the others share what is left in proportion to ``REST``.
TARGETS = {"src0": 0.15}
REST = 1.0


def uniform(seed: str, *columns: Column) -> Column:
    """In [0, 1): 52 bits of a digest."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, rate: Column) -> Column:
    """The least k with P(Poisson(rate) <= k) > u."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.lit(0).cast("long").alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * rate / i
        more = F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), i.cast("long").alias("k"))
        return F.when(a["sum"] > u, a).otherwise(more)

    terms = F.sequence(F.lit(1), F.least(F.lit(TERMS), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")))
    return F.aggregate(terms, start, step, lambda a: a["k"])


def copies(seed: str, rate: Column) -> Column:
    """A document's count: one draw of mean at most MAX_RATE, or the sum of as many as the rate takes."""
    draws = F.greatest(F.lit(1), F.ceil(rate / MAX_RATE)).cast("int")
    more = lambda a, i: a + poisson(uniform(seed + "-more", F.col("doc_id"), i), rate / draws)
    rest = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), draws)), F.lit(0).cast("long"), more)
    return poisson(uniform(seed, F.col("doc_id")), rate / draws) + F.when(draws > 1, rest).otherwise(F.lit(0).cast("long"))


def rates(docs: DataFrame, targets: dict[str, float], rest: float = REST) -> DataFrame:
    """(source, rate): one row per source."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("source").isin(*targets) & F.col("source").isNotNull() if targets else F.lit(False)
    pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
    weight = F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None).cast("double")
    counts = counts.select("source", "n", F.coalesce(named, F.lit(False)).alias("named"), weight.alias("target"))
    counts = written(counts, "source_counts")
    sums = counts.agg(F.sum("n"), F.sum(F.when(F.col("named"), F.col("target"))), F.sum(F.when(~F.col("named"), F.col("n")))).first()
    total, given, others = float(sums[0] or 0), sums[1] or 0.0, float(sums[2] or 0)
    left = max(0.0, 1 - given) * rest
    whole = given + (left if others else 0.0)
    share = F.when(F.col("named"), F.col("target")).otherwise(left * F.col("n") / (others or 1.0)) / F.lit(whole or 1.0)
    rate = share * total / F.col("n")
    return counts.select("source", rate.cast("double").alias("rate"))


def replicated(docs: DataFrame, targets: dict[str, float] = TARGETS, seed: str = SEED) -> DataFrame:
    """doc_id, source, rate, copies, copy and the row itself: a row per copy, not yet shuffled."""
    found = small(written(rates(docs, targets).withColumnRenamed("source", "of"), "rates"))
    df = with_row(docs, "doc_id", "source").join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    df = df.withColumn("copies", copies(seed, F.col("rate"))).where("copies > 0")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


def shuffled(df: DataFrame, seed: str = SEED) -> DataFrame:
    """Deal the copies by a digest and sort each partition by it: a global shuffle that can be repeated. Dealing by hash reads
    the input once; by range it would be sampled first."""
    place = df.withColumn("place", uniform(seed + "-shuffle", F.col("doc_id"), F.col("copy")))
    return place.repartition("place").sortWithinPartitions("place")


def mixing(docs: DataFrame, targets: dict[str, float] = TARGETS, seed: str = SEED) -> DataFrame:
    """doc_id, source, copy, copies, rate, place: one row per copy in shuffled order."""
    df = shuffled(replicated(docs.select("doc_id", "source"), targets, seed).drop(ROW), seed)
    return df.select("doc_id", "source", "copy", "copies", "rate", "place")


def mixed_documents(docs: DataFrame, targets: dict[str, float] = TARGETS, seed: str = SEED) -> DataFrame:
    """The copies as rows with the columns of ``docs``, dealt by digest."""
    return rows_of(shuffled(replicated(docs, targets, seed), seed))
