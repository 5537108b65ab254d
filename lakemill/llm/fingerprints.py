"""Document fingerprints as invertible Bloom lookup sketches (DataFrame functions only).

A paragraph is a line, cut every 120 characters; an element of a version is a paragraph's digest with the number of times
it occurs. A sketch has three lanes of cells, and each element goes to one cell of every lane; a cell holds a count, the xor
of its paragraph digests, of their numbers, and of check digests. Widths form a ladder of powers of two, and a place in a
narrow sketch is that in a wide one modulo its width, so a wide sketch folds into every narrower one.

A version's fingerprint is its sketch at the lowest rung, of 12 cells. Two versions are compared by their sketches: cells
are subtracted, then lanes are peeled in turn: a cell left with one element gives it away, and it is taken out of its other
cells. What is recovered are the differing paragraphs' digests. The fingerprints' difference is tried first; where it can't
be peeled empty, that of the rung which the numbers of elements call for; then, as long as it fails, that of twice the width.

Each lane holds an element once, so peeling lane by lane never takes one out twice, and a round is a single aggregation of
the cells and what is taken out of them. All rounds of a pair run where its cells lie: rows are dealt once. Pairs that are
tried again are written apart, so a try reads no others, and one of few elements is a single task's work.

Edge cases: null text is empty; two empty versions are alike (1.0) and have empty fingerprints; the document after the last
is the first, so a single row follows itself; rows with one doc_id are ordered by the digest of their text, which also
parts a hot id; null ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, written

PARAGRAPH = r"[^\n]{1,120}"
LANES = 3
#: Cells of a lane in the fingerprint, the lowest rung.
CELLS = 4
#: Cells for each difference that is expected, on the rung that is tried second.
SPACE = 1.5
ROUNDS = 12
#: A row's number, from its bucket and its place there.
ROW = "cast(bucket as bigint) * 4294967296 + place"
#: Elements of the texts themselves in a partition of cells, about, and of both sides in a further try that is one task.
PART = 50_000
#: Whether partial aggregates keep a second, generated map.
FAST_MAPS = "spark.sql.codegen.aggregate.map.twolevel.enabled"
ATTEMPTS = 40
#: Rows per bucket of neighbouring ids, and buckets.
BUCKET, BUCKETS = 2000, 1 << 16
#: A lane's number stands above this many bits of a cell's place; recovered elements lie beyond the lanes.
LANE, FOUND = 40, 8
#: Rungs of cells, and the fingerprints of a pair's two versions beside them.
LOW, HIGH, OWN, OTHER = 0, 1, 2, 3
#: Share of the elements of both versions that is expected to differ: half a text is edited, the next one is another text.
KINDS = (("edited", 0.55), ("next", 1.0))


def bucketed(df: DataFrame) -> DataFrame:
    """``df`` (key) with bucket: a range of keys with about BUCKET rows. Bounds are the first keys of range partitions, written
    as a table of a row for each of at most 256 groups; a key's group is found first, and joined by broadcast."""
    keys = written(df.select("key"), "text_ids")
    n = max(1, min(BUCKETS, keys.count() // BUCKET))
    if n == 1:
        return df.withColumn("bucket", F.lit(0))
    step = max(1, int(n**0.5))
    bounds = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first"))
    bounds = bounds.agg(F.sort_array(F.collect_list("first")).alias("all"))  # BUCKETS keys at most
    groups = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(step)), lambda i: F.slice("all", i + 1, step))
    bounds = written(bounds.select(F.posexplode(groups).alias("group", "bounds")), "bounds")
    first = [r[0] for r in bounds.orderBy("group").select(F.col("bounds")[0]).collect()]
    first = F.array(*(F.struct(F.lit(k["doc_id"]).cast("long").alias("doc_id"), F.lit(k["digest"]).cast("long").alias("digest")) for k in first))
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("key")))
    df = df.withColumn("group", F.greatest(upto(first) - 1, F.lit(0))).join(F.broadcast(bounds), "group")
    return df.withColumn("bucket", F.col("group") * step + upto(F.col("bounds"))).drop("group", "bounds")


def paragraphs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))


def versions(docs: DataFrame) -> DataFrame:
    """bucket, place, doc_id, n_chars, edited_sha256 and the paragraph digests of the text, its edited form and the next text."""
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    df = bucketed(df.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("digest"))))
    heads = written(df.groupBy("bucket").agg(F.min("key").alias("head")), "bucket_heads")  # BUCKETS rows at most
    order = W.orderBy("bucket")
    first = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = heads.select(F.col("bucket").alias("of"), F.coalesce(F.lead("head").over(order), F.first("head").over(first)).alias("head"))
    heads = df.join(F.broadcast(written(after, "bucket_order")), F.col("key") == F.col("head")).select("of", F.col("text").alias("head_text")).dropDuplicates(["of"])
    heads = written(heads, "head_texts")

    within = W.partitionBy("bucket").orderBy("key")
    df = df.withColumns({"place": F.row_number().over(within), "next": F.lead("text").over(within)})
    df = df.join(heads, F.col("bucket") == F.col("of"), "left").withColumn("next", F.coalesce("next", "head_text"))
    half = F.floor(F.length("text") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)))
    return df.select(
        "bucket", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("edited"), paragraphs(F.col("next")).alias("next"),
    )


def starts(digests: str) -> Column:
    """Where each distinct digest begins in a sorted array."""
    return F.filter(F.transform(digests, lambda h, i: F.when((i == 0) | (h != F.get(digests, i - 1)), i)), lambda i: i.isNotNull())


def elements(digests: str, at: str) -> Column:
    """An element per distinct digest: d, the digest, and t, how often it occurs."""
    return F.transform(at, lambda i, j: F.struct(F.get(digests, i).alias("d"), (F.coalesce(F.get(at, j + 1), F.size(digests)) - i).cast("long").alias("t")))


def with_elements(rows: DataFrame, names: tuple[str, ...] = ("own", "edited", "next")) -> DataFrame:
    """``rows`` with arrays of paragraph digests turned into arrays of distinct elements."""
    df = rows.withColumns({n: F.sort_array(n) for n in names})
    df = df.withColumns({n + "_at": starts(n) for n in names})
    return df.withColumns({n: elements(n, n + "_at") for n in names}).drop(*(n + "_at" for n in names))


def check(d: Column, t: Column) -> Column:
    return F.xxhash64(d, t, F.lit(-1))


def cell(d: Column, t: Column, lane: int, width: Column) -> Column:
    """Place in all lanes: the lane's number above its cells. Widths are powers of two, so places fold."""
    return F.pmod(F.xxhash64(d, t, F.lit(lane)), width) + F.lit(lane << LANE)


def folded(at: Column, width: int) -> Column:
    mask = (1 << LANE) - 1
    return at.bitwiseAND(F.lit(~mask)) + at.bitwiseAND(F.lit(mask)) % width


def put(d: Column, t: Column, count: Column, width: Column, *more: Column) -> list[Column]:
    """What an element adds to (or, again, takes out of) its cells."""
    return [F.struct(*more, cell(d, t, j, width).alias("at"), count.cast("long").alias("count"), d.alias("keys"), t.alias("times"), check(d, t).alias("checks")) for j in range(LANES)]


def summed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("count").alias("count"), *(F.bit_xor(x).alias(x) for x in ("keys", "times", "checks")))


def sketches(versions: DataFrame, *by: str) -> DataFrame:
    """The cells (at, count, keys, times, checks) of each version's sketch. versions: ``by``, width, elements."""
    each = versions.select(*by, "width", F.explode("elements").alias("e")).select(*by, "width", "e.*")
    cells = each.select(*by, "width", F.explode(F.array(*put(F.col("d"), F.col("t"), F.lit(1), F.col("width")))).alias("c")).select(*by, "width", "c.*")
    return summed(cells, *by, "width", "at")


def printed(cells: Column) -> Column:
    """Cells in order as text: place, count and the three xors."""
    of = lambda c: F.concat_ws(":", F.hex(F.shiftright(c["at"], LANE) * CELLS + c["at"].bitwiseAND(F.lit((1 << LANE) - 1))), F.hex(c["count"]), F.hex(c["keys"]), F.hex(c["times"]), F.substring(F.hex(c["checks"]), 1, 8))
    return F.concat_ws(".", F.transform(F.sort_array(cells), of))


def peeled(pairs: DataFrame, first: bool) -> DataFrame:
    """row, kind, good, only_own, only_other (how many elements differ), own_digests, other_digests (of kind 0), and if ``first``,
    own_print, other_print. pairs: row, kind, width and the elements own and other, dealt by row."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(n).alias("elements")) for s, n in ((1, "own"), (-1, "other"))))
    cells = sketches(pairs.select("row", "kind", "width", F.explode(sides).alias("s")).select("row", "kind", "width", "s.*"), "row", "kind", "side")
    # Subtract: cells meet with their side's sign. The low rung is folded from the high one; fingerprints stay as they are.
    as_row = lambda rung, at, count: F.struct(F.lit(rung).alias("rung") if isinstance(rung, int) else rung.alias("rung"), at.alias("at"), F.lit(0).cast("long").alias("digest"), count.alias("count"), "keys", "times", "checks")
    at, low, signed = F.col("at"), folded(F.col("at"), CELLS), F.col("side") * F.col("count")
    high = [as_row(HIGH, at, signed)]
    both = [*high, as_row(LOW, low, signed)]
    side = F.when(F.col("side") > 0, F.lit(OWN)).otherwise(F.lit(OTHER))
    out = F.when(F.col("kind") == 0, F.array(*both, as_row(side, low, F.col("count")))).otherwise(F.array(*both)) if first else F.array(*high)
    by = ("row", "kind", "width", "rung", "at", "digest")
    cells = summed(cells.select("row", "kind", "width", F.explode(out).alias("c")).select("row", "kind", "width", "c.*"), *by)
    filled = "count != 0 or keys != 0 or times != 0 or checks != 0"
    d, t, width = F.col("keys"), F.col("times"), F.when(F.col("rung") == LOW, F.lit(CELLS).cast("long")).otherwise(F.col("width"))
    for r in range(ROUNDS):
        cells = cells.where(filled)
        alone = (F.col("rung") <= HIGH) & (F.shiftright("at", LANE) == r % LANES) & F.col("count").isin(1, -1) & (check(d, t) == F.col("checks")) & (cell(d, t, r % LANES, width) == F.col("at"))
        same = F.struct("at", "digest", "count", "keys", "times", "checks")
        nothing = F.lit(0).cast("long")
        beyond = F.when(F.col("count") > 0, F.lit(FOUND << LANE)).otherwise(F.lit(FOUND + 1 << LANE))
        given = F.struct(beyond.alias("at"), F.when(F.col("kind") == 0, d).otherwise(nothing).alias("digest"), "count", d.alias("keys"), t.alias("times"), nothing.alias("checks"))
        taken = [F.struct(x["at"].alias("at"), nothing.alias("digest"), x["count"].alias("count"), x["keys"].alias("keys"), x["times"].alias("times"), x["checks"].alias("checks")) for x in put(d, t, -F.col("count"), width)]
        out = F.when(alone, F.array(same, given, *taken)).otherwise(F.array(same))
        cells = summed(cells.select("row", "kind", "width", "rung", F.explode(out).alias("c")).select("row", "kind", "width", "rung", "c.*"), *by)
    lane = F.shiftright("at", LANE)
    rungs = (LOW, HIGH) if first else (HIGH,)
    total = lambda rung, which, value: F.sum(F.when((F.col("rung") == rung) & which, value).otherwise(0))
    out = []
    for rung in rungs:
        out += [total(rung, lane < FOUND, F.lit(1)).alias(f"left_{rung}")]
        for which, name in ((FOUND, "own"), (FOUND + 1, "other")):
            here = (F.col("rung") == rung) & (lane == which)
            out += [total(rung, lane == which, F.abs("count")).alias(f"only_{name}_{rung}"), F.collect_list(F.when(here & (F.col("kind") == 0), F.col("digest"))).alias(f"{name}_digests_{rung}")]
    if first:
        out += [F.collect_list(F.when(F.col("rung") == rung, F.struct("at", "count", "keys", "times", "checks"))).alias(f"print_{rung}") for rung in (OWN, OTHER)]
    done = cells.where(filled).groupBy("row", "kind").agg(*out)
    names = ("only_own", "only_other", "own_digests", "other_digests")
    pick = lambda n: F.when(F.col(f"left_{LOW}") == 0, F.col(f"{n}_{LOW}")).otherwise(F.col(f"{n}_{HIGH}")).alias(n) if first else F.col(f"{n}_{HIGH}").alias(n)
    good = F.array_min(F.array(*(f"left_{rung}" for rung in rungs))) == 0
    prints = [printed(F.col(f"print_{rung}")).alias(n) for rung, n in ((OWN, "own_print"), (OTHER, "other_print"))] if first else []
    return done.select("row", "kind", good.alias("good"), *(pick(n) for n in names), *prints)


@contextmanager
def one_map_each(spark: SparkSession) -> Iterator[None]:
    """A chain of aggregations in one stage makes the generated maps of all its rounds before the first row, each with a page
    of memory (16 to 64 MB); the plain maps get theirs with their first row and give it back as soon as they are read."""
    before = spark.conf.get(FAST_MAPS)
    spark.conf.set(FAST_MAPS, "false")
    try:
        yield
    finally:
        spark.conf.set(FAST_MAPS, before)


def rung(expected: Column) -> Column:
    """Width of the least rung with room for so many differences."""
    cells = F.greatest(expected * SPACE / LANES / CELLS + 1, F.lit(1.0))
    return (CELLS * F.pow(F.lit(2.0), F.ceil(F.log2(cells)))).cast("long")


def compared(rows: DataFrame, kinds: tuple[tuple[str, float], ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(row, kind, only_own, only_other, own_digests, other_digests) of every pair that has elements, and (row, own_print,
    other_print) of kind 0. rows: written; row, own and a column of elements for each kind."""
    total = rows.agg(F.sum(F.size("own"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART)
    done, prints = None, None
    each = F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(share).alias("share"), F.col(n).alias("other")) for i, (n, share) in enumerate(kinds)))
    pairs = rows.select("row", "own", F.explode(each).alias("p")).select("row", "own", "p.*")
    pairs = pairs.withColumn("width", rung(F.col("share") * (F.size("own") + F.size("other")))).drop("share")
    again, pairs = pairs, pairs.repartition(parts, "row")
    for attempt in range(ATTEMPTS):
        # Rows are dealt as arrays; no round deals their cells again.
        with one_map_each(rows.sparkSession):
            tried = written(peeled(pairs, attempt == 0), "peeled")
        prints = tried.where("kind = 0").select("row", "own_print", "other_print") if prints is None else prints
        good = tried.where("good").select("row", "kind", "only_own", "only_other", "own_digests", "other_digests")
        done = good if done is None else done.unionByName(good)
        failed = written(tried.where("not good").select("row", "kind"), "failed")
        n = failed.count()
        if not n:
            return done, prints
        again = again.join(small(failed), ["row", "kind"], "left_semi").withColumn("width", F.col("width") * 2)
        again = written(again, "again")
        parts = max(1, min(parts, n // 100))
        few = again.agg(F.sum(F.size("own") + F.size("other"))).first()[0] <= PART
        pairs = again.coalesce(1) if few else again.repartition(parts, "row")
    raise RuntimeError("a sketch could not be peeled")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the digests of the
    paragraphs that only the text and only the edited text has: one row per input row."""
    rows = written(with_elements(versions(docs).withColumn("row", F.expr(ROW))), "versions")
    done, prints = compared(rows)
    of = lambda kind, c: F.first(F.when(F.col("kind") == kind, c), ignorenulls=True)
    differs = F.col("only_own") + F.col("only_other")
    done = done.groupBy("row").agg(of(0, differs).alias("edited_differs"), of(1, differs).alias("next_differs"), of(0, F.col("own_digests")).alias("only_own"), of(0, F.col("other_digests")).alias("only_edited"))
    light = rows.select("row", "doc_id", "n_chars", "edited_sha256", *(F.size(n).alias("n_" + n) for n in ("own", "edited", "next")))
    out = light.join(done, "row", "left").join(prints, "row", "left")  # a pair without any cell left has no difference
    near = lambda n: F.lit(1.0) - F.coalesce(F.col(n + "_differs") / (F.col("n_own") + F.col("n_" + n)), F.lit(0.0))
    text = lambda n: F.coalesce(n, F.lit(""))
    digests = lambda n: F.sort_array(F.coalesce(n, F.array().cast("array<long>")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text("own_print").alias("fingerprint"), text("other_print").alias("edited_fingerprint"),
        near("edited").alias("near_edited"), near("next").alias("near_next"), digests("only_own").alias("only_own"), digests("only_edited").alias("only_edited"),
    )
