"""Risk-controlled quality rules (DataFrame functions only).

Each rule rejects a document whose share of some unwanted thing exceeds a cutoff. Cutoffs come from labelled
documents: for each stratum and rule, a fixed grid of cutoffs is tested from the most lenient one downwards against
"the share of good documents rejected is above ``max_false_rejection``", with the exact binomial tail as p-value. Half of
the error probability ``error`` is split over all strata and rules (Bonferroni); along one grid the tests form a fixed
sequence, which needs no further correction. Of the cutoffs proven safe the one that best tells bad from good is used.

A document is rejected if any rule is broken, so where several rules have a cutoff the limit is proven again for what
they reject together. Their cutoffs were chosen by the same labels; the other half of ``error`` is therefore split over
all combinations of cutoffs that could have been chosen. If all chosen rules together are not proven safe, the set of
them that is and best tells bad from good stays; a single rule has its proof already.

The evidence is a stratum's distinct labelled texts that pass the base: repeated labels and exact copies of a text count
once, and a text that is labelled both good and bad does not count. What is promised is therefore a share of the distinct
good texts that pass the base.

Edge cases: null text has no words (base_failed); a null stratum is a stratum of its own; a stratum with too few labels
to prove anything gets no cutoff; of the labels only quality 0 and 1 count.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import rows_of, small, with_row, written

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_FALSE_REJECTION = 0.05
ERROR = 0.05
#: A good document lost weighs as much as this many bad ones caught.
GOOD_WEIGHT = 5.0
GRID = (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)
P = "__rule_"
#: The stratum of a row.
OF = P + "of"


def rules() -> dict[str, Column]:
    """Share of each unwanted thing, 0 to 1, from the columns of ``measured``."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "repeats": share("n_repeat_words", "n_words"),
        "lines": share("n_dup_lines", P + "lines"),
        "capitals": share(P + "capitals", "word_chars"),
        "shouts": share(P + "shouts", "word_chars"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (text, and none of the names added here) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and ``__rule_`` columns.

    The three-word windows of a text are compared by 64-bit hashes in one sorted array, so a text of n words takes
    O(n log n); the sort runs only where the distinct hashes are fewer than the windows. The steps are separate
    projections whose arrays are read more than once, which keeps Catalyst from merging a split into a lambda.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumns({
        P + "text": F.xxhash64(text),
        P + "words": F.array_remove(F.split(text, SPACE), ""),
        P + "all_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        P + "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        P + "shouts": F.regexp_count(text, F.lit("!")).cast("long"),
    })
    w, lines = F.col(P + "words"), F.col(P + "all_lines")
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        P + "lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        P + "grams": F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))),
    })
    g = F.col(P + "grams")
    df = df.withColumn(P + "sorted", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col(P + "sorted")
    twin = lambda x, k: ((k > 0) & (x["h"] == F.get(s, k - 1)["h"])) | ((k < F.size(s) - 1) & (x["h"] == F.get(s, k + 1)["h"]))
    found = F.filter(F.transform(s, lambda x, k: F.when(twin(x, k), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn(P + "at", F.when(s.isNotNull(), F.sort_array(found)))
    at = F.col(P + "at")
    covered = F.aggregate(F.transform(at, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, k - 1)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop(*(P + x for x in ("words", "all_lines", "grams", "sorted", "at")))


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k). Terms are summed from k downwards; past 40 standard deviations they add nothing to a double."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(40 * F.sqrt(n) + 50)).cast("long")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.when(steps > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), steps - 1), zero, step, lambda a: a["total"])).otherwise(F.lit(1.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * total))  # at the mean or above nothing is proven


def cutoffs(features: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """(stratum, cutoff per rule as a column, null where none is proven safe), one row per stratum that has labels."""
    named = rules()
    truth = labels.select(F.col("doc_id").alias(P + "id"), F.col("quality").alias(P + "quality")).where(F.col(P + "quality").isin(0, 1))
    text = F.col(P + "text") if P + "text" in features.columns else F.col("doc_id")
    known = features.where(~F.col("base_failed")).select("doc_id", F.col(stratum).alias("stratum"), text.alias("text"), *(c.alias(n) for n, c in named.items()))
    known = known.join(truth.distinct(), known.doc_id == F.col(P + "id"))
    known = known.groupBy("stratum", "text").agg(F.min(P + "quality").alias("good"), F.max(P + "quality").alias("most"), *(F.max(n).alias(n) for n in named)).where("good = most")
    level = lambda c: sum((F.when(c > g, 1).otherwise(0) for g in GRID), F.lit(0))  # noqa: E731  how many cutoffs it exceeds
    counts = known.groupBy("stratum", *(level(F.col(n)).alias(n) for n in named)).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    counts = written(counts, "rule_counts")
    strata = max(1, counts.select("stratum").distinct().count())
    grid = F.array(*(F.struct(F.lit(g).alias("cutoff"), F.lit(len(GRID) - i).alias("least")) for i, g in enumerate(GRID)))
    each = counts.select("stratum", "good", "bad", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("level")) for n in named))).alias("r"))
    each = each.select("stratum", "good", "bad", "r.*").withColumn("c", F.explode(grid))
    hit = F.col("level") >= F.col("c.least")
    tests = each.groupBy("stratum", "rule", F.col("c.cutoff").alias("cutoff")).agg(
        F.sum("good").alias("n"), F.sum("bad").alias("n_bad"),
        F.sum(F.when(hit, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias("k_bad"),
    )
    tests = tests.withColumn("safe", binomial_tail(F.col("k"), F.col("n"), max_false_rejection) <= error / 2 / (strata * len(named)))
    sequence = W.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))  # as many rows as the grid has
    tests = tests.withColumn("safe", F.min("safe").over(sequence)).where("safe and k_bad > 0")
    gain = F.col("k_bad") / F.col("n_bad") - F.lit(GOOD_WEIGHT) * F.col("k") / F.col("n")
    best = tests.where(gain > 0).groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain, F.col("cutoff"))).alias("cutoff"))
    best = best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == n, F.col("cutoff"))).alias(P + "cut_" + n) for n in named))
    return together(counts, best, max_false_rejection, error / 2 / strata)


def together(counts: DataFrame, cuts: DataFrame, max_false_rejection: float, error: float) -> DataFrame:
    """``cuts`` without the rules whose rejections, joined, are not proven to keep the limit; error is that of a stratum."""
    names = list(rules())
    cuts = written(cuts, "single_cutoffs").withColumnRenamed("stratum", P + "stratum")
    cut = lambda n: F.col(P + "cut_" + n)
    least = lambda n: sum((F.when(cut(n) >= g, 1).otherwise(0) for g in GRID), F.lit(0))  # noqa: E731  levels from which the cutoff is exceeded
    bits = lambda test: sum((F.when(test(n), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    found = counts.join(small(cuts), F.col("stratum").eqNullSafe(F.col(P + "stratum")))
    found = found.groupBy("stratum", bits(lambda n: cut(n).isNotNull()).alias("all"), bits(lambda n: cut(n).isNotNull() & (F.col(n) >= least(n))).alias("hit"))
    found = found.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))  # at most as many rows as sets of rules
    found = found.withColumn("set", F.explode(F.sequence(F.lit(1), F.lit((1 << len(names)) - 1)))).where(F.col("set").bitwiseAND(F.col("all")) == F.col("set"))
    hit = F.col("hit").bitwiseAND(F.col("set")) > 0
    sets = found.groupBy("stratum", "all", "set").agg(
        F.sum("good").alias("n"), F.sum("bad").alias("n_bad"),
        F.sum(F.when(hit, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias("k_bad"),
    )
    size = F.bit_count("set")
    ways = F.get(F.array(*(F.lit(float(comb(len(names), m) * len(GRID) ** m)) for m in range(len(names) + 1))), size)
    safe = (size == 1) | (binomial_tail(F.col("k"), F.col("n"), max_false_rejection) <= F.lit(error) / (len(names) - 1) / ways)
    gain = F.col("k_bad") / F.col("n_bad") - F.lit(GOOD_WEIGHT) * F.col("k") / F.col("n")
    best = sets.where(safe).groupBy("stratum").agg(F.max_by("set", F.struct(F.col("set") == F.col("all"), gain, -F.col("set"))).alias("set"))
    best = best.join(cuts, F.col("stratum").eqNullSafe(F.col(P + "stratum")))
    return best.select("stratum", *(F.when(F.col("set").bitwiseAND(F.lit(1 << i)) > 0, cut(n)).alias(P + "cut_" + n) for i, n in enumerate(names)))


def judged(features: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """``features`` with kept and the first broken rule (null: none)."""
    cuts = small(written(cuts, "rule_cutoffs")).withColumnRenamed("stratum", P + "stratum")
    df = features.join(cuts, F.col(stratum).eqNullSafe(F.col(P + "stratum")), "left")
    broken = F.coalesce(*(F.when(c > F.col(P + "cut_" + n), F.lit(n)) for n, c in rules().items()))
    return df.withColumn("broken_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(broken)).withColumn("kept", F.col("broken_rule").isNull())


def narrow(docs: DataFrame, stratum: str) -> DataFrame:
    return docs.select("doc_id", F.col(stratum).alias(OF), "text")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Base measures and the risk-controlled verdict of every document; one row per input row."""
    features = written(measured(narrow(docs, stratum)).drop("text"), "rule_features")
    out = judged(features, cutoffs(features, labels, OF), OF)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rule")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their columns, that the rules keep. Texts are measured again instead of being shuffled."""
    cuts = cutoffs(written(measured(narrow(docs, stratum)).drop("text"), "rule_features"), labels, OF)
    return rows_of(judged(measured(with_row(docs, F.col(stratum).alias(OF), "text")), cuts, OF).where("kept"))
