"""URL rules, and a blocked Bloom filter of listed canonical URLs before an exact hash join.

The filter has at most ``MAX_BLOCKS`` blocks of four 64-bit words, one bit set in each, so what is broadcast is bounded
however long the list is; a longer list only lets more URLs through to the exact join, which removes false positives.

Edge cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed; empty list: nothing
is blocked by it; repeated pages and list entries: one row per page row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 524,288 blocks of 32 bytes, 16 MB, at most: enough for eight million listed URLs at 16 a block.
MAX_BLOCKS = 1 << 19
KEYS_PER_BLOCK = 16
#: (verdict, host, path prefix), fixed values of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host without port 80/443 and leading www., path without its last slash, query parameters sorted and without trackers."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref|fbclid|gclid)=")))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule (of host and path together) that fits: its text and its verdict, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def place(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the word to set in each of its four lanes."""
    h, g = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * lane).bitwiseAND(F.lit(63)).cast("int")) for lane in range(4)]
    return F.pmod(h, F.lit(n_blocks)).cast("int"), bits


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3): the words of each block that has keys."""
    block, bits = place(F.col("url_key"), n_blocks)
    return listed.groupBy(block.alias("block")).agg(*(F.bit_or(b).alias(f"w{i}") for i, b in enumerate(bits)))


def listed_hits(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` (with url_key) plus ``listed`` boolean. listed: one column url_key."""
    listed = listed.where("url_key is not null").distinct()
    n = listed.count()
    if not n:
        return pages.withColumn("listed", F.lit(False))
    n_blocks = min(MAX_BLOCKS, max(16, 1 << (n // KEYS_PER_BLOCK).bit_length()))
    block, bits = place(F.col("url_key"), n_blocks)
    words = F.broadcast(bloom(listed, n_blocks))  # n_blocks rows at most
    probed = pages.withColumn("block", block).join(words, "block", "left")
    passes = F.col("url_key").isNotNull() & F.col("w0").isNotNull()
    for i, b in enumerate(bits):
        passes = passes & (F.col(f"w{i}").bitwiseAND(b) != 0)
    probed = probed.withColumn("possible", F.coalesce(passes, F.lit(False))).drop("block", "w0", "w1", "w2", "w3")
    sure = listed.select(F.col("url_key").alias("listed_key"))
    possible = probed.where("possible").join(sure.hint("merge"), F.col("url_key") == F.col("listed_key"), "left")
    possible = possible.withColumn("listed", F.col("listed_key").isNotNull()).drop("listed_key", "possible")
    return possible.unionByName(probed.where("not possible").withColumn("listed", F.lit(False)).drop("possible"))


def url_filter(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Judge every page: the longest fitting rule decides; otherwise a URL whose canonical form is listed is blocked."""
    host, path = host_and_path(F.col("url"))
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    df = pages.select("page_id", "url").withColumns({"host": host, "path": path, "url_key": canonical(F.col("url"))})
    df = listed_hits(df, listed.select(canonical(F.col("url")).alias("url_key")))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")
