"""Token counts through a digest cache.

Key: digest of the normalised content and digest of the tokenizer file. Documents are joined to the stored counts by
key; each distinct miss is encoded once and appended to the cache, a Parquet folder that all machines share; rows are
answered from what was stored and what was added. Texts are shuffled once, past a merge join with one representative per
missing digest, so copies of a text are encoded once wherever they lie; rows that repeat both id and text meet there and
all but one are passed over.

Edge cases: null text counts as empty (0 tokens); repeated rows get a row each; null ids are matched as equal
ones; a cache written by two runs at once may hold a key twice, with equal counts, and is read through max().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, whole_text, written
from .tokens import check_words, encoder, version

LIMIT = 2048
CACHE = "digest string, tokenizer string, n_tokens long"


def read_cache(spark, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version: digest, n_tokens."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "digest string, n_tokens long")
    stored = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row."""
    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_dir(spark)}/lakemill/token_cache"
    tokenizer = version(tokenizer_path)
    text = whole_text()
    # Word tokenizers drop white space, so runs of it are one blank in the key; it changes no count.
    content = F.regexp_replace(text, r"[ \t-\r]+", " ") if check_words(tokenizer_path) else text
    own = F.xxhash64(text)
    light = docs.select("doc_id", own.alias("own"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(content.cast("binary"), 256).alias("digest"))
    light = written(light, "token_keys")
    # Digests are made distinct first, so a digest that many rows share is one row when it meets the stored ones.
    distinct = light.groupBy("digest").agg(F.min(F.struct("doc_id", "own")).alias("first"))
    known = distinct.join(read_cache(spark, cache_path, tokenizer), "digest", "left")
    known = written(known.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.own").alias("first_own"), "n_tokens"), "token_known")
    misses = known.where("n_tokens is null").drop("n_tokens")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found, last = encoder(tokenizer_path), None
        for b in batches:
            digests, keep = b.column(0).to_pylist(), []
            for i, digest in enumerate(digests):  # rows that repeat both id and text follow each other
                if digest != last:
                    keep.append(i)
                last = digest
            if keep:
                counts = [n for _, at in found.slices(b.column(1).take(pa.array(keep))) for n in np.diff(at).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in keep]), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    texts = docs.select("doc_id", own.alias("own"), text.alias("text"))
    todo = texts.join(misses.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("own") == F.col("first_own"))).select("digest", "text")
    # A join that splits a hot id may have counted its text more than once.
    new = todo.mapInArrow(encode, "digest string, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new = written(new, "token_counts")
    new.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # Written tables on both sides: the partition of a digest that many rows share can be split.
    counts = known.where("n_tokens is not null").select("digest", "n_tokens").unionByName(new)
    out = light.join(counts, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
