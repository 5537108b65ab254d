"""What the operators of this subpackage share: written intermediate tables and checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it has been written and holds at most this many rows and bytes of files.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 8 << 20
#: Name of a row's own columns, kept together and apart from an operator's.
ROW = "__row"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines see; a local one only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file:///tmp/checkpoints/lakemill-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


_temporary: list[str] = []


def remove_at_exit(path: str) -> None:
    """Intermediate tables outlive the query that reads them lazily, so they go when the driver ends, or by ``release``."""
    if not _registered:
        atexit.register(release)
        _registered.append(True)
    _temporary.append(path)


_registered: list[bool] = []


def release(since: int = 0, keep: str = "") -> None:
    """Remove the intermediate tables written after the first ``since``. For a driver that lives on: call it when the results
    of the queries so far have been written or collected."""
    gone = [p for p in _temporary[since:] if p != keep]
    _temporary[since:] = [p for p in _temporary[since:] if p == keep]
    try:
        jvm = SparkContext._jvm
        conf = SparkContext._active_spark_context._jsc.hadoopConfiguration() if SparkContext._active_spark_context else jvm.org.apache.hadoop.conf.Configuration()
        for path in gone:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def written_so_far() -> int:
    return len(_temporary)


def latest() -> str:
    """Folder of the table written last."""
    return _temporary[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a written table if it is proven small; otherwise leave the join to be shuffled."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_row(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns named, and all of a row in one struct: no name of the caller's meets one of an operator's."""
    return docs.select(F.struct("*").alias(ROW), *columns)


def rows_of(df: DataFrame) -> DataFrame:
    """The rows that ``with_row`` took in, with their own columns."""
    return df.select(f"{ROW}.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the rows that no model may learn labels from; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
