"""CSV with exact rules, read and written by DataFrame functions.

An unquoted empty field is NULL, ``""`` is the empty string; a quoted field is never taken for a number; one empty field at
the end of a line is dropped (.tbl files); blank lines are skipped; names are trimmed and lower-cased, a blank one becomes
``columnN``. If no record spans lines, a file is read in splits; otherwise each file is one record sequence in one task.

A column's type is the first of BIGINT, DOUBLE, DATE, BOOLEAN that every unquoted value parses as; else VARCHAR.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import SqlError

#: Never in a text file; Spark's own splitting is turned off with it.
OFF = "\u0001"
PATTERNS = {
    "bigint": r"^[+-]?[0-9]{1,19}$",
    "double": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "boolean": r"^(?i:true|t|false|f)$",
}
#: A file up to this size is read as one text, which gives errors their line.
SMALL = 8 << 20
NAMES = {"bigint": "integer", "double": "number", "date": "date", "boolean": "boolean"}


def value_of(kind: str, text: Column) -> Column:
    """A trimmed text as a type, null where it isn't one."""
    text = F.trim(text)
    if kind == "boolean":
        return F.when(text.rlike(PATTERNS[kind]), F.lower(F.substring(text, 1, 1)) == "t")
    return F.when(text.rlike(PATTERNS[kind]), text.try_cast(kind))


def small_file(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    return status.isFile() and status.getLen() <= SMALL


def raw_records(spark: SparkSession, path: str, header: bool) -> tuple[DataFrame, str | None]:
    """(record, line) without blank records, and the header's text. line is null where a file is read in splits."""
    lines = spark.read.option("lineSep", "\n").text(path)
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    if small_file(spark, path) or lines.where(odd).limit(1).count():
        whole = spark.read.text(path, wholetext=True).select(F.regexp_extract_all("value", F.lit(r'((?:[^"\n]++|"(?:[^"]++|"")*+(?:"|$))*+)(?:\n|$)'), F.lit(1)).alias("all"))
        records = whole.select(F.posexplode("all").alias("n", "record"))
        records = records.where(F.trim(F.regexp_replace("record", "\r", "")) != "")
        if not header:
            return records.select("record", (F.col("n") + 1).alias("line")), None
        if not small_file(spark, path):
            records = records.withColumn("head", F.col("n") == 0)  # of each file
        else:
            top = records.agg(F.min("n")).first()[0]
            records = records.withColumn("head", F.col("n") == (top or 0))
        first = records.where("head").select("record").first()
        return records.where("not head").select("record", (F.col("n") + 1).alias("line")), first[0] if first else ""
    options = {"sep": OFF, "quote": "", "escape": "", "comment": "", "lineSep": "\n", "header": header, "nullValue": OFF, "emptyValue": "", "mode": "PERMISSIVE", "enforceSchema": True, "inferSchema": False, "maxCharsPerColumn": -1}
    first = lines.where("trim(value) != ''").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "record string, line int"), "" if header else None
    df = spark.read.options(**options).schema("record string").csv(path)
    df = df.where(F.trim(F.regexp_replace(F.coalesce("record", F.lit("")), "\r", "")) != "")
    return df.select("record", F.lit(None).cast("int").alias("line")), first[0][0] if header else None


def fields(record: Column, delimiter: str) -> Column:
    """Array of raw fields, quotes kept; carriage returns outside quotes are dropped."""
    d = re.escape(delimiter)
    pattern = rf'{d}((?:"(?:[^"]++|"")*+"\r?)|[^{d}"]*+)'
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(pattern), F.lit(1))
    whole = F.concat(F.lit(delimiter), F.array_join(found, delimiter)) == F.concat(F.lit(delimiter), record)
    text = F.concat(F.lit("malformed quotes in record: "), F.substring(record, 1, 200))
    strip = lambda x: F.when(x.startswith('"'), F.regexp_replace(x, "\r$", "")).otherwise(F.replace(x, F.lit("\r"), F.lit("")))
    return F.when(whole, F.transform(found, strip)).otherwise(F.raise_error(text).cast("array<string>"))


def header_names(text: str, delimiter: str) -> list[str]:
    d = re.escape(delimiter)
    raw = re.findall(rf'{d}((?:"(?:[^"]|"")*"\r?)|[^{d}"]*)', delimiter + text)
    names = [(x.rstrip("\r")[1:-1].replace('""', '"') if x.startswith('"') else x.replace("\r", "")).strip().lower() for x in raw]
    if len(names) > 1 and not names[-1]:
        names.pop()
    names = [n or f"column{i + 1}" for i, n in enumerate(names)]
    for n in names:
        if names.count(n) > 1:
            raise SqlError(f'column "{n}" is there twice', "42701")
    return names


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, schema: S.StructType | str | None = None) -> DataFrame:
    """schema: names and types to parse as, with an error naming the column; without one, types are inferred in one pass."""
    records, first = raw_records(spark, path, header)
    rows = records.select(fields(F.col("record"), delimiter).alias("f"), "line")
    if schema is not None:
        schema = S.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names = [f.name.lower() for f in schema]
    elif first is not None:
        names = header_names(first, delimiter)
    else:
        head = rows.limit(1).collect()
        width = len(head[0]["f"]) if head else 0
        names = [f"column{i + 1}" for i in range(width - (width > 1 and head[0]["f"][-1] == ""))]
    width = len(names)
    f, n = F.col("f"), F.size("f")
    dropped = F.when((n == width + 1) & (F.get(f, F.lit(width)) == ""), F.slice(f, 1, width)).otherwise(f)
    where = F.concat(F.lit("line "), F.coalesce(F.col("line").cast("string"), F.lit("?")))
    wrong = F.concat(where, F.lit(f": expected {width} fields, found "), F.size("f").cast("string"))
    rows = rows.select(dropped.alias("f"), "line").select(F.when(F.size("f") == width, F.col("f")).otherwise(F.raise_error(wrong).cast("array<string>")).alias("f"), "line")
    raw = [F.get("f", F.lit(i)) for i in range(width)]
    text = [F.when(x.startswith('"'), F.replace(F.expr(f"substring(f[{i}], 2, length(f[{i}]) - 2)"), F.lit('""'), F.lit('"'))).when(x != "", x) for i, x in enumerate(raw)]
    if schema is not None:
        kinds = [{"int": "bigint", "long": "bigint", "string": "string"}.get(k.dataType.simpleString(), k.dataType.simpleString()) for k in schema]
    elif width:
        tests = [F.min(F.when(raw[i] != "", ~raw[i].startswith('"') & value_of(k, text[i]).isNotNull())).alias(f"{k}{i}") for i in range(width) for k in PATTERNS]
        found = rows.agg(*tests).first()
        kinds = [next((k for k in PATTERNS if found[f"{k}{i}"]), "string") for i in range(width)]
    else:
        return spark.createDataFrame([], "column1 string").select()
    out = []
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        if kind not in PATTERNS:
            out.append(text[i].alias(name))
            continue
        value = value_of(kind, text[i])
        message = F.concat(where, F.lit(f", column {i + 1}: invalid {NAMES[kind]} `"), text[i], F.lit("`"))
        out.append(F.when(text[i].isNull(), F.lit(None)).otherwise(F.coalesce(value, F.raise_error(message).cast(kind))).cast(kind).alias(name))
    return rows.select(*out)


def csv_line(df: DataFrame, delimiter: str = ",") -> Column:
    """A row as a line: NULL as nothing, '' as "", quotes only where they are needed."""
    from ..functions.types import double_text

    special = "[" + re.escape(delimiter) + "\"\r\n]"
    parts = []
    for f in df.schema:
        c = f"`{f.name.replace('`', '``')}`"
        text = F.expr(double_text(f"CAST({c} AS DOUBLE)") if isinstance(f.dataType, S.FractionalType) else f"CAST({c} AS STRING)")
        needs = (text == "") | text.rlike(special)
        parts.append(F.when(text.isNull(), "").when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(delimiter, *parts)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    """A folder of CSV files, written in parallel; each has the header."""
    names = delimiter.join(df.columns)

    def headed(batches):
        import pandas as pd

        for i, b in enumerate(batches):
            yield pd.DataFrame({"value": [names, *b["value"]]}) if i == 0 else b

    lines = df.select(csv_line(df, delimiter).alias("value"))
    (lines.mapInPandas(headed, "value string") if header else lines).write.option("lineSep", "\n").text(path)


def csv_lines(df: DataFrame, delimiter: str = ",", header: bool = True):
    """The lines one by one, a partition at a time."""
    if header:
        yield delimiter.join(df.columns)
    for row in df.select(csv_line(df, delimiter)).toLocalIterator():
        yield row[0]
