"""CSV, Parquet and generated tables."""

import datetime

import pytest
from pyspark.sql import types as S

from lakemill.engine import Engine
from lakemill.errors import SqlError, translated
from lakemill.sources.csv import csv_lines, read_csv, write_csv
from lakemill.sources.tpch import SCHEMAS, TEXTS


@pytest.fixture
def read(spark, tmp_path):
    def run(text, **options):
        path = tmp_path / "x.csv"
        path.write_bytes(text.encode())
        try:
            df = read_csv(spark, str(path), **options)
            return dict(df.dtypes), [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            raise translated(e) from e

    return run


def test_inference_and_nulls(read):
    kinds, rows = read('id,Name , score,d,ok,zip\r\n1,Ann,1.5,2024-01-02,t,"02134"\r\n2,,,,F,"1"\r\n\r\n3,"",2,2024-02-03,TRUE,\r\n')
    assert kinds == {"id": "bigint", "name": "string", "score": "double", "d": "date", "ok": "boolean", "zip": "string"}
    assert rows == [(1, "Ann", 1.5, datetime.date(2024, 1, 2), True, "02134"), (2, None, None, None, False, "1"), (3, "", 2.0, datetime.date(2024, 2, 3), True, None)]


def test_quotes_across_lines(read):
    assert read('a,b\n1,"x, ""y""\nz"\n2,q\n')[1] == [(1, 'x, "y"\nz'), (2, "q")]


def test_trailing_delimiter(read):
    assert read("1|a|2.5|\n2|b|3|\n", delimiter="|", header=False) == ({"column1": "bigint", "column2": "string", "column3": "double"}, [(1, "a", 2.5), (2, "b", 3.0)])


@pytest.mark.parametrize(
    ("text", "options", "message"),
    [
        ("a,b\n1\n", {}, "line 2: expected 2 fields, found 1"),
        ("a,a\n1,2\n", {}, 'column "a" is there twice'),
        ('a,b\n"x"y,2\n', {}, 'malformed quotes in record: "x"y,2'),
        ("a\n1\nx\n", {"schema": "a long"}, "line 3, column 1: invalid integer `x`"),
    ],
)
def test_csv_errors(read, text, options, message):
    with pytest.raises(SqlError) as e:
        read(text, **options)
    assert e.value.message == message


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, "a,b", 2.5, True), (2, "", None, None), (None, 'q"x\ny', 1e10, False)]
    df = spark.createDataFrame(rows, "i long, s string, d double, b boolean")
    assert list(csv_lines(df)) == ["i,s,d,b", '1,"a,b",2.5,true', '2,"",,', ',"q""x\ny",10000000000,false']
    write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "out")).collect()] == rows


def test_files_in_splits_agree_with_whole_files(spark, tmp_path, monkeypatch):
    from lakemill.sources import csv

    path = tmp_path / "big.csv"
    path.write_text("id,s\n" + "".join(f'{i},"v{i}"\n\n' for i in range(500)))
    whole = read_csv(spark, str(path)).collect()
    monkeypatch.setattr(csv, "SMALL", 0)
    assert sorted(read_csv(spark, str(path)).collect()) == sorted(whole) and len(whole) == 500


def test_parquet_types(spark, tmp_path):
    engine = Engine(spark)
    df = engine.spark.sql("select 1 as a, cast(2 as tinyint) b, cast(1.5 as decimal(12,2)) c, cast(0.5 as float) d, 'x' as E, true f, date'2020-01-02' g, timestamp_ntz'2020-01-02 03:04:05' h")
    df.write.parquet(str(tmp_path / "t.parquet"))
    engine.load("t", str(tmp_path / "t.parquet"))
    assert engine.columns("t") == [("a", "BIGINT"), ("b", "BIGINT"), ("c", "DOUBLE"), ("d", "DOUBLE"), ("e", "VARCHAR"), ("f", "BOOLEAN"), ("g", "DATE"), ("h", "TIMESTAMP")]
    assert engine.rows("select a + b, c, d, extract(year from h), h > date '2020-01-02' from t") == [(3, 1.5, 0.5, 2020, True)]
    with pytest.raises(SqlError, match="already exists"):
        engine.load("t", str(tmp_path / "t.parquet"))


def test_nested_columns_are_refused(spark):
    engine = Engine(spark)
    with pytest.raises(SqlError, match='column "x" of table "n": type array<int> is not supported'):
        engine.register("n", engine.spark.sql("select array(1) as x"))


@pytest.mark.parametrize("scale", [0.0002, 0.001, 0.002, 0.005, 0.01])
def test_parts_have_four_different_suppliers(spark, scale):
    engine = Engine(spark)
    engine.tpch(scale)
    suppliers = engine.rows("select count(*) from supplier")[0][0]
    assert engine.rows("select count(*), min(n), max(n) from (select ps_partkey, count(distinct ps_suppkey) as n from partsupp group by ps_partkey) x") == [(round(200_000 * scale), min(4, suppliers), min(4, suppliers))]
    assert engine.rows("select count(*) from partsupp")[0][0] == round(200_000 * scale) * min(4, suppliers)
    assert engine.rows("select count(*) from partsupp where ps_suppkey not in (select s_suppkey from supplier)") == [(0,)]


def test_tpch(spark):
    engine = Engine(spark)
    engine.tpch(0.001)
    for name, schema in SCHEMAS.items():
        assert engine.spark.table(engine.tables[name][0]).schema.simpleString() == S.StructType.fromDDL(schema).simpleString()
    one = lambda q: engine.rows(q)[0][0]
    assert one("select count(*) from orders where o_custkey % 3 = 0 or o_custkey > 150 or o_custkey < 1") == 0
    assert one("select count(*) from lineitem l where not exists (select 1 from partsupp where ps_partkey = l_partkey and ps_suppkey = l_suppkey)") == 0
    assert one("select count(*) from lineitem l join orders on l_orderkey = o_orderkey where l_shipdate <= o_orderdate or l_receiptdate <= l_shipdate") == 0
    assert one("select count(*) from orders o where o_orderstatus = 'F' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O')") == 0
    assert 0 < one("select count(*) from orders where o_comment like '%special%requests%'") < 100
    for text in TEXTS.values():
        engine.rows(text)
