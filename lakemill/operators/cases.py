"""Queries for what is not one SELECT over the driver's tables: files, generated tables, errors, the shell and the server.

Each comes with DuckDB SQL for its rows: over the same tables where they are read, as VALUES where the outcome is fixed.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import SqlError, translated
from ..params import literal, substituted
from ..plans.parser import parse_query, parse_statements
from ..repl import Shell
from ..server import Session
from ..sources.csv import csv_lines, read_csv, write_csv
from ..sources.scratch import scratch
from ..sources.tpch import SCHEMAS, TEXTS
from .queries import QUERIES, engine
from .queries import oracle_sql as select_sql

Rows = list[tuple]
Case = tuple[Callable[[SparkSession, str], DataFrame], str]


def values(columns: str, rows: Rows) -> str:
    """DuckDB SQL of fixed rows."""

    def one(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int):
            return f"{v}::bigint"
        return f"{v!r}::double" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


def message_of(run: Callable) -> SqlError:
    try:
        run()
    except Exception as e:  # noqa: BLE001
        return translated(e)
    return SqlError("no error", "00000")


def demo(spark: SparkSession) -> Engine:
    out = Engine(spark)
    out.demo()
    return out


# CSV


def csv_file(spark: SparkSession, text: str) -> str:
    """One file of this text."""
    path = scratch(spark, "csv")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return next(f for f in spark.read.text(path).inputFiles() if "/part-" in f)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written as CSV in parallel and read again with inferred types."""
    path = scratch(spark, "orders")
    write_csv(engine(spark, sf_dir).sql("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as date) as o_orderdate, o_totalprice > 200000 as big from orders"), path)
    return read_csv(spark, path)


def csv_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts: quotes, delimiters, line ends, empty texts and NULLs come back as they were."""
    path = scratch(spark, "documents")
    write_csv(engine(spark, sf_dir).sql("select doc_id, text, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '' else lang end as lang from documents"), path, delimiter=";")
    return read_csv(spark, path, delimiter=";")


def csv_case(text: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: read_csv(spark, csv_file(spark, text), **options)


def csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which type each column gets."""
    path = csv_file(spark, "whole,real,mixed,day,flag,code,words,none\n7,1.5,3,2031-05-06,t,\"007\",x,\n-8,-2e3,4.25,1999-12-31,FALSE,\"8\",5,\n,,,,,,,")
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in read_csv(spark, path).schema], "name string, type string")


#: (text, options, message)
CSV_ERRORS = (
    ("p,q,r\n1,2,3\n4,5\n", {}, "line 3: expected 3 fields, found 2"),
    ("p,q\n1,2,3\n", {}, "line 2: expected 2 fields, found 3"),
    ("k,K\n1,2\n", {}, 'column "k" is there twice'),
    ('p,q\n"one"two,3\n', {}, 'malformed quotes in record: "one"two,3'),
    ("n\n10\nten\n", {"schema": "n long"}, "line 3, column 1: invalid integer `ten`"),
    ("n,d\n1,2020-02-30\n", {"schema": "n long, d date"}, "line 2, column 2: invalid date `2020-02-30`"),
    ("b\nmaybe\n", {"schema": "b boolean"}, "line 2, column 1: invalid boolean `maybe`"),
    ("x\n1.5.2\n", {"schema": "x double"}, "line 2, column 1: invalid number `1.5.2`"),
)


def csv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(text, message_of(lambda t=text, o=options: read_csv(spark, csv_file(spark, t.rstrip("\n")), **o).collect()).message) for text, options, _ in CSV_ERRORS], "text string, message string")


def csv_written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir).sql("select n_nationkey, case when n_nationkey % 4 = 0 then null when n_nationkey % 4 = 1 then '' else 'a \"' || n_name || '\", b' end as s, n_nationkey * 0.25 as x from nation order by n_nationkey")
    return spark.createDataFrame([(i, line) for i, line in enumerate(csv_lines(df))], "n long, line string")


# Parquet


def parquet_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow integers, floats and decimals of a file as the dialect's types."""
    path, made = scratch(spark, "types") + ".parquet", Engine(spark)
    spark.sql("select cast(id as tinyint) as a, cast(id * 2 as smallint) as b, cast(id * 3 as int) as c, cast(id / 4 as float) as d, cast(id / 8 as decimal(12, 3)) as e, concat('t', id) as F, id % 2 = 0 as g, date_add(date'2020-01-01', cast(id as int)) as h from range(20)").write.parquet(path)
    made.load("t", path)
    return made.sql("select a, b + c as bc, d, e, f, g, h from t where c < 60 and e <> 99")


def parquet_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that have no counterpart are named."""
    made = Engine(spark)
    tests = ("array(1, 2)", "map('a', 1)", "named_struct('x', 1)", "x'00ff'")
    rows = [(t, message_of(lambda t=t: made.register("n", made.spark.sql(f"select 1 as id, {t} as odd"))).message) for t in tests]
    return spark.createDataFrame(rows, "value string, message string")


# generated tables

SCALE = 0.005


def generated(spark: SparkSession) -> Engine:
    out = Engine(spark)
    out.tpch(SCALE)
    return out


def tpch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generated(spark)
    tables = [t for t in SCHEMAS if t != "lineitem"]
    return made.sql("select 'lines of an order' as name, min(n) as least, max(n) as most from (select l_orderkey, count(*) as n from lineitem group by l_orderkey) x").unionAll(
        made.spark.createDataFrame([(t, made.rows(f"select count(*) from {t}")[0][0]) for t in tables], "name string, least long").withColumn("most", F.col("least"))
    )


def tpch_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generated(spark)
    return spark.createDataFrame([(t, n, k) for t in SCHEMAS for n, k in made.columns(t)], "name string, col string, type string")


#: Rule of the generated tables -> how often it is broken.
TPCH_RULES = {
    "a part has a supplier twice": "select count(*) from (select ps_partkey from partsupp group by ps_partkey having count(*) <> count(distinct ps_suppkey) or count(*) <> 4) x",
    "a line's supplier does not sell its part": "select count(*) from lineitem where not exists (select 1 from partsupp where ps_partkey = l_partkey and ps_suppkey = l_suppkey)",
    "a customer divisible by three has orders": "select count(*) from orders where o_custkey % 3 = 0",
    "an order's customer is not there": "select count(*) from orders where o_custkey not in (select c_custkey from customer)",
    "a line ships before its order": "select count(*) from lineitem join orders on l_orderkey = o_orderkey where l_shipdate <= o_orderdate or l_receiptdate <= l_shipdate",
    "an order's status is not its lines'": "select count(*) from orders o where (o_orderstatus = 'F') <> (not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O'))",
    "an order's price is not its lines'": "select count(*) from orders o join (select l_orderkey, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) as total from lineitem group by l_orderkey) l on o_orderkey = l_orderkey where abs(total - o_totalprice) > 0.011",
    "a received line is not returned or accepted": "select count(*) from lineitem where (l_returnflag = 'N') <> (l_receiptdate > date '1995-06-17')",
}


def tpch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generated(spark)
    return spark.createDataFrame([(rule, made.rows(q)[0][0]) for rule, q in TPCH_RULES.items()], "rule string, broken long")


def tpch_partsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark).sql("select ps_partkey, ps_suppkey, p_retailprice from partsupp join part on ps_partkey = p_partkey")


def tpch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's own texts run; each gives rows."""
    made = generated(spark)
    return spark.createDataFrame([(n, bool(made.rows(text))) for n, text in TEXTS.items()], "query long, found boolean")


# errors

#: (statement, message, SQLSTATE)
STATEMENT_ERRORS = (
    ("select salary, max(hired) from emp", 'column "emp.salary" must appear in the GROUP BY clause or be used in an aggregate function', "42803"),
    ("select dept_id + 1, count(*) from emp group by dept_id + 2", 'column "emp.dept_id" must appear in the GROUP BY clause or be used in an aggregate function', "42803"),
    ("select name from emp having count(*) > 1", 'column "emp.name" must appear in the GROUP BY clause or be used in an aggregate function', "42803"),
    ("select id from emp where max(salary) > 5", "aggregate functions are not allowed in WHERE", "42803"),
    ("select 1 from emp e join dept d on count(*) = d.id", "aggregate functions are not allowed in JOIN conditions", "42803"),
    ("select count(*) from emp group by min(id)", "aggregate functions are not allowed in GROUP BY", "42803"),
    ("select avg(sum(salary)) from emp", "aggregate function calls cannot be nested", "42803"),
    ("select dept_id, (select d.name from dept d where d.budget = e.salary) from emp e group by dept_id", 'subquery uses ungrouped column "e.salary" from outer query', "42803"),
    ("select distinct name from emp order by hired", "for SELECT DISTINCT, ORDER BY expressions must appear in select list", "42P10"),
    ("select distinct dept_id, name from emp order by upper(name)", "for SELECT DISTINCT, ORDER BY expressions must appear in select list", "42P10"),
    ("select id from emp where name in (select budget from dept)", "operator does not exist: VARCHAR = BIGINT", "42883"),
    ("select id from emp where salary * 1.5 not in (select budget from dept)", "operator does not exist: DOUBLE = BIGINT", "42883"),
    ("select id from emp where hired in (select name from dept)", "operator does not exist: DATE = VARCHAR", "42883"),
    ("select id from emp where id in (select id, name from dept)", "subquery must return only one column", "42601"),
    ("select wages from emp", 'column "wages" does not exist', "42703"),
    ("select id from staff", 'relation "staff" does not exist', "42P01"),
    ("select name from emp, dept", 'column reference "name" is ambiguous', "42702"),
    ("select lower(id) from emp", "function lower(BIGINT) does not exist", "42883"),
    ("select cast(hired as double) from emp", "cannot cast type DATE to DOUBLE", "42846"),
    ("select id from emp limit -1", "LIMIT must be an integer literal, got -1", "42601"),
)
#: (expression, message, SQLSTATE)
VALUE_ERRORS = (
    ("cast('12x' as bigint)", 'invalid input syntax for type bigint: "12x"', "22P02"),
    ("cast('1,5' as double)", 'invalid input syntax for type double: "1,5"', "22P02"),
    ("cast('2023-13-01' as date)", 'invalid input syntax for type date: "2023-13-01"', "22P02"),
    ("cast('2023-1-05' as date)", 'invalid input syntax for type date: "2023-1-05"', "22P02"),
    ("cast(upper('perhaps') as boolean)", 'invalid input syntax for type boolean: "perhaps"', "22P02"),
    ("cast(4e18 * 4 as bigint)", "bigint out of range", "22003"),
    ("9000000000000000000 * 2", "bigint out of range", "22003"),
    ("17 / (3 - 3)", "division by zero", "22012"),
    ("17 % 0", "division by zero", "22012"),
    ("substring('some text' from 3 for 0 - 2)", "negative substring length not allowed", "22011"),
    ("(select salary from emp where dept_id = 2)", "more than one row returned by a subquery used as an expression", "21000"),
)
#: (statement, message, offset)
PARSE_ERRORS = (
    ("select id nam e from t", "expected end of statement, found `e`", 14),
    ("select , x", "expected an expression, found `,`", 7),
    ("select 'open", "unterminated string", 7),
    ("select 77up", "invalid number `77up`", 7),
    ("select cast(x as jsonb)", "unknown data type `jsonb`", 17),
    ("delete from t", "expected SELECT, found `delete`", 0),
    ("select x # y", "unexpected character `#`", 9),
)


def statement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = demo(spark)
    found = [(q, message_of(lambda q=q: made.bind(q))) for q, _, _ in STATEMENT_ERRORS]
    return spark.createDataFrame([(q, e.message, e.state) for q, e in found], "statement string, message string, state string")


def value_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = demo(spark)
    found = [(x, message_of(lambda x=x: made.rows(f"select {x}"))) for x, _, _ in VALUE_ERRORS]
    return spark.createDataFrame([(x, e.message, e.state) for x, e in found], "expression string, message string, state string")


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(q, message_of(lambda q=q: parse_statements(q))) for q, _, _ in PARSE_ERRORS]
    return spark.createDataFrame([(q, e.message, e.position) for q, e in found], "statement string, message string, position long")


# statements in other forms


def printed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered text, printed and parsed again, is the same tree."""
    return spark.createDataFrame([(name, parse_query(str(parse_query(text))) == parse_query(text)) for name, (text, _) in QUERIES.items()], "name string, same boolean")


def printed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(str(parse_query(QUERIES["tpch_q8"][0])))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [literal("150000.5", 701), literal("F", 25), literal("1997-06-30", 1082), literal("7", 20), None]
    tree = parse_query("select o_orderkey, o_custkey % $4 as r, coalesce($5, $2) as s from orders where o_totalprice > $1 and o_orderstatus = $2 and o_orderdate < $3")
    return engine(spark, sf_dir).sql(substituted(tree, given))


def with_strategy(name: str, hash_join: bool, optimize: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = Engine(spark).load_folder(sf_dir, ("customer", "orders", "lineitem", "nation", "region", "supplier", "part"))
        made.strategy(hash_join, optimize)
        return made.sql(QUERIES[name][0])

    return run


def compensated_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order 0.1, and two amounts that cancel; a plain sum would lose the small ones."""
    made = Engine(spark, strict_sums=True).load_folder(sf_dir, ("orders", "region"))
    return made.sql("select o_orderstatus, round(sum(case r_regionkey when 0 then 1e16 when 1 then 0.125 when 2 then -1e16 else 0 end), 6) as total from orders, region group by o_orderstatus")


# the shell and the server

#: (input, answer)
SHELL = (
    (r"\d dept", "id BIGINT\nname VARCHAR\nbudget BIGINT"),
    (r"\d", "dept\nemp"),
    (r"\ast select Name from emp where ID=3", "SELECT name FROM emp WHERE id = 3"),
    (r"\plan select dept_id, count(*) as n from emp e where salary > 5 group by dept_id order by n limit 2", "Limit 2\n  Sort n\n    Project dept_id BIGINT, n BIGINT\n      Aggregate by dept_id: count(*)\n        Filter salary > 5\n          Scan emp as e"),
    (r"\hashjoin", "hashjoin is off"),
    (r"\optimize", "optimize is off"),
    ("select name, budget from dept where id > 2 order by id;", "   name   | budget\n----------+--------\n Research | 350000\n Legal    |   NULL\n(2 rows)"),
    ("select budgets from dept;", 'ERROR: column "budgets" does not exist\nselect budgets from dept;\n       ^'),
    (r"\d nothing", "no table nothing"),
)


def shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Shell(demo(spark))
    return spark.createDataFrame([(i, line, made.execute(line)) for i, (line, _) in enumerate(SHELL)], "n long, input string, answer string")


def plan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = engine(spark, sf_dir).explain(QUERIES["tpch_q3"][0])
    return spark.createDataFrame([(word, word in text) for word in ("Physical Plan", "TakeOrderedAndProject", "PushedFilters", "CartesianProduct")], "word string, there boolean")


def sent(session: Session, kind: bytes, body: bytes = b"") -> Iterator[tuple[str, bytes]]:
    """The messages that answer one, as they come: each part of a reply is whole messages."""
    for part in session.handle(kind, body):
        at = 0
        while at < len(part):
            end = at + 1 + struct.unpack_from("!i", part, at + 1)[0]
            yield part[at : at + 1].decode(), part[at + 5 : end]
            at = end


def columns_of(body: bytes) -> list[str | None]:
    out, at = [], 2
    for _ in range(struct.unpack("!h", body[:2])[0]):
        size = struct.unpack("!i", body[at : at + 4])[0]
        out.append(None if size < 0 else body[at + 4 : at + 4 + size].decode())
        at += 4 + max(size, 0)
    return out


#: Rows of a reply that the driver holds at a time.
HELD = 100_000


def gathered(spark: SparkSession, messages: Iterator[tuple[str, bytes]], names: tuple[str, ...]) -> DataFrame:
    """The rows of a reply to one query, written portion by portion and read again. A reply that breaks off is an error."""
    schema, path, n, tag = ", ".join(f"{c} string" for c in names), scratch(spark, "served"), 0, None
    arrow = pa.schema([(c, pa.string()) for c in names])

    def rows() -> Iterator[list[str | None]]:
        nonlocal tag
        for kind, body in messages:
            if kind == "D":
                yield columns_of(body)
            elif kind == "E":
                found = {f[:1]: f[1:].decode() for f in body.split(b"\0")}
                raise SqlError(found[b"M"], found[b"C"])
            elif kind == "C":
                tag = body[:-1].decode()

    left = rows()
    while (some := list(islice(left, HELD))) or not n:
        portion = pa.Table.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)] or [pa.array([], pa.string())] * len(names), schema=arrow)
        spark.createDataFrame(portion, schema).write.mode("append").parquet(path)
        n += len(some)
        if not some:
            break
    if tag != f"SELECT {n}":
        raise SqlError(f"the reply ends with {tag!r} after {n} rows", "08P01")
    return spark.read.schema(schema).parquet(path)


def server_simple_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as a client gets them: text, NULLs apart."""
    session = Session(engine(spark, sf_dir))
    text = "select c_custkey, c_name, c_acctbal, c_acctbal > 5000 as rich, case when c_custkey % 5 = 0 then null else date '2024-02-28' + c_nationkey end as d from customer"
    return gathered(spark, sent(session, b"Q", text.encode() + b"\0"), ("c_custkey", "c_name", "c_acctbal", "rich", "d"))


def server_extended_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared statement with a parameter, fetched in batches until it is at its end."""
    session, rows = Session(engine(spark, sf_dir)), []
    text = b"select o_orderkey, o_totalprice from orders where o_custkey < $1"
    [*sent(session, b"P", b"q\0" + text + b"\0" + struct.pack("!hi", 1, 20))]
    [*sent(session, b"B", b"p\0q\0" + struct.pack("!hhhi", 1, 1, 1, 8) + struct.pack("!qh", 200, 0))]
    while True:
        got = [*sent(session, b"E", b"p\0" + struct.pack("!i", 100))]
        rows += [tuple(columns_of(b)) for k, b in got if k == "D"]
        if got[-1][0] != "s":
            break
    return spark.createDataFrame(rows, "o_orderkey string, o_totalprice string")


#: (statement, kinds of the answers, SQLSTATE of an error, state after it)
SERVER = (
    ("select 40 + 2; select 'x'", "TDCTDCZ", None, "I"),
    (" ; ", "IZ", None, "I"),
    ("start transaction", "CZ", None, "T"),
    ("select id from emp where id = 3", "TDCZ", None, "T"),
    ("select missing from emp", "EZ", "42703", "E"),
    ("select 1", "EZ", "25P02", "E"),
    ("rollback", "CZ", None, "I"),
    ("set search_path = x", "CZ", None, "I"),
    ("select 5; selec 6", "TDCEZ", "42601", "I"),
    ("select id / (id - id) from emp", "EZ", "22012", "I"),
)


def server_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, rows = Session(demo(spark)), []
    for i, (text, *_) in enumerate(SERVER):
        got = [*sent(session, b"Q", text.encode() + b"\0")]
        state = next((f[1:].decode() for k, b in got if k == "E" for f in b.split(b"\0") if f[:1] == b"C"), None)
        rows.append((i, text, "".join(k for k, _ in got), state, got[-1][1].decode()))
    return spark.createDataFrame(rows, "n long, statement string, kinds string, code string, state string")


def server_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OIDs and sizes of a result's columns."""
    text = b"select id, name, salary * 0.5 as half, hired, salary > 5 as t, null as nothing from emp where id < 0\0"
    body, rows, at = next(b for k, b in sent(Session(demo(spark)), b"Q", text) if k == "T"), [], 2
    while at < len(body):
        end = body.index(b"\0", at)
        oid, size = struct.unpack("!ih", body[end + 7 : end + 13])
        rows.append((body[at:end].decode(), oid, size))
        at = end + 19
    return spark.createDataFrame(rows, "name string, oid long, size long")


def cases() -> dict[str, Case]:
    """name -> (query, DuckDB SQL)."""
    s = SCALE
    sizes = [("supplier", 10_000 * s), ("part", 200_000 * s), ("partsupp", 800_000 * s), ("customer", 150_000 * s), ("orders", 1_500_000 * s), ("region", 5), ("nation", 25)]
    suppliers, parts = round(10_000 * s), round(200_000 * s)
    same = select_sql()
    return {
        "csv_round_trip": (csv_round_trip, "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as date) as o_orderdate, o_totalprice > 200000 as big from orders"),
        "csv_text_round_trip": (csv_text_round_trip, "select doc_id, text, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '' else lang end as lang from documents"),
        "csv_quoting": (
            csv_case('id,note\n1,"semi;colon, comma"\n2,"said ""so"" twice"\n3,"two\nlines"\n4,plain\n5," kept "'),
            values("id, note", [(1, "semi;colon, comma"), (2, 'said "so" twice'), (3, "two\nlines"), (4, "plain"), (5, " kept ")]),
        ),
        "csv_null_and_empty": (csv_case('id,a,b\n1,,""\n2,"",\n\n3,x,y'), values("id, a, b", [(1, None, ""), (2, "", None), (3, "x", "y")])),
        "csv_inference": (csv_types, values("name, type", [("whole", "bigint"), ("real", "double"), ("mixed", "double"), ("day", "date"), ("flag", "boolean"), ("code", "string"), ("words", "string"), ("none", "string")])),
        "csv_trailing_delimiter": (csv_case("4|north|0.5|\n5|south|7|\n", delimiter="|", header=False), values("column1, column2, column3", [(4, "north", 0.5), (5, "south", 7.0)])),
        "csv_names": (csv_case(" Id , ,Third Col\n1,2,3"), values('id, column2, "third col"', [(1, 2, 3)])),
        "csv_declared_types": (csv_case("n,x,b,s\n7, 2.5 ,TRUE,0042\n-8,inf,f,", schema="n long, x double, b boolean, s string"), values("n, x, b, s", [(7, 2.5, True, "0042")]) + " union all select -8, 'inf'::double, false, null"),
        "csv_errors": (csv_errors, values("text, message", [(t, m) for t, _, m in CSV_ERRORS])),
        "csv_written_lines": (
            csv_written_lines,
            """select 0::bigint as n, 'n_nationkey,s,x' as line union all
               select n_nationkey + 1, n_nationkey || ',' || case n_nationkey % 4 when 0 then '' when 1 then '""' else '"a ""' || n_name || '"", b"' end || ',' || regexp_replace((n_nationkey * 0.25::double)::varchar, '\\.0$', '') from nation""",
        ),
        "parquet_types": (parquet_types, "select i as a, i * 5 as bc, (i / 4.0)::double as d, (i / 8.0)::double as e, 't' || i as f, i % 2 = 0 as g, cast(date '2020-01-01' + cast(i as integer) as date) as h from range(20) r(i)"),
        "parquet_refusals": (
            parquet_refusals,
            values("value, message", [(v, f'column "odd" of table "n": type {t} is not supported') for v, t in (("array(1, 2)", "array<int>"), ("map('a', 1)", "map<string,int>"), ("named_struct('x', 1)", "struct<x:int>"), ("x'00ff'", "binary"))]),
        ),
        "tpch_counts": (tpch_counts, values("name, least, most", [("lines of an order", 1, 7), *((t, round(n), round(n)) for t, n in sizes)])),
        "tpch_schemas": (
            tpch_schemas,
            values("name, col, type", [(t, *c.split()) for t, columns in SCHEMAS.items() for c in columns.replace(" long", " BIGINT").replace(" string", " VARCHAR").replace(" double", " DOUBLE").replace(" date,", " DATE,").split(", ")]),
        ),
        "tpch_rules": (tpch_rules, values("rule, broken", [(r, 0) for r in TPCH_RULES])),
        "tpch_partsupp": (
            tpch_partsupp,
            f"""select p as ps_partkey, (p + i * case when 3 * step < {suppliers} then step else 1 end) % {suppliers} + 1 as ps_suppkey, (90000 + (p // 10) % 20001 + 100 * (p % 1000)) / 100.0::double as p_retailprice
                from (select p, {suppliers // 4} + (p - 1) // {suppliers} as step from range(1, {parts + 1}) r(p)) x, range(4) s(i)""",
        ),
        "tpch_texts": (tpch_texts, values("query, found", [(n, True) for n in TEXTS])),
        "demo_emp": (lambda spark, sf_dir: demo(spark).sql("select e.name, d.name as dept, e.salary, e.hired, m.name as manager from emp e left join dept d on e.dept_id = d.id left join emp m on e.manager_id = m.id"), demo_sql()),
        "statement_errors": (statement_errors, values("statement, message, state", list(STATEMENT_ERRORS))),
        "value_errors": (value_errors, values("expression, message, state", list(VALUE_ERRORS))),
        "parse_errors": (parse_errors, values("statement, message, position", list(PARSE_ERRORS))),
        "printed_statements": (printed_statements, values("name, same", [(n, True) for n in QUERIES])),
        "printed_query": (printed_query, same["tpch_q8"]),
        "parameters": (parameters, "select o_orderkey, o_custkey % 7 as r, 'F' as s from orders where o_totalprice > 150000.5 and o_orderstatus = 'F' and orders.o_orderdate < date '1997-06-30'"),
        "sort_merge_joins": (with_strategy("tpch_q8", False, True), same["tpch_q8"]),
        "without_optional_rules": (with_strategy("full_join_residual", True, False), same["full_join_residual"]),
        "compensated_sums": (compensated_sums, "select o_orderstatus, round(count(*) * 0.125::double, 6) as total from orders group by o_orderstatus"),
        "shell": (shell, values("n, input, answer", [(i, a, b) for i, (a, b) in enumerate(SHELL)])),
        "plan_text": (plan_text, values("word, there", [("Physical Plan", True), ("TakeOrderedAndProject", True), ("PushedFilters", True), ("CartesianProduct", False)])),
        "server_simple_query": (
            server_simple_query,
            """select c_custkey::varchar as c_custkey, c_name, regexp_replace(c_acctbal::varchar, '\\.0$', '') as c_acctbal, case when c_acctbal > 5000 then 't' else 'f' end as rich,
               case when c_custkey % 5 = 0 then null else cast(date '2024-02-28' + cast(c_nationkey as integer) as varchar) end as d from customer""",
        ),
        "server_extended_query": (server_extended_query, "select o_orderkey::varchar as o_orderkey, regexp_replace(o_totalprice::varchar, '\\.0$', '') as o_totalprice from orders where o_custkey < 200"),
        "server_conversation": (server_conversation, values("n, statement, kinds, code, state", [(i, *r) for i, r in enumerate(SERVER)])),
        "server_types": (server_types, values("name, oid, size", [("id", 20, 8), ("name", 25, -1), ("half", 701, 8), ("hired", 1082, 4), ("t", 16, 1), ("nothing", 25, -1)])),
    }


def demo_sql() -> str:
    from ..sources.demo import DEPT, EMP

    return f"""with dept as ({values('id, name, budget', DEPT)}), emp as ({values('id, name, dept_id, salary, hired, manager_id', EMP)})
select e.name, d.name as dept, salary, cast(hired as date) as hired, m.name as manager from emp e left join dept d on dept_id = d.id left join (select id as mid, name from emp) m on e.manager_id = m.mid"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in cases().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in cases().items()}
