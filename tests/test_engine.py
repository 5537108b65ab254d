"""Semantics of expressions, joins, aggregates and subqueries on small tables."""

import datetime

import pytest

from lakemill.errors import SqlError

D = datetime.date

VALUES = {
    "8 - 3 * 2": 2, "29 / 6": 4, "-29 / 6": -4, "-29 % 6": -5, "29 / 8.0": 3.625, "3 - 0.25": 2.75, "5 * NULL": None, "NULL <> 4": None, "lower(NULL)": None, "coalesce(NULL, NULL, 'q', 'r')": "q", "coalesce(NULL, 2, 1.5)": 2.0,
    "NULL AND FALSE": False, "NULL AND TRUE": None, "NULL OR TRUE": True, "NULL OR FALSE": None, "NOT (1 > NULL)": None, "FALSE AND 3 / 0 > 1": False, "TRUE OR 3 % 0 > 1": True,
    "9 IN (8, NULL)": None, "8 IN (8, NULL)": True, "9 NOT IN (8, 7)": True, "8 NOT IN (8, NULL)": False, "3 IN (2.5, 3.0)": True, "0.3 BETWEEN 0.1 + 0.1 AND 0.4": True, "7 NOT BETWEEN 8 AND 9": True, "4 = 4.0": True,
    "'blue green blue' LIKE '%green%'": True, "'pqr' LIKE 'p_'": False, "'pqr' NOT LIKE '_q_'": False, "'x' LIKE NULL": None, r"'5_0' LIKE '5\_0'": True, r"'510' LIKE '5\_0'": False, r"'kzm' LIKE 'k\zm'": True, r"'u\v' LIKE 'u\\v'": True, "'' LIKE '%'": True,
    "CASE WHEN NULL THEN 'a' WHEN TRUE THEN 'b' END": "b", "CASE 3 WHEN 2 THEN 'two' WHEN 3 THEN 'three' END": "three", "CASE NULL WHEN NULL THEN 1 END": None, "CASE WHEN 2 > 1 THEN 7 ELSE 7 % 0 END": 7, "CASE WHEN FALSE THEN 4 ELSE 0.5 END": 0.5,
    "CAST('-017' AS BIGINT)": -17, "CAST('  .5' AS DOUBLE)": 0.5, "CAST(6.5 AS INTEGER)": 7, "CAST(-6.5 AS INTEGER)": -7, "CAST(-81 AS VARCHAR)": "-81", "CAST('2019-08-30' AS DATE)": D(2019, 8, 30), "CAST('On' AS BOOLEAN)": True, "CAST('n' AS BOOLEAN)": False, "CAST(0 AS BOOLEAN)": False, "CAST(TRUE AS BIGINT)": 1,
    "CAST(12.0 AS VARCHAR)": "12", "CAST(2.5e11 AS VARCHAR)": "250000000000", "CAST(0.00000325 AS VARCHAR)": "0.00000325", "CAST(0.7 AS VARCHAR)": "0.7", "CAST(1 > 2 AS VARCHAR)": "false", "CAST(CAST('-Infinity' AS DOUBLE) AS VARCHAR)": "-inf", "CAST(DATE '2001-02-03' AS VARCHAR)": "2001-02-03",
    "DATE '2023-05-10' - INTERVAL '40' DAY": D(2023, 3, 31), "DATE '2023-03-31' - INTERVAL '1' MONTH": D(2023, 2, 28), "DATE '2020-02-29' + INTERVAL '1' YEAR": D(2021, 2, 28), "DATE '2023-12-25' - DATE '2023-11-25'": 30, "DATE '2023-12-30' + 3": D(2024, 1, 2), "5 + DATE '2023-12-30'": D(2024, 1, 4), "DATE '2023-01-04' - 4": D(2022, 12, 31),
    "DATE '2023-10-31' + (INTERVAL '4' MONTH + INTERVAL '2' DAY)": D(2024, 3, 2), "INTERVAL '2' MONTH < INTERVAL '61' DAY": True, "INTERVAL '2' YEAR + INTERVAL '5' DAY": "24 mons 5 days", "INTERVAL '0' DAY": "0 days", "EXTRACT(DAY FROM DATE '2011-11-23')": 23, "EXTRACT(YEAR FROM DATE '2011-11-23')": 2011, "DATE '2011-11-23' >= '2011-11-22'": True,
    "substring('lighthouse' FROM 6 FOR 3)": "hou", "substring('lighthouse', 8)": "use", "substring('lighthouse', -1, 4)": "li", "substring('lighthouse', -9, 5)": "", "substring('lighthouse', 20)": "", "substring('lighthouse', 6, 4000000000)": "house", "substring('lighthouse', length('abcdef'), 2)": "ho", "substring('lighthouse', 3 - 5, length('abcde'))": "li", "substring('lighthouse', NULL, 2)": None,
    "lower('MiXeD') || upper('tail')": "mixedTAIL", "7 || '-' || 0.25 || TRUE": "7-0.25true", "length('żółw')": 4, "char_length('')": 0, "abs(3 - 8)": 5, "abs(-0.75)": 0.75, "round(-3.5)": -4.0, "round(9.8765, 3)": 9.877, "round(8765.4, -3)": 9000.0, "round(17)": 17.0, "9223372036854775807": 9223372036854775807, "9300000000000000000": 9.3e18, "(SELECT 'none' WHERE 1 > 2)": None,
    r"'tab\t'": "tab\\t",
}


def test_expressions(demo):
    rows = demo.rows("SELECT " + ", ".join(f"{e} AS v{i}" for i, e in enumerate(VALUES)))
    for (e, want), got in zip(VALUES.items(), rows[0], strict=True):
        assert got == want and type(got) is type(want), e


@pytest.mark.parametrize(
    ("expr", "message", "state"),
    [
        ("45 / (9 - 9)", "division by zero", "22012"),
        ("4.5 / 0", "division by zero", "22012"),
        ("45 % 0", "division by zero", "22012"),
        ("-9223372036854775807 - 2", "bigint out of range", "22003"),
        ("CAST(5e200 AS BIGINT)", "bigint out of range", "22003"),
        ("CAST('forty' AS BIGINT)", 'invalid input syntax for type bigint: "forty"', "22P02"),
        ("CAST('2021-06-31' AS DATE)", 'invalid input syntax for type date: "2021-06-31"', "22P02"),
        ("CAST('21-06-01' AS DATE)", 'invalid input syntax for type date: "21-06-01"', "22P02"),
        ("CAST('0x1f' AS DOUBLE)", 'invalid input syntax for type double: "0x1f"', "22P02"),
        ("CAST('perhaps' AS BOOLEAN)", 'invalid input syntax for type boolean: "perhaps"', "22P02"),
        ("substring('word', 2, length('') - 3)", "negative substring length not allowed", "22011"),
        ("substring('word', 2, -3)", "negative substring length not allowed", "22011"),
        ("(SELECT hired FROM emp)", "more than one row returned by a subquery used as an expression", "21000"),
        ("TRUE = 1", "operator does not exist: BOOLEAN = BIGINT", "42883"),
        ("2.5 || 3", "operator does not exist: DOUBLE || BIGINT", "42883"),
        ("length(12)", "function length(BIGINT) does not exist", "42883"),
        ("median(1)", "function median does not exist", "42883"),
        ("abs(1, 2)", "function abs expects 1 argument(s), got 2", "42883"),
        ("CAST(TRUE AS DOUBLE)", "cannot cast type BOOLEAN to DOUBLE", "42846"),
        ("EXTRACT(MINUTE FROM DATE '2011-11-23')", "EXTRACT(MINUTE) is not supported for DATE", "0A000"),
        ("NOT 'yes'", "argument of NOT must be type BOOLEAN, not type VARCHAR", "42804"),
        ("CASE WHEN TRUE THEN DATE '2011-11-23' ELSE 4 END", "CASE types DATE and BIGINT cannot be matched", "42804"),
        ("DATE '2011-13-01'", 'invalid input syntax for type date: "2011-13-01"', "22007"),
    ],
)
def test_expression_errors(demo, expr, message, state):
    with pytest.raises(SqlError) as e:
        demo.rows("SELECT " + expr)
    assert (e.value.message, e.value.state) == (message, state)


@pytest.mark.parametrize(
    ("sql", "message"),
    [
        ("SELECT wage FROM emp", 'column "wage" does not exist'),
        ("SELECT emp.wage FROM emp", "column emp.wage does not exist"),
        ("SELECT d.budget FROM emp", 'missing FROM-clause entry for table "d"'),
        ("SELECT d.* FROM dept", 'missing FROM-clause entry for table "d"'),
        ("SELECT name FROM dept, emp", 'column reference "name" is ambiguous'),
        ("SELECT 1 FROM dept d, emp d", 'table name "d" specified more than once'),
        ("SELECT 1 FROM staff", 'relation "staff" does not exist'),
        ("SELECT * WHERE TRUE", "SELECT * with no tables specified is not valid"),
        ("SELECT hired, max(id) FROM emp", 'column "emp.hired" must appear in the GROUP BY clause or be used in an aggregate function'),
        ("SELECT id FROM emp WHERE sum(id) > 1", "aggregate functions are not allowed in WHERE"),
        ("SELECT max(avg(id)) FROM emp", "aggregate function calls cannot be nested"),
        ("SELECT min(*) FROM emp", "min(*) is not valid"),
        ("SELECT avg(hired) FROM emp", "function avg(DATE) does not exist"),
        ("SELECT dept_id AS d FROM emp GROUP BY d", 'column "d" does not exist'),
        ("SELECT budget AS b, b / 2 FROM dept", 'column "b" does not exist'),
        ("SELECT id, name FROM emp ORDER BY 3", "ORDER BY position 3 is not in select list"),
        ("SELECT DISTINCT name FROM dept ORDER BY budget", "for SELECT DISTINCT, ORDER BY expressions must appear in select list"),
        ("SELECT id AS k, salary AS k FROM emp ORDER BY k", 'ORDER BY "k" is ambiguous'),
        ("SELECT 1 FROM (SELECT 7, 8) v (p, q, r)", 'table "v" has 2 columns available but 3 columns specified'),
        ("SELECT (SELECT budget, id FROM dept)", "subquery must return only one column"),
        ("SELECT 1 FROM dept OFFSET 0.5", "OFFSET must be a non-negative integer, got 0.5"),
        ("SELECT 1 FROM dept WHERE budget", "argument of WHERE must be type BOOLEAN, not type BIGINT"),
        ("SELECT hired IN (SELECT id FROM dept) FROM emp", "operator does not exist: DATE = BIGINT"),
        ("SELECT (SELECT max(d.id) FROM dept d WHERE d.budget > e.salary) FROM emp e GROUP BY dept_id", 'subquery uses ungrouped column "e.salary" from outer query'),
    ],
)
def test_binder_errors(demo, sql, message):
    with pytest.raises(SqlError) as e:
        demo.bind(sql)
    assert e.value.message == message


QUERIES = {
    "SELECT name FROM emp WHERE dept_id = 1 ORDER BY salary DESC": [("Ada",), ("Grace",), ("Linus",)],
    "SELECT d.name, count(e.id) AS n, sum(salary) FROM dept d LEFT JOIN emp e ON e.dept_id = d.id GROUP BY d.name ORDER BY n DESC, d.name": [("Engineering", 3, 497000), ("Sales", 2, 203000), ("Research", 1, 160000), ("Legal", 0, None)],
    "SELECT e.name, m.name FROM emp e LEFT JOIN emp m ON e.manager_id = m.id ORDER BY e.id LIMIT 3": [("Ada", None), ("Grace", "Ada"), ("Linus", "Ada")],
    "SELECT e.name, d.name FROM emp e FULL JOIN dept d ON e.dept_id = d.id WHERE e.id IS NULL OR d.id IS NULL ORDER BY 1": [("Margaret", None), (None, "Legal")],
    "SELECT dept_id, count(*) FROM emp GROUP BY dept_id ORDER BY dept_id": [(1, 3), (2, 2), (3, 1), (None, 1)],
    "SELECT dept_id FROM emp GROUP BY dept_id ORDER BY dept_id DESC": [(None,), (3,), (2,), (1,)],
    "SELECT name FROM emp ORDER BY manager_id NULLS FIRST, name LIMIT 2": [("Ada",), ("Edsger",)],
    "SELECT count(*), sum(salary), avg(salary), min(name) FROM emp WHERE id < 0": [(0, None, None, None)],
    "SELECT count(*) FROM emp GROUP BY 1": [(7,)],
    "SELECT count(*) FROM emp WHERE FALSE GROUP BY dept_id": [],
    "SELECT 1 FROM emp HAVING count(*) > 100": [],
    "SELECT count(DISTINCT dept_id), count(dept_id), count(*) FROM emp": [(3, 6, 7)],
    "SELECT name FROM emp WHERE dept_id NOT IN (SELECT id FROM dept WHERE budget > 300000) ORDER BY id": [("Ken",), ("Barbara",)],
    "SELECT name FROM emp WHERE dept_id NOT IN (SELECT dept_id FROM emp)": [],
    "SELECT name FROM emp WHERE manager_id NOT IN (SELECT id FROM dept WHERE FALSE) ORDER BY id LIMIT 1": [("Ada",)],
    "SELECT name FROM emp e WHERE salary > (SELECT avg(salary) FROM emp i WHERE i.dept_id = e.dept_id) ORDER BY id": [("Ada",), ("Grace",), ("Barbara",)],
    "SELECT name, (SELECT count(*) FROM emp m WHERE m.manager_id = e.id) AS reports FROM emp e ORDER BY reports DESC, name LIMIT 2": [("Ada", 2), ("Ken", 1)],
    "SELECT name FROM emp e WHERE EXISTS (SELECT 1 FROM dept d WHERE d.id = e.dept_id AND EXISTS (SELECT 1 FROM emp f WHERE f.dept_id = d.id AND f.salary > e.salary)) ORDER BY 1": [("Grace",), ("Ken",), ("Linus",)],
    "SELECT name FROM dept d WHERE NOT EXISTS (SELECT 1 FROM emp e WHERE e.dept_id = d.id AND NOT EXISTS (SELECT 1 FROM emp f WHERE f.manager_id = e.id AND f.dept_id = d.id)) ORDER BY 1": [("Legal",)],
    "SELECT name FROM emp e WHERE salary = (SELECT max(salary) FROM emp i WHERE i.dept_id IN (SELECT id FROM dept WHERE id = e.dept_id)) ORDER BY 1": [("Ada",), ("Barbara",), ("Edsger",)],
    "SELECT n, count(*) FROM (SELECT dept_id, count(*) FROM emp GROUP BY dept_id) AS t (d, n) GROUP BY n ORDER BY n": [(1, 2), (2, 1), (3, 1)],
    "SELECT k, v FROM (SELECT id, name FROM dept) t (k) JOIN (SELECT 1 AS v) u ON u.v = t.k": [(1, 1)],
    "SELECT name, salary FROM emp ORDER BY hired OFFSET 2 LIMIT 2": [("Ada", 185000), ("Grace", 172000)],
    "SELECT DISTINCT dept_id FROM emp ORDER BY dept_id": [(1,), (2,), (3,), (None,)],
    "SELECT a.id, b.id FROM a LEFT JOIN b ON a.k = b.k AND a.v < b.v ORDER BY 1, 2": [(1, 10), (2, None), (3, None), (4, 7), (4, 10), (5, None)],
    "SELECT a.id, b.id FROM a RIGHT JOIN b ON a.k = b.k AND b.v > 5 ORDER BY 2, 1": [(None, 7), (5, 8), (None, 9), (1, 10), (4, 10)],
    "SELECT dept_id, (SELECT d.name FROM dept d WHERE d.id = e.dept_id) AS dept, count(*) AS n FROM emp e GROUP BY dept_id ORDER BY n DESC, dept_id": [(1, "Engineering", 3), (2, "Sales", 2), (3, "Research", 1), (None, None, 1)],
    "SELECT dept_id + 1, sum(salary) FROM emp e GROUP BY dept_id + 1, dept_id HAVING EXISTS (SELECT 1 FROM dept WHERE id = dept_id AND budget > 250000) AND count(*) > (SELECT count(*) FROM dept x WHERE x.id = dept_id) ORDER BY 1": [(2, 497000)],
    "SELECT count(*), (SELECT count(*) FROM dept d WHERE d.id < e.dept_id) FROM emp e GROUP BY dept_id HAVING count(*) > 1 ORDER BY 2": [(3, 0), (2, 1)],
    "SELECT a.id FROM a WHERE a.v > 5 OR EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.v = 2) ORDER BY 1": [(1,), (3,), (4,), (5,)],
}


@pytest.mark.parametrize("sql", QUERIES)
def test_queries(demo, sql):
    assert demo.rows(sql) == QUERIES[sql]


def test_output_names_and_types(demo):
    q = demo.bind("SELECT name, upper(name), CAST(id AS DOUBLE), EXTRACT(YEAR FROM hired), CASE WHEN TRUE THEN 1 END, EXISTS (SELECT 1), id + 1, NULL FROM emp")
    assert q.columns == [("name", "VARCHAR"), ("upper", "VARCHAR"), ("id", "DOUBLE"), ("extract", "BIGINT"), ("case", "BIGINT"), ("exists", "BOOLEAN"), ("?column?", "BIGINT"), ("?column?", "VARCHAR")]
    assert demo.sql("SELECT id, id FROM emp").columns == ["id", "id"]


def test_strategies_agree(demo):
    for hash_join, optimize in ((False, True), (True, False), (True, True)):
        demo.strategy(hash_join, optimize)
        assert demo.rows("SELECT e.name FROM emp e JOIN dept d ON e.dept_id = d.id WHERE budget > 300000 ORDER BY 1") == [("Ada",), ("Edsger",), ("Grace",), ("Linus",)]


def test_compensated_sums(spark):
    from lakemill.engine import Engine

    values = [("a", x) for x in (1e16, 1.0, -1e16, 0.25)] + [("b", 0.1)] * 10 + [("c", None), ("d", float("inf")), ("d", 1.0)] + [("e", 2.0), ("e", 2.0), ("e", 3.0)]
    for strict in (True, False):
        engine = Engine(spark, strict_sums=strict)
        engine.register("t", engine.spark.createDataFrame(values, "g string, x double").coalesce(1))
        got = {r[0]: r[1:] for r in engine.rows("select g, sum(x), avg(x), sum(distinct x), count(*) from t group by g")}
        assert (got["a"][0], got["b"][0]) == ((1.25, 1.0) if strict else (0.25, 0.9999999999999999))
        assert got["c"] == (None, None, None, 1) and got["d"][0] == float("inf") and got["e"] == (7.0, 7 / 3, 5.0, 3)
    assert Engine(spark, strict_sums=True).rows("select sum(1.5) where false") == [(None,)]


def test_plain_arguments_stay_plain(demo):
    """Constant places give Spark's own function, casts of columns no lambda; so filters stay in generated code."""
    for sql in ("SELECT id FROM emp WHERE substring(name FROM 2 FOR 2) = 'da'", "SELECT substring(name, id) FROM emp", "SELECT CAST(name AS BIGINT), CAST(name AS DATE), CAST(name AS BOOLEAN) FROM emp"):
        assert "->" not in demo.bind(sql).sql
    assert "substring(t1.`name`, 2, 2)" in demo.bind("SELECT substring(name FROM 2 FOR 2) FROM emp").sql


def test_session_of_the_caller_is_untouched(spark, demo):
    assert spark.conf.get("spark.sql.groupByOrdinal") == "true"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lakemill")]
