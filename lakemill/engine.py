"""The engine: tables, and SQL text -> DataFrame."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S

from .errors import BindError, translated
from .functions import types as T
from .plans import ast as A
from .plans.binder import Query, bind, outlined
from .plans.parser import parse_query, parse_statements

#: Set on a session of the engine's own, so that the caller's session stays as it is.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.groupByOrdinal": "false",
    "spark.sql.groupByAliases": "false",
    "spark.sql.lateralColumnAlias.enableImplicitResolution": "false",
    "spark.sql.crossJoin.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}
#: Of the caller's session, these are taken over.
INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


#: Rules that a query is right without.
OPTIONAL = ("PushDownPredicates", "PushPredicateThroughJoin", "ColumnPruning", "ReorderJoin", "CostBasedJoinReorder", "ConstantFolding", "BooleanSimplification", "EliminateOuterJoin", "LimitPushDown", "CombineFilters")


def kind_of(t: S.DataType) -> str | None:
    """Type of a loaded column; None where it isn't supported."""
    if isinstance(t, S.IntegralType):
        return T.BIGINT
    if isinstance(t, S.FractionalType):
        return T.DOUBLE
    if isinstance(t, S.StringType | S.NullType | S.CharType | S.VarcharType):
        return T.VARCHAR
    return {S.BooleanType: T.BOOLEAN, S.DateType: T.DATE, S.TimestampNTZType: T.TIMESTAMP, S.TimestampType: T.TIMESTAMP}.get(type(t))


def normalized(df: DataFrame, source: str = "the table", skip: bool = False) -> DataFrame:
    """Columns as the types of the dialect, names in lower case. skip: leave unsupported columns out instead of failing."""
    columns, seen = [], set()
    for i, f in enumerate(df.schema):
        kind, name = kind_of(f.dataType), f.name.lower()
        if kind is None:
            if skip:
                continue
            raise BindError(f'column "{f.name}" of {source}: type {f.dataType.simpleString()} is not supported', "0A000")
        if name in seen:
            raise BindError(f'column "{name}" of {source} is there twice', "42701")
        seen.add(name)
        columns.append(df[df.columns[i]].cast(T.SPARK[kind].lower()).alias(name))
    return df.select(*columns)


class Result:
    """A bound statement: output names and types, and the DataFrame that computes it."""

    def __init__(self, query: Query, df: DataFrame) -> None:
        self.columns, self.df, self.sql = query.columns, df.toDF(*(n for n, _ in query.columns)), query.sql


class Engine:
    """strict_sums: sums and averages of DOUBLE are compensated, so rounding errors cancel; a group's values are then held
    together in one task. Without it they are plain sums, which are combined before they are shuffled."""

    def __init__(self, spark: SparkSession, strict_sums: bool = False) -> None:
        self.spark, self.strict_sums = spark.newSession(), strict_sums
        for k in INHERITED:
            if (v := spark.conf.get(k, None)) is not None:
                self.spark.conf.set(k, v)
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        self.tables: dict[str, tuple[str, list[tuple[str, str]]]] = {}
        self.ids = count(1)

    # tables

    def register(self, name: str, df: DataFrame, replace: bool = False, skip: bool = False) -> None:
        """A DataFrame of this engine's session (``engine.spark``) as a table."""
        if name in self.tables and not replace:
            raise BindError(f'relation "{name}" already exists', "42P07")
        df = normalized(df, f'table "{name}"', skip)
        view = f"lakemill_{next(self.ids)}"
        df.createOrReplaceTempView(view)
        self.tables[name] = (view, [(f.name, kind_of(f.dataType)) for f in df.schema])

    def load(self, name: str, path: str, replace: bool = False, **options) -> None:
        """A Parquet or CSV (.csv, .tbl) file or folder as a table, by its extension."""
        if path.rstrip("/").endswith(".parquet"):
            self.load_parquet(name, path, replace)
        else:
            self.load_csv(name, path, replace, **({"delimiter": "|", "header": False} if path.endswith(".tbl") else {}) | options)

    def load_parquet(self, name: str, path: str, replace: bool = False, skip: bool = False) -> None:
        self.register(name, self.spark.read.parquet(path), replace, skip)

    def load_csv(self, name: str, path: str, replace: bool = False, **options) -> None:
        from .sources.csv import read_csv

        self.register(name, read_csv(self.spark, path, **options), replace)

    def load_folder(self, sf_dir: str, names: tuple[str, ...]) -> Engine:
        for n in names:
            self.load_parquet(n, f"{sf_dir}/{n}.parquet", replace=True, skip=True)
        return self

    def tpch(self, scale: float) -> None:
        from .sources.tpch import generate

        for name, df in generate(self.spark, scale).items():
            self.register(name, df, replace=True)

    def demo(self) -> None:
        from .sources.demo import tables

        for name, df in tables(self.spark).items():
            self.register(name, df, replace=True)

    # statements

    def parse(self, text: str) -> A.Select:
        return parse_query(text)

    def bind(self, query: str | A.Select) -> Query:
        return bind(self.tables, parse_query(query) if isinstance(query, str) else query, self.strict_sums)

    def run(self, query: str | A.Select) -> Result:
        bound = self.bind(query)
        try:
            return Result(bound, self.spark.sql(bound.sql))
        except Exception as e:  # noqa: BLE001
            raise translated(e) from e

    def sql(self, query: str | A.Select) -> DataFrame:
        """Lazy; constant expressions may fail here already."""
        return self.run(query).df

    def script(self, text: str) -> list[DataFrame]:
        return [self.sql(q) for q in parse_statements(text)]

    def rows(self, query: str | A.Select) -> list[tuple]:
        try:
            return [tuple(r) for r in self.sql(query).collect()]
        except Exception as e:  # noqa: BLE001
            raise translated(e) from e

    def outline(self, query: str | A.Select) -> str:
        """The bound query, one step a line: what comes out, with types, above what it is made from."""
        tree = parse_query(query) if isinstance(query, str) else query
        return outlined(tree, self.bind(tree))

    def explain(self, query: str | A.Select, mode: str = "formatted") -> str:
        df = self.sql(query)
        return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def strategy(self, hash_join: bool = True, optimize: bool = True) -> None:
        """Hash joins or sort-merge joins only; Catalyst's optional rewrites or none of them. Results are the same."""
        self.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760" if hash_join else "-1")
        self.spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10485760" if hash_join else "-1")
        self.spark.conf.set("spark.sql.join.preferSortMergeJoin", "false" if hash_join else "true")
        self.spark.conf.set("spark.sql.optimizer.excludedRules", "" if optimize else ",".join(f"org.apache.spark.sql.catalyst.optimizer.{r}" for r in OPTIONAL))

    def columns(self, name: str) -> list[tuple[str, str]]:
        return self.tables[name][1]
