"""Interactive shell: ``python -m lakemill.repl``."""

from __future__ import annotations

import time

from .engine import Engine
from .errors import SqlError, translated
from .plans.parser import parse_query, parse_statements
from .present import grid

HELP = r"""\load NAME FILE   load a CSV, .tbl or Parquet file
\demo             load the tables emp and dept
\tpch [SCALE]     generate the TPC-H tables
\qN               run TPC-H query N (1, 3, 6, 8, 13, 22)
\d [TABLE]        list tables, or the columns of one
\ast SQL          canonical text of the syntax tree
\plan SQL         outline of the bound query
\sql SQL          the bound query as Spark SQL
\explain SQL      Spark's physical plan
\timing           show run times or not
\hashjoin         allow hash joins or not
\optimize         use the optimizer's optional rules or not
\q                leave"""


class Shell:
    def __init__(self, engine: Engine) -> None:
        self.engine, self.timing, self.hash_join, self.optimize = engine, False, True, True

    def execute(self, line: str) -> str | None:
        """The answer to one input; None to leave."""
        try:
            if line.startswith("\\"):
                return self.command(line)
            return "\n".join(self.query(q) for q in parse_statements(line))
        except Exception as e:  # noqa: BLE001
            error = translated(e)
            return "ERROR: " + (error.caret(line) if isinstance(error, SqlError) and not line.startswith("\\") else error.message)

    def query(self, tree) -> str:
        start = time.time()
        result = self.engine.run(tree)
        out = grid(result.columns, [tuple(r) for r in result.df.collect()])
        return out + (f"\nTime: {1000 * (time.time() - start):.1f} ms" if self.timing else "")

    def command(self, line: str) -> str | None:
        word, _, rest = line[1:].strip().partition(" ")
        rest = rest.strip().rstrip(";")
        on = lambda x: "on" if x else "off"
        if word in ("q", "quit"):
            return None
        if word == "load":
            name, _, path = rest.partition(" ")
            if not path:
                return r"usage: \load NAME FILE"
            self.engine.load(name, path.strip(), replace=True)
            return f"loaded {name}"
        if word == "demo":
            self.engine.demo()
            return "loaded emp, dept"
        if word == "tpch":
            self.engine.tpch(float(rest or 0.01))
            return "generated the TPC-H tables"
        if word[:1] == "q" and word[1:].isdigit():
            from .sources.tpch import TEXTS

            return self.query(parse_query(TEXTS[int(word[1:])])) if int(word[1:]) in TEXTS else f"there is no query {word[1:]}"
        if word == "d":
            if not rest:
                return "\n".join(sorted(self.engine.tables)) or "no tables"
            return "\n".join(f"{n} {t}" for n, t in self.engine.columns(rest)) if rest in self.engine.tables else f"no table {rest}"
        if word == "ast":
            return str(parse_query(rest))
        if word == "plan":
            return self.engine.outline(rest)
        if word == "sql":
            return self.engine.bind(rest).sql
        if word == "explain":
            return self.engine.explain(rest)
        if word == "timing":
            self.timing = not self.timing
            return f"timing is {on(self.timing)}"
        if word in ("hashjoin", "optimize"):
            if word == "hashjoin":
                self.hash_join = not self.hash_join
            else:
                self.optimize = not self.optimize
            self.engine.strategy(self.hash_join, self.optimize)
            return f"{word} is {on(self.hash_join if word == 'hashjoin' else self.optimize)}"
        return HELP


def main() -> None:
    from pyspark.sql import SparkSession

    shell, text = Shell(Engine(SparkSession.builder.appName("lakemill").getOrCreate())), ""
    while True:
        try:
            line = input("... " if text else "> ")
        except EOFError:
            return
        text = f"{text}\n{line}" if text else line
        if text.strip() and (text.startswith("\\") or text.rstrip().endswith(";")):
            answer = shell.execute(text.strip())
            if answer is None:
                return
            print(answer)
            text = ""


if __name__ == "__main__":
    main()
