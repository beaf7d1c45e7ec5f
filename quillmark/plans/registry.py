"""Registry of queries: each has a Spark plan and, where SQL can express it, the SQL that must give the same rows.

Tables of the record model (facts, blocks, correction logs ...) are derived from the given ones by SQL that both
engines read; `fixture` names them, and a query's SQL may use them like tables.  `cases` registers a scalar function
over a list of written forms, dealt over the orders, against stated results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

#: Derived tables: portable SQL in which {name} stands for a table or another fixture.
FIXTURES: dict[str, str] = {}
_NAME = re.compile(r"\{([a-z_0-9]+)\}")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in dict.fromkeys(_NAME.findall(text))})

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def fixture(name: str, sql: str) -> None:
    FIXTURES[name] = sql


def with_fixtures(sql: str) -> str:
    """SQL that names fixtures in braces, with their definitions before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _NAME.findall(text):
            if n in FIXTURES and n not in order:
                need(FIXTURES[n])
                order.append(n)

    need(sql)
    plain = lambda s: _NAME.sub(r"\1", s)
    heads = ", ".join(f"{n} AS ({plain(FIXTURES[n])})" for n in order)
    body = plain(sql)
    if not heads:
        return body
    return f"WITH RECURSIVE {heads}, {body.lstrip()[len('WITH RECURSIVE '):]}" if body.lstrip().startswith("WITH RECURSIVE ") else f"WITH {heads} {body}" if not body.lstrip().startswith("WITH ") else f"WITH {heads}, {body.lstrip()[5:]}"


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        PLANS[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_fixtures(sql)
        return f

    return register


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, date):
        return f"DATE '{v.isoformat()}'"
    return "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: Sequence[tuple]) -> None:
    """A fixture of stated rows; columns: `name type, ...`.  Texts must have no backslash."""
    spec = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in spec)
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    fixture(name, f"SELECT {cast} FROM (VALUES {body}) AS v({', '.join(n for n, _ in spec)})")


def cases(name: str, doc: str, ins: str, outs: str, rows: Sequence[tuple], plan: Callable[[DataFrame], DataFrame]) -> None:
    """A query: every order has one of the forms (the first columns of rows), and plan must give the last ones."""
    n = len(ins.split(", "))
    values(f"{name}_forms", f"form_no BIGINT, {ins}", [(i, *r[:n]) for i, r in enumerate(rows)])
    values(f"{name}_wanted", f"form_no BIGINT, {outs}", [(i, *r[n:]) for i, r in enumerate(rows)])
    columns = ", ".join(c.split()[0] for c in outs.split(", "))

    def run(t: Tables) -> DataFrame:
        dealt = t.orders.selectExpr("o_orderkey AS id", f"o_orderkey % {len(rows)} AS form_no").join(getattr(t, f"{name}_forms").hint("broadcast"), "form_no")
        return plan(dealt).selectExpr("id", *columns.split(", "))

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT o_orderkey AS id, {columns} FROM orders JOIN {{{name}_wanted}} ON o_orderkey % {len(rows)} = form_no")(run)
