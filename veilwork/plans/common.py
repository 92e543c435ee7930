"""Tables and literal fixtures for the registered queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from veilwork.shipping import ship
from veilwork.sources.tables import table

__all__ = ["Fixture", "Registry", "kind_sql", "table"]

_DUCK = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_sql, v)) + "]"
    return repr(v)


@dataclass(frozen=True)
class Fixture:
    """A small literal table, the same for Spark and for the SQL check."""

    schema: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in self.rows], self.schema)

    @property
    def sql(self) -> str:
        cols = [c.strip().split(" ") for c in self.schema.split(", ")]
        names = [f"c{i}" for i in range(len(cols))]
        values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in self.rows)
        casts = ", ".join(f'CAST({n} AS {_DUCK[t]}) AS "{c}"' for n, (c, t) in zip(names, cols))
        return f"(SELECT {casts} FROM (VALUES {values}) AS v({', '.join(names)}))"


class Registry:
    """Queries with the SQL that checks them."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            @wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(spark, sf_dir)

            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def kind_sql(c: str) -> str:
    """Kind of a page token."""
    t, bare = f"trim({c})", f"regexp_replace({c}, '[,\\s]', '', 'g')"
    return f"""CASE WHEN {t} = '' THEN 'empty' WHEN regexp_full_match({bare}, '[0-9]{{1,6}}(\\.[0-9]+)?%?') OR regexp_full_match(regexp_replace({c}, '\\s', '', 'g'), '[0-9]{{1,3}}(,[0-9]{{3}})+') THEN 'digit'
 WHEN regexp_matches({t}, '(?i)^(T|M|E|D|F|P|Tel|Mob|Mobile|Cell|Email|E-mail|Phone|Fax|Direct|DID|Office)\\s*[:.]') OR regexp_matches({t}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') OR regexp_matches({t}, '\\+[0-9][0-9\\s().-]{{7,}}') THEN 'contact'
 WHEN regexp_matches({t}, '(?i)\\b(Director|Partner|Manager|Officer|President|Associate|Analyst|Counsel)\\b') THEN 'role' WHEN length({t}) <= 6 AND regexp_matches({t}, '[A-Za-z]') AND NOT regexp_matches({t}, '\\s') THEN 'short'
 WHEN length({t}) >= 24 OR len(string_split_regex({t}, '\\s+')) >= 4 THEN 'long' ELSE 'word' END"""
