"""Arrays within a row, by higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are folded before what they give is put to the rest: an array that
#: grows by one item is copied for each.
CHUNK = 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def placed(items: Column, size: Callable[[Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """made(start, item) of every item; start is the sum of the sizes before."""
    empty = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + size(x)).cast("int").alias("at"), F.concat(acc["out"], F.array(made(acc["at"], x))).alias("out"))

    def chunk(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)))
        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        inner = lambda acc, part: let(F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), step), lambda got: F.struct(got["at"].alias("at"), F.concat(acc["out"], got["out"]).alias("out")))
        return F.aggregate(parts, zero, inner, lambda acc: acc["out"])

    return let(items, chunk)


def matches(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern, as an array of (start, text)."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = lambda found: F.zip_with(F.slice(F.split(text, p, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    size = lambda x: F.length(x["gap"]) + F.length(x["match"])
    made = lambda at, x: F.struct((at + F.length(x["gap"])).alias("start"), x["match"].alias("text"))
    kind = "array<struct<start:int,text:string>>"
    return let(F.regexp_extract_all(text, p, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(pairs(found), size, made, kind)).otherwise(F.array().cast(kind)))
