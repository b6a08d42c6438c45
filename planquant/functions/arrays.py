"""Array helpers: a value computed once for many uses, and running sums, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with value, computed once for each row: it is generated, since the optimizer copies a projected one into every filter and
    projection that uses it, and what is built from copies grows with their product."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def running(a: Column, first: Column | int, op: Callable[[Column, Column], Column]) -> Column:
    """first, op(first, a0), op(op(first, a0), a1) and so on: one value more than a has; op is associative.

    Long arrays are taken in blocks of the root of their length, so that appending copies little."""
    short = lambda x, start: F.aggregate(x, F.array(start), lambda acc, y: F.concat(acc, F.array(op(F.get(acc, F.size(acc) - 1), y))))
    start = first if isinstance(first, Column) else F.lit(first)

    def long(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")), lambda k: F.slice(x, k * width + 1, width))
        totals = lambda p: F.transform(p, lambda y: F.aggregate(y, start, op))
        rest = lambda p, starts: F.flatten(F.transform(p, lambda y, k: F.slice(short(y, F.get(starts, k)), F.lit(2), F.size(y))))
        return let(parts, lambda p: F.concat(F.array(start), let(short(totals(p), start), lambda starts: rest(p, starts))))

    return F.when(F.size(a) <= 32, short(a, start)).otherwise(long(a))
