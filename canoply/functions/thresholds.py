"""Threshold lists as arrays of records: text form, validation, edits.

The text is a flat comma-separated list, two numbers a record for tops and three for crowns. A rest
that makes no whole record, or holds something that is no number, is dropped with what follows it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (field, type) of the records.
TOPS = (("threshold", "double"), ("window", "int"))
CROWNS = (("threshold", "double"), ("fraction", "double"), ("radius", "double"))


def record(fields, *values) -> Column:
    return F.struct(*(F.lit(v).cast(t).alias(n) if not isinstance(v, Column) else v.cast(t).alias(n) for (n, t), v in zip(fields, values, strict=True)))


def parse(text: Column, fields=TOPS) -> Column:
    k = len(fields)
    numbers = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x).try_cast("double"))
    bad = F.array_position(F.transform(numbers, lambda x: x.isNull()), True)
    good = F.when(bad > 0, F.slice(numbers, 1, (bad - 1).cast("int"))).otherwise(numbers)
    n = F.floor(F.size(good) / k).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: record(fields, *(F.get(good, i * k + j) for j in range(k))))).otherwise(F.array().cast(f"array<struct<{','.join(f'{a}:{b}' for a, b in fields)}>>"))


def to_text(items: Column, fields=TOPS) -> Column:
    """Numbers in their shortest form without a trailing .0, so that parse() gives the list again."""

    def number(c: Column) -> Column:
        return F.regexp_replace(c.cast("string"), r"\.0$", "")

    return F.array_join(F.transform(items, lambda x: F.concat_ws(",", *(number(x[n]) for n, _ in fields))), ",")


def valid_tops(items: Column) -> Column:
    return (F.size(items) > 0) & F.forall(items, lambda x: (x["threshold"] > 0) & (x["window"] >= 3) & (x["window"] % 2 == 1))


def valid_crowns(items: Column) -> Column:
    return (F.size(items) > 0) & F.forall(items, lambda x: (x["fraction"] > 0) & (x["radius"] > 0) & (x["threshold"] > 0))


def add(items: Column, fields=TOPS) -> Column:
    """A record of zeros at the end."""
    return F.array_append(items, record(fields, *[0] * len(fields)))


def delete(items: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.filter(items, lambda x, i: i != at)


def update(items: Column, at: Column | int, new: Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.transform(items, lambda x, i: F.when(i == at, new).otherwise(x))


def ordered(items: Column) -> Column:
    """By threshold; records of one threshold keep their order."""
    held = F.transform(items, lambda x, i: F.struct(x["threshold"].alias("t"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(held), lambda y: y["x"])
