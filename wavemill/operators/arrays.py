"""Folds over arrays that keep what they find along the way, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Appending copies an array; found values are copied within blocks of this size, and blocks as a whole.
BLOCK = 512


def scanned(xs: Column, start: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]], kind: str) -> Column:
    """The values that ``step`` finds on its way through ``xs``.

    ``step(state, x)`` gives the next state, a value of type ``kind``, and whether
    it is kept. The work grows with the length of ``xs``, not with its square.
    """
    none = F.array().cast(f"array<{kind}>")
    first = F.struct(F.struct(*[c.alias(n) for n, c in start.items()]).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"), none.alias("open"))

    def one(acc: Column, x: Column) -> Column:
        state, value, keep = step(acc["state"], x)
        full = F.size(acc["open"]) >= BLOCK
        done = F.when(keep & full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        open_ = F.when(~keep, acc["open"]).when(full, F.array(value)).otherwise(F.concat(acc["open"], F.array(value)))
        return F.struct(F.struct(*[state[n].alias(n) for n in start]).alias("state"), done.alias("done"), open_.alias("open"))

    return F.aggregate(xs, first, one, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["open"]))))
