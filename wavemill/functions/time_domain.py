"""Time-domain features of an array column as expressions: they stay in the JVM and in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def total(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def moment(x: Column, k: int) -> Column:
    """Central moment of order k."""

    def power(d: Column) -> Column:
        out = d
        for _ in range(k - 1):
            out = out * d
        return out

    return let(mean(x), lambda m: total(x, lambda v: power(v - m)) / F.size(x))


def diff(x: Column) -> Column:
    n = F.size(x)
    return F.when(n > 1, F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def line_length(x: Column) -> Column:
    return total(diff(x), F.abs)


def moments(x: Column) -> Column:
    """Second to fourth central moments in one pass after the mean."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("m2", "m3", "m4")])

    def step(m: Column):
        def add(acc: Column, v: Column) -> Column:
            d = v - m
            return F.struct((acc["m2"] + d * d).alias("m2"), (acc["m3"] + d * d * d).alias("m3"), (acc["m4"] + d * d * d * d).alias("m4"))

        return add

    n = F.size(x)
    return let(mean(x), lambda m: F.aggregate(x, zero, step(m), lambda a: F.struct(m.alias("mean"), (a["m2"] / n).alias("m2"), (a["m3"] / n).alias("m3"), (a["m4"] / n).alias("m4"))))


def summary(x: Column) -> Column:
    """What the features of a window (ARRAY<DOUBLE>) follow from, as a struct; keep it in a column of its own."""

    def whole(v: Column) -> Column:
        return let(diff(v), lambda d: F.struct(moments(v).alias("of"), total(d, F.abs).alias("line_length"), moment(d, 2).alias("d1"), moment(diff(d), 2).alias("d2")))

    return let(x, whole)


def features(s: Column) -> dict[str, Column]:
    """The eight features from a window's summary, without branches that divide by zero."""
    m2, sd = s["of"]["m2"], F.sqrt(s["of"]["m2"])
    mobility = F.sqrt(safe_ratio(s["d1"], m2))
    return {
        "mean": s["of"]["mean"],
        "std": sd,
        "skew": safe_ratio(s["of"]["m3"], sd * sd * sd),
        "kurt": F.when(m2 > 0, s["of"]["m4"] / (m2 * m2) - 3).otherwise(F.lit(0.0)),
        "line_length": s["line_length"],
        "hjorth_activity": m2,
        "hjorth_mobility": mobility,
        "hjorth_complexity": safe_ratio(F.sqrt(safe_ratio(s["d2"], s["d1"])), mobility),
    }
