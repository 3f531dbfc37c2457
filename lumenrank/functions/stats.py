"""The statistics accumulator over arrays of numbers: avg, max, min, sum, stddev.

Deviation is that of the population, and the maximum starts at 0, so numbers below 0 never are the largest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = ("avg", "max", "min", "sum", "stddev", "matches")


def aggregate(values: Column, how: str) -> Column:
    """Of an array of doubles, in one pass; null if it is empty."""
    null, zero = F.lit(None).cast("double"), F.lit(0.0)
    if how in ("avg", "mean"):
        out = F.aggregate(values, F.struct(zero.alias("n"), zero.alias("s")), lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))
    elif how == "sum":
        out = F.aggregate(values, null, lambda a, x: F.coalesce(a, zero) + x)
    elif how == "min":
        out = F.array_min(values)
    elif how == "max":
        out = F.greatest(F.array_max(values), F.when(F.size(values) > 0, zero))
    elif how == "stddev":

        def step(a: Column, x: Column) -> Column:
            n, d = a["n"] + 1, x - a["m"]
            m = a["m"] + d / n
            return F.struct(n.alias("n"), m.alias("m"), (a["q"] + d * (x - m)).alias("q"))

        out = F.aggregate(values, F.struct(zero.alias("n"), zero.alias("m"), zero.alias("q")), step, lambda a: F.when(a["n"] > 0, F.sqrt(a["q"] / a["n"])))
    elif how == "matches":
        out = F.when(F.size(values) > 0, zero)
    else:
        raise ValueError(f"unknown aggregate [{how}]")
    return out


def fold(values: list[float], how: str) -> float | None:
    """The same of numbers that the driver has."""
    n = len(values)
    if not n:
        return None
    mean = sum(values) / n
    return {"avg": mean, "mean": mean, "sum": sum(values), "min": min(values), "max": max(0.0, *values), "stddev": math.sqrt(sum((x - mean) ** 2 for x in values) / n), "matches": 0.0}[how]
