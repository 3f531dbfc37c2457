"""Feature and score normalisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_MAX = 3.4028234663852886e38


@dataclass(frozen=True)
class Standard:
    mean: float
    standard_deviation: float

    def __post_init__(self):
        if not self.standard_deviation > 0:
            raise ValueError("standard_deviation must be larger than 0")

    def apply(self, x: Column) -> Column:
        return (x - F.lit(float(self.mean))) / F.lit(float(self.standard_deviation))


@dataclass(frozen=True)
class MinMax:
    minimum: float = 0.0
    maximum: float = FLOAT_MAX

    def __post_init__(self):
        if self.minimum < 0 or self.maximum < 0:
            raise ValueError("minimum and maximum must not be negative")
        if not self.minimum < self.maximum:
            raise ValueError("minimum must be smaller than maximum")

    def apply(self, x: Column) -> Column:
        return (x - F.lit(float(self.minimum))) / F.lit(float(self.maximum - self.minimum))


def parse(definitions: dict[str, dict] | None) -> dict[str, Standard | MinMax]:
    """``{feature: {"standard": {...}}}`` or ``{feature: {"min_max": {...}}}``."""
    out = {}
    for name, spec in (definitions or {}).items():
        if len(spec) != 1:
            raise ValueError(f"feature [{name}] needs exactly one normalizer")
        (kind, args), = spec.items()
        if kind not in ("standard", "min_max"):
            raise ValueError(f"[{kind}] is not a valid feature normalizer")
        if kind == "standard" and not {"mean", "standard_deviation"} <= set(args):
            raise ValueError("standard needs mean and standard_deviation")
        out[name] = (Standard if kind == "standard" else MinMax)(**args)
    return out


def score_normalizer(name: str, score: Column) -> Column:
    if name == "noop":
        return score
    if name == "sigmoid":
        return 1 / (1 + F.exp(-score))
    raise ValueError(f"{name} is not a valid Normalizer")
