"""Scalar functions used by models and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.alphabet import _col


def discretise(value: Column | str) -> Column:
    """Nearest whole class, halves to even."""
    return F.rint(_col(value).cast("double"))


def clip_probability(p: Column | str, epsilon: float = 1e-15) -> Column:
    return F.greatest(F.lit(epsilon), F.least(F.lit(1.0 - epsilon), _col(p).cast("double")))


def is_positive(value: Column | str) -> Column:
    return _col(value).cast("double") >= 0.5


def min_max(df: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """``column`` scaled to 0..1 by its extremes; a constant column becomes 0."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    span = (hi - lo) if hi is not None and hi != lo else None
    return df.withColumn(out, (F.col(column) - F.lit(lo)) / F.lit(span) if span else F.lit(0.0))


def undo_min_max(scaled: Column | str, low: float, high: float) -> Column:
    return _col(scaled) * (high - low) + low


def standardise(train: DataFrame, other: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables' columns centred and scaled by the first one's mean and population deviation (0 counts as 1)."""
    got = train.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    for i, c in enumerate(columns):
        m, s = got[f"m_{i}"] or 0.0, got[f"s_{i}"] or 1.0
        train, other = (d.withColumn(c, (F.col(c) - m) / s) for d in (train, other))
    return train, other
