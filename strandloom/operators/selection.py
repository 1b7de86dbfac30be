"""Importance of features: balance between labels, ranking, merging, scaling of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ratio of the labels' deviations from which an unscaled multi-label run is warned about.
SCALE_RATIO = 10.0


def mean_gain(tree_nodes: DataFrame) -> DataFrame:
    """``seg_id, label_idx, gain``: mean gain over the splits of a tree table; leaves and unused features are absent."""
    return tree_nodes.filter("seg_id IS NOT NULL").groupBy("seg_id", "label_idx").agg(F.avg("gain").alias("gain"))


def rank_importance(gains: DataFrame, n_labels: int | None = None) -> DataFrame:
    """``seg_id, importance`` of ``gains(seg_id, label_idx, gain)``: with several labels the sum of shares in each label's total, else the gain."""
    if n_labels is None:
        n_labels = gains.select("label_idx").distinct().count()
    if n_labels > 1:
        totals = gains.groupBy("label_idx").agg(F.sum("gain").alias("__t"))  # one row per label
        gains = gains.join(F.broadcast(totals), "label_idx").withColumn("gain", F.col("gain") / F.when(F.col("__t") == 0, F.lit(1.0)).otherwise(F.col("__t")))
    return gains.groupBy("seg_id").agg(F.sum("gain").alias("importance"))


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The ``n`` most important, ties by column."""
    return importance.orderBy(F.desc("importance"), "seg_id").limit(n)


def with_importance(pool: DataFrame, importance: DataFrame) -> DataFrame:
    """The pool in column order with importance, 0 where there is none; importance of columns outside the pool is dropped."""
    return pool.join(importance, "seg_id", "left").select("seg_id", F.col("segment").alias("Segment"), F.coalesce("importance", F.lit(0.0)).alias("Importance"))


def merge_importance(folds: list[DataFrame]) -> DataFrame:
    """``Segment, Importance``: the sum over folds by the number of folds; a segment absent from a fold counts 0 there."""
    out = folds[0].select("Segment", "Importance")
    for f in folds[1:]:
        out = out.unionByName(f.select("Segment", "Importance"))
    return out.groupBy("Segment").agg((F.sum("Importance") / F.lit(float(len(folds)))).alias("Importance"))


def split_gains(counts: DataFrame, stats: DataFrame, reg_lambda: float = 1.0) -> DataFrame:
    """The gain of every split ``n > threshold`` of one boosting level, as a plan.

    ``counts(sample_id, seg_id, n)`` without zeros, ``stats(sample_id, g, h)``. Samples without a row for a
    segment have n = 0, whose sums are what the others leave of the total.
    """
    total = stats.agg(F.sum("g").alias("tg"), F.sum("h").alias("th"))
    seen = counts.join(stats, "sample_id").groupBy("seg_id", "n").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    above = W.partitionBy("seg_id").orderBy(F.desc("n"))
    right = seen.withColumn("gr", F.sum("g").over(above)).withColumn("hr", F.sum("h").over(above))
    right = right.withColumn("threshold", F.coalesce(F.lead("n").over(above), F.lit(0)))  # all counts above the next lower one
    both = right.join(F.broadcast(total))  # one row
    score = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + reg_lambda)
    both = both.withColumn("gl", F.col("tg") - F.col("gr")).withColumn("hl", F.col("th") - F.col("hr"))
    return both.select("seg_id", F.col("threshold").cast("long").alias("threshold"), (0.5 * (score("gl", "hl") + score("gr", "hr") - score("tg", "th"))).alias("gain"))


class LabelScaler:
    """Means and population deviations of label columns; a deviation of 0 counts as 1."""

    def __init__(self, names: list[str], means: list[float], stds: list[float]) -> None:
        self.names, self.means, self.stds = names, means, stds

    @classmethod
    def fit(cls, df: DataFrame, names: list[str]) -> LabelScaler:
        got = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names))).first()
        return cls(names, [float(got[f"m{i}"] or 0.0) for i in range(len(names))], [float(got[f"s{i}"] or 0.0) or 1.0 for i in range(len(names))])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: ((F.col(c) - m) / s).cast("float") for c, m, s in zip(self.names, self.means, self.stds, strict=True)})

    def inverse(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return df.withColumns({c: (F.col(c) * s + m).cast("float") for c, m, s in zip(columns or self.names, self.means, self.stds, strict=True)})

    def to_dict(self) -> dict:
        return {"names": self.names, "means": self.means, "stds": self.stds}

    @classmethod
    def from_dict(cls, d: dict | None) -> LabelScaler | None:
        return cls(d["names"], d["means"], d["stds"]) if d else None


def scale_mismatch(df: DataFrame, names: list[str], ratio: float = SCALE_RATIO) -> bool:
    """Whether the largest deviation of the labels is ``ratio`` times the smallest or more."""
    if len(names) < 2:
        return False
    stds = LabelScaler.fit(df, names).stds
    return max(stds) / min(stds) >= ratio
