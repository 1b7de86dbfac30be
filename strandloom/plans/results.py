"""What a run returns."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.metrics import Metric
from strandloom.operators.selection import merge_importance


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; the driver holds a partition's rows at a time, not the table."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(df.columns)
        w.writerows(tuple(r) for r in df.toLocalIterator(prefetchPartitions=True))


class SegmentImportance:
    """``table(seg_id, Segment, Importance)`` in column order."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def ranked(self) -> DataFrame:
        return self.table.orderBy(F.desc("Importance"), "seg_id")

    def top(self, n: int) -> DataFrame:
        return self.ranked().limit(n)

    def to_frame(self) -> DataFrame:
        return self.table.orderBy("seg_id").select("Segment", "Importance")

    def to_csv(self, path: str) -> None:
        """One CSV file in column order."""
        write_csv(self.to_frame(), path)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str) -> SegmentImportance:
        import pandas as pd

        pdf = pd.read_csv(path, dtype={"Segment": str}, keep_default_na=False)
        if "Importance" not in pdf:
            pdf["Importance"] = 0.0
        rows = [(i, s, float(v)) for i, (s, v) in enumerate(zip(pdf["Segment"], pdf["Importance"], strict=True))]
        return cls(spark.createDataFrame(rows, "seg_id long, Segment string, Importance double"))

    @classmethod
    def merge(cls, folds: list[SegmentImportance]) -> DataFrame:
        return merge_importance([f.table for f in folds]).orderBy(F.desc("Importance"), "Segment")


def prediction_columns(labels: list[str]) -> list[tuple[str, str]]:
    """Names of actual and predicted columns for each label."""
    return [("Actual", "Prediction")] if len(labels) == 1 else [(f"Actual_{n}", f"Prediction_{n}") for n in labels]


def wide_predictions(long: DataFrame, samples: DataFrame, labels: list[str]) -> DataFrame:
    """``sample_id, item`` with predicted and actual columns, of ``long(sample_id, label_idx, prediction)``; rows meet by id."""
    out = samples
    for i, (_, p) in enumerate(prediction_columns(labels)):
        out = out.join(long.filter(F.col("label_idx") == i).select("sample_id", F.col("prediction").alias(p)), "sample_id")
    cols = [c for (a, p), n in zip(prediction_columns(labels), labels, strict=True) for c in (F.col(p).cast("double").alias(p), F.col(n).cast("double").alias(a))]
    return out.select("sample_id", "item", *cols)


@dataclass
class FoldResult:
    fold: int
    model: object
    predictions: DataFrame
    score: float
    label_scores: list[float]
    segments: SegmentImportance


@dataclass
class TrainingResult:
    folds: list[FoldResult] = field(default_factory=list)
    metric: Metric | None = None

    @property
    def models(self) -> list:
        return [f.model for f in self.folds]

    @property
    def scores(self) -> list[float]:
        return [f.score for f in self.folds]

    @property
    def score(self) -> float:
        return sum(self.scores) / len(self.folds) if self.folds else float("nan")

    @property
    def label_scores(self) -> list[float]:
        return [sum(x) / len(x) for x in zip(*(f.label_scores for f in self.folds), strict=True)]

    @property
    def best_fold(self) -> FoldResult | None:
        """The first fold that no other beats."""
        best = None
        for f in self.folds:
            if best is None or self.metric.better(f.score, best.score):
                best = f
        return best

    @property
    def model(self):
        return self.best_fold.model if self.folds else None

    @property
    def segments(self) -> DataFrame:
        return SegmentImportance.merge([f.segments for f in self.folds])

    @property
    def predictions(self) -> DataFrame:
        out = None
        for f in self.folds:
            one = f.predictions.withColumn("Fold", F.lit(f.fold))
            out = one if out is None else out.unionByName(one)
        return out

    def to_frame(self) -> DataFrame:
        return self.predictions
