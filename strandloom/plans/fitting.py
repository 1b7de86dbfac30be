"""Boosters on feature partitions: one group of columns a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.pool import near_equal_parts, partition_of
from strandloom.plans.boosting import DEPTH, NODE_COLUMNS, NODE_SCHEMA, Booster, Entries
from strandloom.plans.lineage import cut

#: Bytes of ids, labels, predictions and gradients of all samples, and of the entries of its columns, that a booster task holds at most; beyond it, ``backend="levels"`` is the way.
MOST_BYTES = 2 << 30
#: Bytes of an entry in a booster: row, column, value, bin, cell, and the copies made while they are sorted.
ENTRY_BYTES = 80


def fit_partitions(counts: DataFrame, samples: DataFrame, n_features: int, labels: list[str], *, target: int, binary: bool, rounds: int, rate: float, zero_as_missing: bool, depth: int = DEPTH) -> tuple[DataFrame, np.ndarray]:
    """Fits a booster for each contiguous group of about ``target`` columns (0: one for all).

    ``samples(sample_id, is_test, labels...)``, ``counts(sample_id, seg_id, n)`` without zeros. Returns rows
    of trees and predictions, told apart by ``kind``, and the base scores.
    """
    n = samples.count()
    if n * (9 + 40 * len(labels)) > MOST_BYTES:
        raise ValueError(f"the labels of {n} samples are more than a booster task holds; use backend='levels'")
    if (most := largest_part(counts, n_features, target)) * ENTRY_BYTES > MOST_BYTES:
        raise ValueError(f"{most} entries in a group of columns are more than a booster task holds; use smaller groups or backend='levels'")
    pdf = samples.select("sample_id", "is_test", *labels).orderBy("sample_id").toPandas()  # of a checked size
    ids = pdf["sample_id"].to_numpy(np.int64)
    test = pdf["is_test"].to_numpy(bool)
    y = pdf[labels].to_numpy(np.float64)
    parts, size, extra = near_equal_parts(n_features, target)
    spark = counts.sparkSession
    sent = spark.sparkContext.broadcast((ids, test, y))
    keyed = counts.select("sample_id", F.col("seg_id").cast("long").alias("seg_id"), F.col("n").cast("float").alias("n"), partition_of("seg_id", n_features, target).alias("part"))
    # a part without any count still has to give its (constant) predictions
    every = spark.range(parts).select(F.lit(None).cast("long").alias("sample_id"), F.lit(None).cast("long").alias("seg_id"), F.lit(None).cast("float").alias("n"), F.col("id").cast("int").alias("part"))

    def run(key, rows):
        ids, test, y = sent.value
        part = int(key[0])
        first = part * (size + 1) if part < extra else extra * (size + 1) + (part - extra) * size
        width = size + (part < extra)
        rows = rows[rows["sample_id"].notna()]
        at = np.searchsorted(ids, rows["sample_id"].to_numpy(np.int64))
        x = Entries(at, rows["seg_id"].to_numpy(np.int64) - first, rows["n"].to_numpy(), (len(ids), width))
        b = Booster(binary=binary, rounds=rounds, rate=rate, depth=depth, zero_as_missing=zero_as_missing).fit(x.of_rows(~test), y[~test], x.of_rows(test), y[test])
        trees = b.table()
        trees["seg_id"] += first
        trees.insert(0, "kind", "node")
        p = b.predict(x)
        guesses = pd.DataFrame({"kind": "prediction", "sample_id": np.repeat(ids, y.shape[1]), "label_idx": np.tile(np.arange(y.shape[1]), len(ids)), "prediction": p.ravel()})
        bases = pd.DataFrame({"kind": "base", "label_idx": np.arange(y.shape[1]), "prediction": b.base})
        out = pd.concat([trees, guesses, bases], ignore_index=True)
        out["part"] = part
        return out.reindex(columns=["kind", "part", "sample_id", "prediction", *NODE_COLUMNS]).astype({"tree_id": "Int32", "node_id": "Int32", "left": "Int32", "right": "Int32", "seg_id": "Int64", "sample_id": "Int64"})

    schema = f"kind string, part int, sample_id long, prediction double, {NODE_SCHEMA}"
    fitted = cut(keyed.unionByName(every).groupBy("part").applyInPandas(run, schema))
    base = np.zeros(len(labels))
    for r in fitted.filter("kind = 'base' AND part = 0").collect():
        base[r["label_idx"]] = r["prediction"]
    return fitted, base


def largest_part(counts: DataFrame, n_features: int, target: int) -> int:
    """Entries of the group of columns that has most."""
    return counts.groupBy(partition_of("seg_id", n_features, target)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def tree_nodes(fitted: DataFrame) -> DataFrame:
    return fitted.filter("kind = 'node'").select("part", *NODE_COLUMNS)


def mean_predictions(fitted: DataFrame) -> DataFrame:
    """``sample_id, label_idx, prediction``: the mean over partitions."""
    return fitted.filter("kind = 'prediction'").groupBy("sample_id", "label_idx").agg(F.avg("prediction").alias("prediction"))
