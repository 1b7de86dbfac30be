"""Hold-outs and folds by exact quotas in a hashed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.plans.lineage import number_rows
from strandloom.sources.labels import without_labels

TEST_SHARE = 0.2
SEED = 42


def shuffled(key: str, seed: int = SEED) -> Column:
    """A sort key that shuffles rows the same way every time (md5, so that other engines can repeat it)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def stratum_of(label: str | None) -> Column:
    """The label cut to whole numbers; one stratum without a label."""
    return F.lit(0).cast("long") if label is None else F.col(label).cast("double").cast("long")


def stratified_folds(df: DataFrame, k: int, *, key: str = "sample_id", label: str | None = None, seed: int = SEED) -> DataFrame:
    """``df`` with ``stratum`` and ``fold`` 0..k-1: every stratum dealt round in shuffled order, beginning where the one before ended.

    A label with fewer than ``k`` rows in some stratum cannot be stratified; all rows are then one stratum.
    """
    if k < 2:
        raise ValueError("at least two folds")
    if label is not None:
        least = df.groupBy(stratum_of(label).alias("s")).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
        label = label if least is not None and least >= k else None
    marked = df.withColumn("stratum", stratum_of(label))
    # numbered through all strata, so that no stratum has to be sorted in one task
    placed = number_rows(marked, [F.col("stratum").asc(), shuffled(key, seed).asc(), F.col(key).asc()], "__r")
    return placed.withColumn("fold", F.pmod("__r", F.lit(k)).cast("int")).drop("__r")


def hold_out(df: DataFrame, *, key: str = "sample_id", label: str | None = None, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """``df`` with ``is_test``: the first ceil(share * n) rows of each stratum in shuffled order, at least one left to train.

    Strata of one row cannot be split; all rows are then one stratum.
    """
    if label is not None:
        least = df.groupBy(stratum_of(label).alias("s")).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
        label = label if least is not None and least >= 2 else None
    marked = df.withColumn("__s", stratum_of(label))
    sizes = marked.groupBy("__s").agg(F.count(F.lit(1)).alias("n")).orderBy("__s").collect()  # one row per class
    quota, at = F.lit(False), 0
    for r in sizes:
        test = min(-(-r["n"] * round(share * 1_000_000) // 1_000_000), max(r["n"] - 1, 0))
        quota = quota | ((F.col("__r") >= at) & (F.col("__r") < at + test))
        at += r["n"]
    placed = number_rows(marked, [F.col("__s").asc(), shuffled(key, seed).asc(), F.col(key).asc()], "__r")
    return placed.withColumn("is_test", quota).drop("__s", "__r")


def predefined_folds(df: DataFrame, folds: DataFrame, test: int, num_folds: int = 0, *, item: str = "item") -> tuple[DataFrame, DataFrame]:
    """Train and test rows by ``folds(fold, item)``: fold ``test`` is held out, the others below ``num_folds`` train
    (0: all but the first). An item without a row is an error."""
    missing = without_labels(folds, df, item).select(item).limit(5).collect()
    if missing:
        raise KeyError(f"fold items without a label: {[r[0] for r in missing]}")
    train = folds.filter((F.col("fold") < num_folds) & (F.col("fold") != test)) if num_folds > 0 else folds.filter("fold >= 1")
    return df.join(train.select(item), item), df.join(folds.filter(F.col("fold") == test).select(item), item)


def nested_folds(n: int) -> list[tuple[int, list[int]]]:
    """Outer folds with their inner folds in order: inner fold 0 is the one after the outer."""
    return [(i, [(i + d) % n for d in range(1, n)]) for i in range(n)]


def inner_folds(folds: DataFrame, outer: int, inner: list[int]) -> DataFrame:
    """``folds(fold, item)`` without the fold ``outer``, the others numbered as ``inner`` lists them."""
    number = F.element_at(F.create_map(*(F.lit(x) for pair in zip(inner, range(len(inner)), strict=True) for x in pair)), F.col("fold"))
    return folds.filter(F.col("fold") != outer).withColumn("fold", number)
