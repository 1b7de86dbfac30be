"""Validation metrics as aggregations over ``(y, p)`` rows, in a registry that users extend."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.scalars import clip_probability, discretise, is_positive
from strandloom.plans.lineage import prefix_sums

_NAN = float("nan")


def _or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(_NAN))


class Metric:
    """The registry. A metric is a function ``(y, p, **params) -> Column`` (an aggregate) or, with ``table=True``,
    ``(df, **params) -> float`` on a DataFrame with the columns ``y`` and ``p``."""

    _known: dict[str, tuple[Callable, bool]] = {}
    LOWER_IS_BETTER = frozenset(("rmse", "mae", "mape", "log_loss"))
    #: What is used where no metric is named.
    DEFAULT = "essential_agreement"
    DEFAULT_BINARY = "auroc"

    @classmethod
    def register(cls, name: str, table: bool = False, lower_is_better: bool = False):
        def add(f: Callable) -> Callable:
            cls._known[name] = (f, table)
            if lower_is_better:
                cls.LOWER_IS_BETTER = cls.LOWER_IS_BETTER | {name}
            return f

        return add

    @classmethod
    def names(cls) -> list[str]:
        return sorted(cls._known)

    @classmethod
    def default(cls, binary: bool) -> str:
        return cls.DEFAULT_BINARY if binary else cls.DEFAULT

    @classmethod
    def help(cls, name: str) -> str:
        return inspect.getdoc(cls._get(name)[0]) or ""

    @classmethod
    def _get(cls, name: str) -> tuple[Callable, bool]:
        if name not in cls._known:
            raise ValueError(f"unknown metric {name!r}; there are {', '.join(cls.names())}")
        return cls._known[name]

    def __init__(self, name: str, **params) -> None:
        self.name = name
        self.func, self.table = self._get(name)
        declared = inspect.signature(self.func).parameters
        self.params = {k: v for k, v in params.items() if k in declared}

    @property
    def lower_is_better(self) -> bool:
        return self.name in self.LOWER_IS_BETTER

    def better(self, a: float, b: float) -> bool:
        """Whether score ``a`` beats ``b``; NaN beats nothing."""
        if math.isnan(a) or math.isnan(b):
            return not math.isnan(a) and math.isnan(b)
        return a < b if self.lower_is_better else a > b

    def score(self, df: DataFrame, y: str = "y", p: str = "p") -> float:
        pairs = df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))
        if self.table:
            return float(self.func(pairs, **self.params))
        value = pairs.agg(self.func(F.col("y"), F.col("p"), **self.params).alias("v")).first()[0]
        return _NAN if value is None else float(value)

    def score_labels(self, df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[float, list[float]]:
        """The mean over labels, and each label's own score; ``pairs`` of actual and predicted columns."""
        each = [self.score(df, y, p) for y, p in pairs]
        return sum(each) / len(each), each

    def __call__(self, predictions, labels) -> float:
        """Scores driver-side sequences, predictions first."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        rows = [(float(b), float(a)) for a, b in zip(predictions, labels, strict=True)]
        return self.score(spark.createDataFrame(rows, "y double, p double"))


@Metric.register("rmse")
def rmse(y: Column, p: Column) -> Column:
    """Root of the mean squared error."""
    return F.sqrt(F.avg((y - p) * (y - p)))


@Metric.register("mae")
def mae(y: Column, p: Column) -> Column:
    """Mean absolute error."""
    return F.avg(F.abs(y - p))


@Metric.register("mape")
def mape(y: Column, p: Column) -> Column:
    """Mean absolute error in per cent of the label; labels of 0 are left out, NaN if nothing stays."""
    return _or_nan(F.avg(F.when(y != 0, F.abs((y - p) / F.when(y != 0, y)))) * 100)


@Metric.register("r2")
def r2(y: Column, p: Column) -> Column:
    """Coefficient of determination; for constant labels 1 if they are met exactly, else 0."""
    res, tot = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return F.when(tot == 0, F.when(res == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1.0 - F.try_divide(res, tot))


@Metric.register("pearson")
def pearson(y: Column, p: Column) -> Column:
    """Linear correlation; NaN for constant input."""
    return _or_nan(F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p)))


@Metric.register("accuracy")
def accuracy(y: Column, p: Column) -> Column:
    """Share of rows whose label and prediction round to one class."""
    return F.avg((discretise(y) == discretise(p)).cast("double"))


def confusion(df: DataFrame) -> DataFrame:
    """``y, p, n``: pairs of rounded classes that occur."""
    return df.groupBy(discretise("y").alias("y"), discretise("p").alias("p")).agg(F.count(F.lit(1)).alias("n"))


def classes(df: DataFrame) -> DataFrame:
    """``k``: rounded classes that occur on either side."""
    return df.select(discretise("y").alias("k")).union(df.select(discretise("p").alias("k"))).distinct()


@Metric.register("mcc", table=True)
def mcc(df: DataFrame) -> float:
    """Matthews correlation of the rounded classes, for any number of them; 0 where either side is constant."""
    c = confusion(df)
    rows = c.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)).alias("hit"))
    cols = c.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("q"))
    r = rows.join(cols, "k", "full").agg(*(F.sum(e.cast("double")).alias(n) for n, e in {"s": F.col("t"), "c": F.col("hit"), "tq": F.coalesce("t", F.lit(0)).cast("double") * F.coalesce("q", F.lit(0)), "tt": F.col("t").cast("double") * F.col("t"), "qq": F.col("q").cast("double") * F.col("q")}.items())).first()
    if not r["s"]:
        return _NAN
    spread = (r["s"] ** 2 - r["qq"]) * (r["s"] ** 2 - r["tt"])
    return (r["c"] * r["s"] - r["tq"]) / math.sqrt(spread) if spread > 0 else 0.0


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the 1-based rank of ``column``, tied values sharing their mean rank."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    ended = prefix_sums(sizes, [F.col(column).asc()], {"__e": F.col("__n")})
    ranks = ended.select(F.col(column).alias("__c"), (F.col("__e") - (F.col("__n") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, df[column].eqNullSafe(F.col("__c"))).drop("__c")


@Metric.register("spearman", table=True)
def spearman(df: DataFrame) -> float:
    """Linear correlation of average ranks."""
    ranked = average_ranks(average_ranks(df, "y", "ry"), "p", "rp")
    return ranked.agg(pearson(F.col("ry"), F.col("rp"))).first()[0]


@Metric.register("auroc", table=True)
def auroc(df: DataFrame) -> float:
    """Area under the ROC curve by mean ranks; NaN with one class only."""
    by = df.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_positive("y")).alias("pos"))
    ended = prefix_sums(by, [F.col("p").asc()], {"e": F.col("n")})
    r = ended.agg(F.sum((F.col("e") - (F.col("n") - 1) / F.lit(2.0)) * F.col("pos")).alias("ranks"), F.sum("pos").alias("a"), F.sum(F.col("n") - F.col("pos")).alias("b")).first()
    if not r["a"] or not r["b"]:
        return _NAN
    return (r["ranks"] - r["a"] * (r["a"] + 1) / 2.0) / (r["a"] * r["b"])


def precision_recall(df: DataFrame) -> DataFrame:
    """``p, n, pos, hits, seen``: for every score from the highest, its rows and positives, and those so far."""
    by = df.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_positive("y")).alias("pos"))
    return prefix_sums(by, [F.col("p").desc()], {"hits": F.col("pos"), "seen": F.col("n")})


@Metric.register("auprc", table=True)
def auprc(df: DataFrame) -> float:
    """Average precision, a step function over recall, tied scores one point; NaN without positives."""
    r = precision_recall(df).agg(F.sum(F.col("pos") * F.col("hits") / F.col("seen")).alias("area"), F.sum("pos").alias("a")).first()
    return r["area"] / r["a"] if r["a"] else _NAN


def _cells(y: Column, p: Column) -> tuple[Column, Column, Column, Column]:
    """True and false positives, true and false negatives."""
    t, q = is_positive(y), is_positive(p)
    return F.count_if(t & q), F.count_if(~t & q), F.count_if(~t & ~q), F.count_if(t & ~q)


@Metric.register("precision")
def precision(y: Column, p: Column) -> Column:
    """Share of predicted positives that are positive; NaN if none is predicted."""
    tp, fp, _, _ = _cells(y, p)
    return _or_nan(F.try_divide(tp, tp + fp))


@Metric.register("recall")
def recall(y: Column, p: Column) -> Column:
    """Share of positives that are predicted; NaN if there are none."""
    tp, _, _, fn = _cells(y, p)
    return _or_nan(F.try_divide(tp, tp + fn))


@Metric.register("specificity")
def specificity(y: Column, p: Column) -> Column:
    """Share of negatives that are predicted; NaN if there are none."""
    _, fp, tn, _ = _cells(y, p)
    return _or_nan(F.try_divide(tn, tn + fp))


@Metric.register("f1")
def f1(y: Column, p: Column) -> Column:
    """Harmonic mean of precision and recall; NaN if nothing is positive or predicted."""
    tp, fp, _, fn = _cells(y, p)
    return _or_nan(F.try_divide(2 * tp, 2 * tp + fp + fn))


@Metric.register("balanced_accuracy")
def balanced_accuracy(y: Column, p: Column) -> Column:
    """Mean of recall and specificity; NaN with one class only."""
    tp, fp, tn, fn = _cells(y, p)
    return _or_nan((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2)


@Metric.register("log_loss")
def log_loss(y: Column, p: Column) -> Column:
    """Mean negative log likelihood, predictions kept 1e-15 from 0 and 1."""
    q = clip_probability(p)
    return -F.avg(F.when(is_positive(y), F.log(q)).otherwise(F.log(1 - q)))


@Metric.register("essential_agreement")
def essential_agreement(y: Column, p: Column, ea_min: float | None = None, ea_max: float | None = None) -> Column:
    """Share of log2 predictions within one whole dilution of the label.

    A prediction is rounded to the nearer whole dilution on the linear scale. Labels at or beyond a bound, given on the
    linear scale, agree if the rounded prediction is on the bound or beyond it; the lower bound goes first."""
    lo, hi = F.floor(p).cast("double"), F.ceil(p).cast("double")
    near = F.when(F.pow(F.lit(2.0), p) >= (F.pow(F.lit(2.0), lo) + F.pow(F.lit(2.0), hi)) / 2, hi).otherwise(lo)
    agrees = F.abs(y - near) <= 1
    if ea_max:
        top = math.log2(ea_max)
        agrees = F.when(y >= top, near >= top).otherwise(agrees)
    if ea_min:
        low = math.log2(ea_min)
        agrees = F.when(y <= low, near <= low).otherwise(agrees)
    return F.avg(agrees.cast("double"))


def non_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``value``: distinct labels other than 0 and 1; null is none."""
    values = df.select(F.explode(F.array(*(F.col(c).cast("double") for c in columns))).alias("value"))
    return values.filter(F.col("value").isNotNull() & ~F.col("value").isin(0.0, 1.0)).distinct()


def check_binary(df: DataFrame, columns: list[str]) -> None:
    """Raises unless all labels are 0 or 1 (or booleans)."""
    bad = {r["value"] for r in non_binary(df, columns).limit(5).collect()}
    if bad:
        raise ValueError(f"binary labels are 0 or 1, not {sorted(bad)}")
