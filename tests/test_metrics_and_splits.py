import math

import numpy as np
import pytest

from strandloom.operators import selection, splits
from strandloom.operators.metrics import Metric, check_binary


def score(spark, name, y, p, **params):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, p double")
    return Metric(name, **params).score(df)


def binary_case(ties=False):
    r = np.random.default_rng(7)
    y = r.integers(0, 2, 300)
    p = np.clip(0.4 * y + r.uniform(0, 0.6, 300), 0, 1)
    return y, np.round(p, 1) if ties else p


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.mark.parametrize("ties", [False, True])
def test_binary_metrics(spark, ties):
    y, p = binary_case(ties)
    pos, hit = y >= 0.5, p >= 0.5
    tp, fp, tn, fn = (pos & hit).sum(), (~pos & hit).sum(), (~pos & ~hit).sum(), (pos & ~hit).sum()
    pairs = [(a > b) + 0.5 * (a == b) for a in p[pos] for b in p[~pos]]
    area, seen = 0.0, 0
    for s in sorted(set(p), reverse=True):
        at = p >= s
        area += (pos & at).sum() / at.sum() * ((pos & at).sum() - seen) / pos.sum()
        seen = (pos & at).sum()
    q = np.clip(p, 1e-15, 1 - 1e-15)
    want = {
        "precision": tp / (tp + fp), "recall": tp / (tp + fn), "specificity": tn / (tn + fp), "f1": 2 * tp / (2 * tp + fp + fn), "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2, "auroc": np.mean(pairs), "auprc": area,
        "log_loss": -np.mean(np.where(pos, np.log(q), np.log(1 - q))), "mcc": (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), "accuracy": np.mean(np.rint(y) == np.rint(p)),
    }
    if ties:
        want.pop("mcc")  # a prediction of 0.5 rounds down but counts as positive
    for name, v in want.items():
        assert score(spark, name, y, p) == pytest.approx(v), name


def test_regression_metrics(spark):
    r = np.random.default_rng(0)
    y = r.integers(-2, 8, 200).astype(float)
    p = y + r.normal(0, 1.5, 200)
    some = y != 0
    want = {
        "rmse": np.sqrt(np.mean((y - p) ** 2)), "mae": np.mean(abs(y - p)), "mape": 100 * np.mean(abs((y - p)[some] / y[some])), "r2": 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), "pearson": np.corrcoef(y, p)[0, 1], "spearman": np.corrcoef(ranks(y), ranks(p))[0, 1],
    }
    for name, v in want.items():
        assert score(spark, name, y, p) == pytest.approx(v), name


@pytest.mark.parametrize("low, high", [(None, None), (1, None), (None, 16), (0.5, 64), (0, 0)])
def test_essential_agreement(spark, low, high):
    r = np.random.default_rng(0)
    y = r.integers(-2, 8, 200).astype(float)
    p = y + r.normal(0, 1.5, 200)
    good = 0
    for a, b in zip(y, p, strict=True):
        f, c = math.floor(b), math.ceil(b)
        near = c if 2**b >= (2**f + 2**c) / 2 else f
        if low and a <= math.log2(low):
            good += near <= math.log2(low)
        elif high and a >= math.log2(high):
            good += near >= math.log2(high)
        else:
            good += abs(a - near) <= 1
    assert score(spark, "essential_agreement", y, p, ea_min=low, ea_max=high, other=1) == pytest.approx(good / 200)


def test_edges(spark):
    nan = math.isnan
    assert nan(score(spark, "mape", [0, 0], [1, 2])) and nan(score(spark, "pearson", [1, 1], [1, 2])) and nan(score(spark, "spearman", [1, 1], [1, 2]))
    assert score(spark, "r2", [2, 2], [2, 2]) == 1.0 and score(spark, "r2", [2, 2], [2, 3]) == 0.0
    assert nan(score(spark, "auroc", [1, 1], [0.1, 0.2])) and nan(score(spark, "auprc", [0, 0], [0.1, 0.2])) and nan(score(spark, "precision", [1, 0], [0.1, 0.2])) and nan(score(spark, "recall", [0, 0], [0.1, 0.9]))
    assert nan(score(spark, "specificity", [1, 1], [0.1, 0.9])) and nan(score(spark, "f1", [0, 0], [0.1, 0.2])) and nan(score(spark, "balanced_accuracy", [1, 1], [0.1, 0.9])) and score(spark, "mcc", [1, 1], [1, 0]) == 0.0
    assert nan(score(spark, "mcc", [], []))
    assert score(spark, "mcc", [0, 1, 2, 2], [0, 1, 2, 2]) == pytest.approx(1.0)


def test_registry(spark):
    with pytest.raises(ValueError, match="auroc"):
        Metric("nothing")
    assert len(Metric.names()) >= 17 and Metric.default(True) == "auroc" and Metric.default(False) == "essential_agreement"
    assert Metric("rmse").lower_is_better and not Metric("r2").lower_is_better and Metric.help("mae")
    assert Metric("rmse").better(1.0, 2.0) and Metric("r2").better(2.0, 1.0) and not Metric("r2").better(float("nan"), 1.0)
    assert Metric("mae")([1.0, 2.0], [1.0, 4.0]) == 1.0

    from pyspark.sql import functions as F

    @Metric.register("bias")
    def bias(y, p):
        """Mean difference."""
        return F.avg(p - y)

    assert score(spark, "bias", [1, 2], [2, 3]) == 1.0
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 5.0)], "a double, b double, c double, d double")
    assert Metric("mae").score_labels(df, [("a", "b"), ("c", "d")]) == (0.5, [1.0, 0.0])
    with pytest.raises(ValueError):
        check_binary(spark.createDataFrame([(2,)], "y int"), ["y"])
    check_binary(spark.createDataFrame([(True,), (False,)], "y boolean"), ["y"])


def test_folds(spark):
    df = spark.createDataFrame([(i, float(i % 4 == 0)) for i in range(50)], "sample_id long, y double")
    rows = splits.stratified_folds(df, 5, label="y").collect()
    sizes = np.zeros((2, 5), int)
    for r in rows:
        sizes[int(r["y"]), r["fold"]] += 1
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all() and set(sizes.sum(axis=0)) == {10}
    odd = spark.createDataFrame([(i, 0 if i else 1) for i in range(4)], "sample_id long, y int")
    assert {r["stratum"] for r in splits.stratified_folds(odd, 4, label="y").collect()} == {0}
    held = splits.hold_out(df, label="y").groupBy("y", "is_test").count().collect()
    assert {(r["y"], r["is_test"]): r["count"] for r in held} == {(1.0, True): 3, (1.0, False): 10, (0.0, True): 8, (0.0, False): 29}
    assert splits.nested_folds(3) == [(0, [1, 2]), (1, [2, 0]), (2, [0, 1])]
    with pytest.raises(ValueError):
        splits.stratified_folds(df, 1)


def test_predefined_folds(spark):
    df = spark.createDataFrame([(f"f{i}", i) for i in range(6)], "item string, y int")
    folds = spark.createDataFrame([(i % 3, f"f{i}") for i in range(6)], "fold int, item string")
    ids = lambda d: {r["y"] for r in d.collect()}
    train, test = splits.predefined_folds(df, folds, 1, 3)
    assert ids(train) == {0, 3, 2, 5} and ids(test) == {1, 4}
    train, test = splits.predefined_folds(df, folds, 0)
    assert ids(train) == {1, 2, 4, 5} and ids(test) == {0, 3}
    with pytest.raises(KeyError):
        splits.predefined_folds(df, spark.createDataFrame([(0, "zz")], "fold int, item string"), 0)


def test_importance(spark):
    g = spark.createDataFrame([(3, 0, 2.0), (7, 0, 8.0), (7, 1, 1.0), (4, 1, 3.0)], "seg_id long, label_idx int, gain double")
    both = {r["seg_id"]: r["importance"] for r in selection.rank_importance(g).collect()}
    assert both == {3: pytest.approx(0.2), 7: pytest.approx(1.05), 4: pytest.approx(0.75)} and sum(both.values()) == pytest.approx(2)
    single = g.filter("label_idx = 0")
    assert [r["seg_id"] for r in selection.top_features(selection.rank_importance(single), 5).collect()] == [7, 3]
    p = spark.createDataFrame([(0, "a"), (7, "b")], "seg_id long, segment string")
    assert [tuple(r) for r in selection.with_importance(p, selection.rank_importance(single)).orderBy("seg_id").collect()] == [(0, "a", 0.0), (7, "b", 8.0)]
    merged = selection.merge_importance([spark.createDataFrame([("a", 2.0), ("b", 1.0)], "Segment string, Importance double"), spark.createDataFrame([("a", 4.0)], "Segment string, Importance double")])
    assert {r[0]: r[1] for r in merged.collect()} == {"a": 3.0, "b": 0.5}


def test_scaler(spark):
    df = spark.createDataFrame([(2.0, 0.5, 1.0), (8.0, 1.5, 1.0), (4.0, 1.0, 1.0)], "a double, b double, c double")
    s = selection.LabelScaler.fit(df, ["a", "b", "c"])
    assert s.stds[2] == 1.0 and s.stds[0] == pytest.approx(np.std([2, 8, 4]))
    back = s.inverse(s.transform(df)).collect()
    assert [r["a"] for r in back] == pytest.approx([2, 8, 4], abs=1e-5) and [r["c"] for r in back] == [1.0] * 3
    assert selection.LabelScaler.from_dict(s.to_dict()).means == s.means
    assert selection.scale_mismatch(df.withColumn("b", df["b"] * 0.01), ["a", "b"]) and not selection.scale_mismatch(df, ["a", "b"])


def test_split_gains_equal_plain_sums(spark):
    r = np.random.default_rng(2)
    x, g, h = r.integers(0, 4, (30, 3)), r.normal(size=30), r.uniform(0.1, 1, 30)
    c = spark.createDataFrame([(i, j, int(x[i, j])) for i in range(30) for j in range(3) if x[i, j]], "sample_id long, seg_id long, n long")
    s = spark.createDataFrame([(i, float(g[i]), float(h[i])) for i in range(30)], "sample_id long, g double, h double")
    for row in selection.split_gains(c, s).collect():
        right = x[:, row["seg_id"]] > row["threshold"]
        f = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        assert row["gain"] == pytest.approx(0.5 * (f(right) + f(~right) - g.sum() ** 2 / (h.sum() + 1)))
