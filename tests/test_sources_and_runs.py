import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom import Alphabet, BaselinePipeline, InferencePipeline, Metric, SegmentImportance, SegmentModel, TrainingPipeline
from strandloom.plans import boosting
from strandloom.plans.results import FoldResult, TrainingResult
from strandloom.plans.training import nested_cross_validation
from strandloom.sources import labels as L
from strandloom.sources import readers

MOTIF = "aaggttcc"


def bases(r, n=120):
    return "".join(r.choice("acgt") for _ in range(n))


@pytest.fixture(scope="module")
def genomes(tmp_path_factory):
    """Twenty files of two contigs, a motif planted in every other one, and their label file."""
    d = tmp_path_factory.mktemp("genomes")
    r = random.Random(3)
    rows = []
    for i in range(20):
        a, b = bases(r), bases(r)
        if i % 2 == 0:
            a = a[:40] + 3 * MOTIF + a[64:]
            b = b[:10] + 3 * MOTIF + b[34:]
        name = d / f"{i:03d}.fna"
        name.write_text(f">one\n{a[:60]}\n{a[60:]}\n>two\n{b.upper()}\n")
        rows.append((1 - i % 2, name.name))
    pd.DataFrame(rows, columns=["labels", "files"]).to_csv(d / "labels.csv", index=False)
    return d


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(11)
    rows = []
    for i in range(60):
        s = bases(r)
        if i % 2:
            s = s[:30] + MOTIF + s[38:]
        rows.append((i, s, 4.0 if i % 2 else 0.0, 0.5 + 0.01 * (i % 3)))
    return spark.createDataFrame(rows, "id long, sequence string, mic double, growth double")


SMALL = {"data_column": "sequence", "id_column": "id", "k": 4, "ext": 2, "target": 8, "features": 60, "num_rounds": 25, "lr": 0.3, "partition_size_target": 80}


# --- labels and sources


def test_label_names():
    assert L.label_names("y") == ["y"] and L.label_names(None, "labels") == ["labels"] and L.label_names(["a", "b"]) == ["a", "b"]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            L.label_names(bad)
    with pytest.raises(ValueError):
        L.label_names(None)


def test_text_table(spark):
    dirty = spark.createDataFrame([("ab", 1.0), (None, 2.0), (" \t", 3.0), ("cd", None)], "text string, labels double")
    assert [(r["text"], r["labels"]) for r in readers.text_table(dirty, "text").collect()] == [("ab", 1.0)]
    with pytest.raises(ValueError):
        readers.text_table(dirty.filter("text IS NULL"), "text")
    with pytest.raises(ValueError, match="nope"):
        readers.text_table(dirty, "text", "nope")
    strings = spark.createDataFrame([("a", " 0.25"), ("b", "4"), ("c", "true")], "text string, labels string")
    assert sorted(r["labels"] for r in readers.text_table(strings, "text").collect()) == [0.25, 1.0, 4.0]
    with pytest.raises(ValueError, match="labels=high, labels=low"):
        readers.text_table(spark.createDataFrame([("a", "high"), ("b", "low")], "text string, labels string"), "text")
    bools = spark.createDataFrame([("a", True), ("b", False)], "text string, labels boolean")
    assert sorted(r["labels"] for r in readers.text_table(bools, "text").collect()) == [0.0, 1.0]


def test_label_sources(spark, genomes):
    files = readers.label_table(str(genomes / "labels.csv"), "labels", str(genomes), spark)
    assert files.count() == 20 and files.filter("labels = 1").count() == 10
    a, b = str(genomes / "000.fna"), str(genomes / "001.fna")
    two = readers.label_table({a: {"mic": 1, "growth": 2}, b: {"growth": 4, "mic": 3}, "/none": {"mic": 0, "growth": 0}}, ["growth", "mic"], spark=spark)
    assert [(r["growth"], r["mic"]) for r in two.orderBy("sample_id").collect()] == [(2.0, 1.0), (4.0, 3.0)]
    with pytest.raises(ValueError):
        readers.label_table({a: 1}, ["mic", "growth"], spark=spark)
    last = readers.label_table(spark.createDataFrame([(a, 1.0), (b, 2.0), (a, 3.0)], "files string, y double"), "y")
    assert {r["item"]: r["y"] for r in last.collect()} == {a: 3.0, b: 2.0}
    assert readers.read_items(last).filter("text LIKE '>one%'").count() == 2
    assert readers.fasta_directory(spark, str(genomes)).count() == 20


def test_source_choice(spark, genomes, planted):
    with pytest.raises(ValueError):
        readers.build_source(spark)
    with pytest.raises(ValueError):
        readers.build_source(spark, table=planted)
    assert readers.build_source(spark, table=planted, data_column="sequence", label_columns="mic", label_file="x").count() == 60


def test_segment_lists_and_folds(spark, tmp_path):
    (tmp_path / "s.txt").write_text("aa\nbb\n\naa\n")
    (tmp_path / "s.csv").write_text("Segment,Importance\ncc,1\ndd,2\n")
    (tmp_path / "f.json").write_text(json.dumps({"fold_0": ["a", "b"], "fold_1": ["c"]}))
    read = lambda n: [r["segment"] for r in readers.segment_list(spark, str(tmp_path / n)).orderBy("ord").collect()]
    assert read("s.txt") == ["aa", "bb", "aa"] and read("s.csv") == ["cc", "dd"]
    with pytest.raises(ValueError):
        read("s.xml")
    assert {tuple(r) for r in readers.fold_file(spark, str(tmp_path / "f.json"), "/d").collect()} == {(0, "/d/a"), (0, "/d/b"), (1, "/d/c")}
    with pytest.raises(ValueError):
        readers.fold_file(spark, str(tmp_path / "f.json"), None)


# --- booster


def test_booster_finds_planted_features():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 30)).astype(np.float32)
    y = np.stack([10 * x[:, :5].sum(axis=1), 0.02 * x[:, 10:15].sum(axis=1)], axis=1)
    b = boosting.Booster(rounds=60, rate=0.2).fit(x[:300], y[:300], x[300:], y[300:])
    t = b.table()
    assert set(t["label_idx"]) == {0, 1} and (t["tree_id"] % 2 == t["label_idx"]).all()
    gains = t[t["seg_id"].notna()].groupby(["label_idx", "seg_id"])["gain"].sum()
    for label, wanted in ((0, range(5)), (1, range(10, 15))):
        assert set(gains[label].nlargest(5).index) == set(wanted)
    assert np.corrcoef(b.predict(x[300:])[:, 0], y[300:, 0])[0, 1] > 0.8


def test_booster_classifies_and_stops_early():
    r = np.random.default_rng(1)
    x = r.integers(0, 3, (200, 8)).astype(np.float32)
    y = (x[:, 3] > 1).astype(float)
    b = boosting.Booster(binary=True, rounds=400, rate=0.3).fit(x[:150], y[:150], x[150:], 1 - y[150:])
    assert b.table()["tree_id"].max() < 60
    good = boosting.Booster(binary=True, rounds=30, rate=0.3).fit(x[:150], y[:150])
    p = good.predict(x[150:])[:, 0]
    assert ((p > 0.5) == (y[150:] > 0.5)).all() and p.min() > 0 and p.max() < 1


def test_missing_zeros_take_a_learned_side():
    x = np.array([[0.0], [0.0], [0.0], [1.0], [2.0], [3.0]] * 10, dtype=np.float32)
    y = np.array([5.0, 5.0, 5.0, 0.0, 0.0, 5.0] * 10)
    b = boosting.Booster(rounds=50, rate=0.5, zero_as_missing=True).fit(x, y)
    assert np.abs(b.predict(x)[:, 0] - y).max() < 0.1


def test_first_split_equals_an_exhaustive_search():
    r = np.random.default_rng(5)
    x = r.integers(0, 5, (60, 4)).astype(np.float32)
    y = r.normal(size=60)
    root = boosting.Booster(rounds=1).fit(x, y).nodes[0]
    g = y.mean() - y
    best = max(((g[x[:, j] < t].sum() ** 2 / ((x[:, j] < t).sum() + 1) + g[x[:, j] >= t].sum() ** 2 / ((x[:, j] >= t).sum() + 1) - g.sum() ** 2 / 61) / 2, j, t) for j in range(4) for t in (0.5, 1.5, 2.5, 3.5))
    assert root[5] == pytest.approx(best[0]) and root[3] == best[1] and root[4] == best[2]


def matrix_frames(spark, x, y, test):
    counts = spark.createDataFrame([(i, j, int(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]], "sample_id long, seg_id long, n long")
    return counts, spark.createDataFrame([(i, bool(test[i]), float(y[i])) for i in range(len(x))], "sample_id long, is_test boolean, y double")


def tree_rows(fitted):
    return [tuple(q[c] for c in boosting.NODE_COLUMNS) for q in fitted.filter("kind = 'node'").orderBy("tree_id", "node_id").collect()]


def same_trees(got, want):
    got, want = (sorted((tuple(n) for n in x), key=lambda n: n[1:3]) for x in (got, want))
    assert [(n[:4], n[7:10]) for n in got] == [(n[:4], n[7:10]) for n in want]
    for g, w in zip(got, want, strict=True):
        for i in (4, 5, 6, 10):
            assert g[i] is None and w[i] is None or g[i] == pytest.approx(w[i], abs=1e-7)


@pytest.mark.parametrize(("binary", "sparse"), [(True, False), (False, True), (False, False)])
def test_levels_equal_the_booster(spark, binary, sparse):
    from strandloom.plans.levels import fit_levels

    r = np.random.default_rng(8)
    x = r.integers(0, 4, (80, 6)).astype(np.float32) * (r.random((80, 6)) < 0.7)
    x[:, 5] += 1  # a column without zeros
    y = (x[:, 2] + x[:, 4] * (x[:, 1] > 0) > 1.5).astype(float) if binary else x[:, 2] * 2 - x[:, 4] + (x[:, 3] == 0) + r.normal(size=80) * 0.01
    test = np.arange(80) % 4 == 0
    want = boosting.Booster(binary=binary, rounds=2, rate=0.5, zero_as_missing=sparse).fit(x[~test], y[~test], x[test], y[test])
    counts, samples = matrix_frames(spark, x, y, test)
    fitted, base = fit_levels(counts, samples, ["y"], binary=binary, rounds=2, rate=0.5, zero_as_missing=sparse)
    same_trees(tree_rows(fitted), want.nodes)
    assert base[0] == pytest.approx(want.base[0])
    got = {q["sample_id"]: q["prediction"] for q in fitted.filter("kind = 'prediction'").collect()}
    assert [got[i] for i in range(80)] == pytest.approx(want.predict(x)[:, 0].tolist())


@pytest.mark.parametrize("sparse", [False, True])
def test_bins_of_many_values_equal_the_booster(spark, sparse):
    from strandloom.plans.levels import fit_levels, histogram_bins

    r = np.random.default_rng(2)
    x = np.floor(r.exponential(60, (700, 3))).astype(np.float32)
    x[:, 1] *= r.random(700) < 0.2
    y = np.sqrt(x[:, 0]) + (x[:, 1] > 40) * 3 + (x[:, 1] == 0) + r.normal(size=700) * 0.1
    for bins in (256, 20):
        b = boosting.Booster(bins=bins, zero_as_missing=sparse)
        b._bin(boosting.Entries.of(x))
        counts, samples = matrix_frames(spark, x, y, np.zeros(700, bool))
        values, cuts = histogram_bins(counts.select("seg_id", counts.n.cast("double").alias("n")), 700, bins=bins, zero_as_missing=sparse)
        got = {(q["seg_id"], q["bin"]): q["threshold"] for q in cuts.collect()}
        assert got == {(j, k): float(c) for j, cut in enumerate(b.cuts) for k, c in enumerate(cut)}
        place = {(q["seg_id"], q["n"]): q["bin"] for q in values.collect()}
        assert all(place[int(c), float(v)] == k for c, v, k in zip(b.entries.columns, b.entries.values, b.entry_bin, strict=True))
    want = boosting.Booster(rounds=1, rate=0.5, bins=20, zero_as_missing=sparse).fit(x, y)
    same_trees(tree_rows(fit_levels(counts, samples, ["y"], binary=False, rounds=1, rate=0.5, bins=20, zero_as_missing=sparse)[0]), want.nodes)


def test_a_killed_fit_goes_on_to_the_same_trees(spark, tmp_path, monkeypatch):
    from strandloom.plans import levels

    r = np.random.default_rng(9)
    x = r.integers(0, 3, (60, 3)).astype(np.float32)
    y = x[:, 0] - x[:, 1] * x[:, 2] + r.normal(size=60) * 0.1
    counts, samples = matrix_frames(spark, x, y, np.arange(60) % 5 == 0)
    fit = lambda progress: levels.fit_levels(counts, samples, ["y"], binary=False, rounds=5, rate=0.4, depth=1, progress=progress, logged=2)
    want = tree_rows(fit(None)[0])
    grow, grown = levels._one_tree, []

    def killed(*args):
        if len(grown) == 3:
            raise KeyboardInterrupt
        grown.append(args[5])
        return grow(*args)

    monkeypatch.setattr(levels, "_one_tree", killed)
    with pytest.raises(KeyboardInterrupt):
        fit(str(tmp_path / "log"))
    monkeypatch.setattr(levels, "_one_tree", lambda *args: (grown.append(args[5]), grow(*args))[1])
    assert tree_rows(fit(str(tmp_path / "log"))[0]) == want
    assert grown == [0, 1, 2, 2, 3, 4]  # the round after the last logged one is grown again
    assert tree_rows(fit(str(tmp_path / "log"))[0]) == want and len(grown) == 6
    with pytest.raises(ValueError, match="other settings"):
        levels.fit_levels(counts, samples, ["y"], binary=False, rounds=5, rate=0.1, depth=1, progress=str(tmp_path / "log"))


def test_final_fit_beyond_a_task(spark, planted, monkeypatch):
    """The final fit goes by levels where a task would not hold its entries; the trees are the same."""
    settings = SMALL | {"num_rounds": 2, "k": 2, "partition_size_target": 3}
    want = BaselinePipeline(spark, table=planted, label_columns="mic", metric="rmse", **settings).train()
    from strandloom.plans import training

    used = []
    fit = training.fit_levels
    monkeypatch.setattr(training, "fit_levels", lambda *a, **k: (used.append(1), fit(*a, **k))[1])
    monkeypatch.setattr(training, "MOST_BYTES", 1000)
    got = BaselinePipeline(spark, table=planted, label_columns="mic", metric="rmse", **settings).train()
    assert used and got.score == pytest.approx(want.score)
    same_trees(got.model.nodes, want.model.nodes)


def test_entries_equal_the_dense_matrix():
    r = np.random.default_rng(4)
    x = r.integers(0, 4, (90, 7)).astype(np.float32) * (r.random((90, 7)) < 0.4)
    e = boosting.Entries.of(x)
    assert np.array_equal(np.stack([e.column(j) for j in range(7)], axis=1), x)
    keep = r.random(90) < 0.5
    assert np.array_equal(np.stack([e.of_rows(keep).column(j) for j in range(7)], axis=1), x[keep])
    y = x[:, 2] - x[:, 5] + r.normal(size=90) * 0.1
    for missing in (False, True):
        dense, sparse = (boosting.Booster(rounds=9, rate=0.3, zero_as_missing=missing).fit(m, y) for m in (x, e))
        assert dense.nodes == sparse.nodes and np.array_equal(dense.predict(x), sparse.predict(e))
    wide = boosting.Entries(np.array([0, 1]), np.array([0, 4_999_999]), np.array([1.0, 2.0]), (1_000_000, 5_000_000))
    assert wide.column(4_999_999)[1] == 2.0  # no matrix of this shape is made


def test_booster_without_signal_or_rows():
    assert boosting.Booster(rounds=3).fit(np.zeros((5, 2), np.float32), np.arange(5.0)).predict(np.zeros((1, 2)))[0, 0] == pytest.approx(2.0, abs=0.1)
    assert boosting.Booster(rounds=3).fit(np.zeros((4, 0), np.float32), np.ones(4)).predict(np.zeros((2, 0))).tolist() == [[1.0], [1.0]]


# --- runs


def test_planted_motif_regression(spark, planted, tmp_path):
    run = TrainingPipeline(spark, table=planted, label_columns="mic", metric="pearson", export_file=str(tmp_path / "out" / "run"), save_file=str(tmp_path / "pool.json"), **SMALL)
    result = run.run()
    assert result.score > 0.8
    top = [r["Segment"] for r in result.folds[0].segments.top(5).collect()]
    assert any(s in MOTIF or Alphabet().complement_of(s) in MOTIF or MOTIF in s for s in top)
    assert [d["current_max"] for d in run.rounds_done] == [4, 6, 8]
    assert (tmp_path / "out" / "run.csv").exists() and not (tmp_path / "pool.json.progress").exists() and (tmp_path / "pool.json").exists()
    saved = SegmentModel.load(spark, str(tmp_path / "out" / "run_fold_0"))
    texts = [r["sequence"] for r in planted.orderBy("id").limit(6).collect()]
    assert np.allclose(saved.predict_sequences(texts), result.model.predict_sequences(texts))
    frame = result.predictions.toPandas()
    assert {"Prediction", "Actual", "Fold"} <= set(frame) and len(frame) == 12
    table = InferencePipeline(spark, str(tmp_path / "out" / "run_fold_0")).score_table(planted, "sequence")
    assert table.count() == 60 and table.columns == ["sequence", "prediction"]


def test_binary_files(spark, genomes, tmp_path):
    small = {k: v for k, v in SMALL.items() if k not in ("data_column", "id_column")}
    run = TrainingPipeline(spark, label_file=str(genomes / "labels.csv"), label_columns="labels", data_dir=str(genomes), binary=True, folds=2, sparse=True, uint16=True, **small)
    result = run.train()
    assert len(result.folds) == 2 and result.metric.name == "auroc" and result.score >= 0.9
    files = [str(genomes / f"{i:03d}.fna") for i in (1, 0)]
    p = result.model.predict(files)
    assert p[1] > p[0]
    assert np.allclose(p, result.model.predict_sequences([open(f).read() for f in files]))
    prefix = str(tmp_path / "m")
    assert [x.rsplit("/", 1)[1] for x in result.model.save(prefix)] == ["m.json", "m_segs.csv", "m_meta.json"]
    scored = InferencePipeline(spark, prefix).score_files(str(genomes)).collect()
    assert len(scored) == 20 and [r["file"] for r in scored] == sorted(r["file"] for r in scored)
    merged = result.segments.collect()
    assert [r["Importance"] for r in merged] == sorted((r["Importance"] for r in merged), reverse=True)


def test_presence_features(spark, planted):
    run = BaselinePipeline(spark, table=planted, label_columns="mic", metric="rmse", binary_features=True, sparse=True, **(SMALL | {"num_rounds": 5}))
    model = run.train().model
    assert {r["n"] for r in model.count(planted, "id", "sequence").collect()} == {1}
    assert model.metadata()["binary_features"] and np.ptp(model.predict_sequences([r["sequence"] for r in planted.limit(8).collect()])) > 0


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """A file of one row group is read in several partitions of which one has all rows; counting with a model uses all cores."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(5)
    texts = ["".join(r.choices("acgt", k=4000)) for _ in range(400)]
    pq.write_table(pa.table({"doc_id": list(range(400)), "text": texts}), tmp_path / "one.parquet", use_dictionary=False, compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        one = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert one.rdd.getNumPartitions() >= 4 and one.select(F.spark_partition_id()).distinct().count() == 1
        model = SegmentModel(spark, [], [0.0], ["ac", "gg"], [0.0, 0.0], Alphabet("acgt", complement=None), ["y"])
        counts = model.count(one, "doc_id")
        got = {(x["sample_id"], x["seg_id"]): x["n"] for x in counts.collect()}
        per_task = [x["count"] for x in counts.select("sample_id", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(i, k): n for i, t in enumerate(texts) for k, s in enumerate(("ac", "gg")) if (n := sum(t.startswith(s, j) for j in range(len(t))))}
    assert got == want
    assert len(per_task) >= 4 and max(per_task) <= 200


def test_multi_label_and_baseline(spark, planted):
    run = BaselinePipeline(spark, table=planted, label_columns=["mic", "growth"], metric="rmse", standardise_labels=True, **SMALL)
    result = run.train()
    assert set(result.predictions.columns) >= {"Prediction_mic", "Actual_growth"} and len(result.label_scores) == 2
    frame = result.predictions.toPandas()
    assert frame["Prediction_growth"].between(0.4, 0.6).all()
    assert len(result.model.segments) == 136 and run.rounds_done == []
    assert result.model.predict_sequences(["acgt", ""]).shape == (2, 2)
    with pytest.raises(ValueError):
        TrainingPipeline(spark, table=planted, label_columns="mic", binary=True, standardise_labels=True)
    with pytest.raises(ValueError):
        TrainingPipeline(spark, table=planted, label_columns="mic", binary=True, **SMALL).train()


def test_predefined_folds(spark, genomes, tmp_path):
    (tmp_path / "folds.json").write_text(json.dumps({f"fold_{i}": [f"{j:03d}.fna" for j in range(20) if j % 5 == i] for i in range(5)}))
    small = {k: v for k, v in SMALL.items() if k not in ("data_column", "id_column")} | {"target": 4, "num_rounds": 5}
    run = TrainingPipeline(spark, label_file=str(genomes / "labels.csv"), label_columns="labels", data_dir=str(genomes), folds_file=str(tmp_path / "folds.json"), folds=2, metric="rmse", **small)
    result = run.train()
    assert [f.predictions.count() for f in result.folds] == [4, 4]


def test_predefined_folds_beyond_the_number_asked_are_not_used(spark, genomes):
    small = {k: v for k, v in SMALL.items() if k not in ("data_column", "id_column")}
    table = spark.createDataFrame([(j % 5, str(genomes / f"{j:03d}.fna")) for j in range(20)], "fold int, item string")
    make = lambda folds: TrainingPipeline(spark, label_file=str(genomes / "labels.csv"), label_columns="labels", data_dir=str(genomes), fold_table=table, folds=folds, **small)
    samples = readers.label_table(str(genomes / "labels.csv"), "labels", str(genomes), spark)
    for folds, want in ((3, [(0, 4, 8), (1, 4, 8), (2, 4, 8)]), (0, [(0, 4, 16)])):
        assert [(i, s.filter("is_test").count(), s.filter("NOT is_test").count()) for i, s in make(folds)._splits(samples)] == want


def test_nested_cross_validation(spark, planted, tmp_path):
    samples = readers.text_table(planted, "sequence", "mic", "id")
    folds = samples.select("item", (samples.sample_id % 3).cast("int").alias("fold"))
    seen = []

    def make(rest, inner):
        seen.append({r["fold"]: r["x"] for r in inner.join(samples, "item").groupBy("fold").agg({"sample_id": "min"}).withColumnRenamed("min(sample_id)", "x").collect()})
        named = rest.withColumnRenamed("text", "sequence").drop("item")
        return BaselinePipeline(spark, table=named, label_columns="mic", metric="rmse", fold_table=inner, **(SMALL | {"id_column": "sample_id", "k": 3, "num_rounds": 3})).train()

    outer, inner = nested_cross_validation(make, samples, folds, export=str(tmp_path / "n"))
    assert seen == [{0: 1, 1: 2}, {0: 2, 1: 0}, {0: 0, 1: 1}]  # the fold after the outer one is held out by the inner run
    for got in (outer, inner):
        assert got.count() == 60 and got.select("sample_id").distinct().count() == 60 and got.select("Fold").distinct().count() == 3
    assert {(r["sample_id"] % 3 - r["Fold"]) % 3 for r in outer.collect()} == {0} and {(r["sample_id"] % 3 - r["Fold"]) % 3 for r in inner.collect()} == {1}
    assert len(pd.read_csv(tmp_path / "n_nested_test.csv")) == len(pd.read_csv(tmp_path / "n_nested_val.csv")) == 60 and (tmp_path / "n_outer_fold_2.csv").exists()


def test_existing_files_by_a_join(spark, genomes, tmp_path):
    a = str(genomes / "000.fna")
    (tmp_path / "x.fna").write_text(">a\nacgt\n")
    paths = [a, str(genomes / "nope.fna"), "/no/such/folder/x.fna", str(tmp_path / "x.fna"), f"file:{tmp_path}/x.fna", "relative.fna"]
    got = readers.existing(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(r["path"] for r in got.collect()) == sorted([a, str(tmp_path / "x.fna"), f"file:{tmp_path}/x.fna"])


def test_results_and_importance(spark, tmp_path):
    folds = [FoldResult(i, f"m{i}", None, s, [s], None) for i, s in enumerate([0.5, 0.9, 0.9])]
    assert TrainingResult(folds, Metric("auroc")).best_fold.fold == 1 and TrainingResult(folds, Metric("rmse")).model == "m0"
    assert math.isnan(TrainingResult([], Metric("rmse")).score)
    s = SegmentImportance(spark.createDataFrame([(0, "a", 1.0), (1, "NA", 5.0)], "seg_id long, Segment string, Importance double"))
    s.to_csv(str(tmp_path / "s.csv"))
    back = SegmentImportance.from_csv(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in back.to_frame().collect()] == [("a", 1.0), ("NA", 5.0)] and back.top(1).first()["Segment"] == "NA"


def test_model_refuses_foreign_segments(spark):
    m = SegmentModel(spark, [], [0.0], ["xyz"], [0.0], Alphabet(), ["y"])
    with pytest.raises(ValueError):
        m.predict_sequences(["acgt"])


def test_streaming_scores_equal_the_table(spark, planted, tmp_path):
    from strandloom.streaming.scoring import score_stream

    model = BaselinePipeline(spark, table=planted, label_columns="mic", metric="rmse", **(SMALL | {"k": 3, "num_rounds": 5})).train().model
    planted.select("id", "sequence").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, sequence string").parquet(str(tmp_path / "in"))
    q = score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "cp"), id_column="id", text_column="sequence")
    q.awaitTermination(120)
    got = {r["sample_id"]: r["prediction"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["sample_id"]: r["prediction"] for r in model.predict_table(planted, "id", "sequence").collect()}
    assert got == pytest.approx(want) and len(got) == 60


def test_command_line(spark, planted, tmp_path):
    from strandloom import cli

    planted.toPandas().to_csv(tmp_path / "t.csv", index=False)
    out = str(tmp_path / "run")
    assert cli.main(["train", "--table", str(tmp_path / "t.csv"), "--data-column", "sequence", "--label-columns", "mic", "--k", "3", "--target", "3", "--num-rounds", "5", "--metric", "rmse", "--export-file", out, "--baseline", "--id-column", "id", "--backend", "levels", "--count-strategy", "join", "--log", "0"]) == 0
    assert cli.main(["predict", "--model", f"{out}_fold_0", "--table", str(tmp_path / "t.csv"), "--data-column", "sequence", "--out", str(tmp_path / "p"), "--log", "0"]) == 0
    got = pd.read_csv(tmp_path / "p.csv")
    assert list(got) == ["sequence", "prediction"] and len(got) == 60


def test_levels_do_not_shuffle_the_counts(spark):
    from strandloom.plans.lineage import cut_by

    counts = cut_by(spark.range(2000).selectExpr("id % 100 AS sample_id", "id AS seg_id", "1.0 AS n"), "sample_id")
    rows = cut_by(spark.range(100).selectExpr("id AS sample_id", "0 AS node"), "sample_id")
    joined = counts.join(rows.hint("merge"), "sample_id")
    assert "hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2000


def test_models_and_pools_saved_by_spark(spark, tmp_path):
    from strandloom.operators.pool import SegmentPool

    r = np.random.default_rng(3)
    x = r.integers(0, 3, (40, 3)).astype(np.float32)
    b = boosting.Booster(rounds=3, rate=0.5).fit(x, x[:, 0] - x[:, 2])
    model = SegmentModel(spark, [tuple(None if v != v else v for v in n) for n in b.nodes], b.base, ["a", "c", "ag"], [0.5, 0.0, 2.0], Alphabet(), ["y"], uint16=True)
    model.save_table(f"file://{tmp_path}/m")
    got = SegmentModel.load_table(spark, f"file://{tmp_path}/m")
    assert got.nodes == model.nodes and got.segments == model.segments and got.importance == model.importance and got.metadata() == model.metadata()
    texts = ["agagag", "", "ccca", "ttttcct"]
    assert np.array_equal(got.predict_sequences(texts), model.predict_sequences(texts))
    model.save_table(f"file://{tmp_path}/m")  # again, over what is there
    assert SegmentModel.load_table(spark, f"file://{tmp_path}/m").nodes == model.nodes
    SegmentPool.of(spark, ["b", "a", " x "], 2, 4).save_table(f"file://{tmp_path}/p")
    pool = SegmentPool.load_table(spark, f"file://{tmp_path}/p")
    assert (pool.segments(), pool.last_length, pool.current_max) == (["b", "a", " x "], 2, 4)


def test_segment_lists_keep_their_order(spark, tmp_path):
    names = [f"s{i * 7919 % 1000:03d}" for i in range(3000)]
    (tmp_path / "l.txt").write_text("\n".join(["", *names, ""]) + "\n")
    (tmp_path / "l.csv").write_text("Segment,Importance\n" + "".join(f"{n},1.0\n" for n in names))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        for kind in ("txt", "csv"):
            got = readers.segment_list(spark, str(tmp_path / f"l.{kind}")).orderBy("ord").collect()
            assert [r["segment"] for r in got] == names and [r["ord"] for r in got] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    with pytest.raises(ValueError):
        readers.segment_list(spark, "x.json")


def test_selection_beyond_a_task(spark, planted, monkeypatch):
    """A group of columns that no task holds is grown by levels, each group by itself, so the run ends as it would in tasks."""
    from strandloom.plans import training

    settings = SMALL | {"num_rounds": 1, "k": 1, "ext": 1, "target": 2, "features": 6, "partition_size_target": 2}
    run = lambda: TrainingPipeline(spark, table=planted, label_columns="mic", metric="rmse", **settings).train()
    want = run()
    used = []
    fit = training.fit_levels
    monkeypatch.setattr(training, "fit_levels", lambda *a, **k: (used.append(1), fit(*a, **k))[1])
    monkeypatch.setattr(training, "MOST_BYTES", 1000)
    got = run()
    assert len(used) > 2 and got.model.segments == want.model.segments and got.score == pytest.approx(want.score)
    same_trees(got.model.nodes, want.model.nodes)


def test_texts_of_one_row_group_are_dealt_out_once(spark, planted, tmp_path, monkeypatch):
    """Rows of a file of one row group, which one task reads, lie in several partitions from there on, dealt without a sort; and splits have no texts in them."""
    from strandloom.plans import training
    from strandloom.plans.lineage import dealt

    planted.coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    got = readers.text_table(rows, "sequence", "mic", "id")
    held = got.groupBy(F.spark_partition_id()).count().collect()
    assert got.count() == 60 and len(held) == spark.sparkContext.defaultParallelism and max(r["count"] for r in held) < 40
    plan = dealt(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "RoundRobin" not in plan
    split, columns = training.hold_out, []
    monkeypatch.setattr(training, "hold_out", lambda df, **k: (columns.append(df.columns), split(df, **k))[1])
    settings = SMALL | {"num_rounds": 2, "k": 2}
    result = BaselinePipeline(spark, table=rows, label_columns="mic", metric="rmse", **settings).train()
    assert columns == [["sample_id", "item", "mic"]] and result.predictions.count() == 12


def test_final_fit_of_few_trees(spark, planted, monkeypatch):
    """The final fit goes by levels where one task would be longer at taking in its entries; trees and predictions are the same."""
    from strandloom.plans import training

    settings = SMALL | {"num_rounds": 1, "depth": 1, "k": 2}
    used = []
    fit = training.fit_levels
    monkeypatch.setattr(training, "fit_levels", lambda *a, **k: (used.append(1), fit(*a, **k))[1])
    run = lambda **how: BaselinePipeline(spark, table=planted, label_columns="mic", metric="rmse", **(settings | how)).train()
    pairs = lambda result: sorted((r["sample_id"], round(r["Prediction"], 9)) for r in result.predictions.collect())
    for sparse in (False, True):
        used.clear()
        monkeypatch.setattr(training, "PASS_ENTRIES", 1 << 21)
        want = run(sparse=sparse)
        assert not used
        monkeypatch.setattr(training, "PASS_ENTRIES", 100)
        got = run(sparse=sparse)
        assert used and pairs(got) == pairs(want)
        same_trees(got.model.nodes, want.model.nodes)
        used.clear()
        assert pairs(run(sparse=sparse, final_backend="tasks")) == pairs(want) and not used
