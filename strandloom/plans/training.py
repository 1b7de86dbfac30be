"""Training: select, thin out and extend segments round by round, then fit a final model; and inference."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.alphabet import AUTO, DNA, Alphabet
from strandloom.functions.sequence import contigs
from strandloom.operators.counting import count_chunks, count_segments, stored
from strandloom.operators.metrics import Metric, check_binary
from strandloom.operators.pool import SegmentPool, near_equal_parts, partition_of
from strandloom.operators.selection import LabelScaler, mean_gain, rank_importance, scale_mismatch, top_features, with_importance
from strandloom.operators.splits import hold_out, inner_folds, nested_folds, predefined_folds, stratified_folds
from strandloom.plans.boosting import DEPTH, NODE_COLUMNS
from strandloom.plans.fitting import ENTRY_BYTES, MOST_BYTES, fit_partitions, largest_part, mean_predictions, tree_nodes
from strandloom.plans.levels import fit_levels
from strandloom.plans.lineage import cut, number_rows, spread
from strandloom.plans.model import SegmentModel
from strandloom.plans.results import FoldResult, SegmentImportance, TrainingResult, prediction_columns, wide_predictions, write_csv
from strandloom.sources.labels import label_names
from strandloom.sources.readers import DEFAULT_LABEL, SEQUENCE_FILES, build_source, fold_file, item_chunks, segment_list

log = logging.getLogger("strandloom")
#: Where trees are grown: whole groups of columns in tasks, or level by level over all columns and any number of samples.
BACKENDS = ("tasks", "levels")
#: Entries that one task takes in, at least, in the time of a pass over blocks by all tasks.
PASS_ENTRIES = 1 << 21


@dataclass
class TrainingPipeline:
    """One run over a table of texts or labelled sequence files.

    ``folds`` 0 is one stratified 80 : 20 split, or with predefined folds (``folds_file``, or a table ``fold_table`` of ``fold, item``) fold 0 held
    out from all others; with ``folds`` n the folds 0..n-1 are held out in turn, and folds beyond these are not used. ``train()`` keeps
    everything in memory; ``run()`` also writes ``export_file`` and resumes from ``save_file``. The held-out rows also stop the boosting.

    ``backend`` says how trees are grown: ``tasks`` fits a booster for each feature partition in a task, which holds the
    labels of all samples and the entries of its columns; ``levels`` grows the same trees by joins, over all columns and any number of samples.
    The final fit has one group of all columns; it takes ``final_backend``, or ``levels`` where its entries are more than a task holds or its trees so few that one task would be longer at reading them.
    ``fit_progress`` names a folder in which fits by ``levels`` log their rounds, to go on from after a crash; one folder for one run.
    """

    spark: SparkSession
    table: DataFrame | str | None = None
    data_column: str | None = None
    label_file: object = None
    label_columns: str | list[str] | None = None
    data_dir: str | None = None
    id_column: str | None = None
    k: int = 6
    ext: int = 2
    target: int = 70
    features: int = 10_000
    folds: int = 0
    folds_file: str | None = None
    fold_table: DataFrame | None = None
    ea_min: float | None = None
    ea_max: float | None = None
    num_rounds: int = 1500
    lr: float = 0.03
    depth: int = DEPTH
    alphabet: str | Alphabet = DNA
    case_sensitive: bool = False
    complement: object = AUTO
    keep_unknown: bool = False
    uint16: bool = False
    sparse: bool = False
    binary_features: bool = False
    partition_size_target: int = 5000
    metric: str | None = None
    binary: bool = False
    standardise_labels: bool = False
    export_file: str | None = None
    save_file: str | None = None
    import_file: str | None = None
    count_strategy: str = "auto"
    baseline: bool = False
    backend: str = "tasks"
    final_backend: str | None = None
    fit_progress: str | None = None
    rounds_done: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.backend not in BACKENDS or self.final_backend not in (None, *BACKENDS):
            raise ValueError(f"backend is one of {BACKENDS}")
        if self.standardise_labels and self.binary:
            raise ValueError("binary labels are not standardised")
        if not isinstance(self.alphabet, Alphabet):
            self.alphabet = Alphabet(self.alphabet, case_sensitive=self.case_sensitive, complement=self.complement)
        self.labels = label_names(self.label_columns, DEFAULT_LABEL if self.table is not None else None)
        self.scorer = Metric(self.metric or Metric.default(self.binary), ea_min=self.ea_min, ea_max=self.ea_max)

    # --- entry points

    def run(self) -> TrainingResult:
        return self._run(write=True)

    def train(self) -> TrainingResult:
        return self._run(write=False)

    def _run(self, write: bool) -> TrainingResult:
        samples = build_source(self.spark, table=self.table, data_column=self.data_column, label_file=self.label_file, label_columns=self.labels, data_dir=self.data_dir, id_column=self.id_column)
        texts = None
        if "text" in samples.columns and not (self.folds_file or self.fold_table is not None):  # all samples are used: their texts need not be sorted and stored with each split
            texts, samples = samples.select("sample_id", "text"), samples.drop("text")
        samples = cut(samples)
        if self.binary:
            check_binary(samples, self.labels)
        elif not self.standardise_labels and scale_mismatch(samples, self.labels):
            log.warning("the labels' scales differ widely; standardise_labels balances them")
        result = TrainingResult(metric=self.scorer)
        progress = f"{self.save_file}.progress" if self.save_file else None
        done = json.loads(Path(progress).read_text()) if write and progress and os.path.exists(progress) else {"fold": 0}
        for fold, split in self._splits(samples):
            if fold < done["fold"]:
                continue
            result.folds.append(self._fold(fold, split, texts, write))
            if write and progress:
                Path(progress).parent.mkdir(parents=True, exist_ok=True)
                Path(progress).write_text(json.dumps({"fold": fold + 1, "scores": result.scores}))
        if write:
            if progress and os.path.exists(progress):  # a finished run leaves no resume point
                os.remove(progress)
            if self.export_file and result.folds:
                Path(self.export_file).parent.mkdir(parents=True, exist_ok=True)
                write_csv(result.predictions, f"{self.export_file}.csv")
                for f in result.folds:
                    f.model.save(f"{self.export_file}_fold_{f.fold}")
        return result

    def _splits(self, samples: DataFrame):
        """``(fold, samples with is_test)``; with several labels nothing is stratified."""
        label = self.labels[0] if len(self.labels) == 1 else None
        if self.folds_file or self.fold_table is not None:
            table = cut(self.fold_table if self.fold_table is not None else fold_file(self.spark, self.folds_file, self.data_dir))
            for i in range(max(1, self.folds)):
                train, test = predefined_folds(samples, table, i, self.folds)
                yield i, cut(train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True))))
        elif self.folds > 1:
            marked = cut(stratified_folds(samples, self.folds, label=label))
            for i in range(self.folds):
                yield i, marked.withColumn("is_test", F.col("fold") == i)
        else:
            yield 0, cut(hold_out(samples, label=label))

    # --- one fold

    def _nodes(self, samples: DataFrame, texts: DataFrame | None, longest: int) -> DataFrame:
        """The contigs of texts, or chunks of the contigs of files in which windows of up to ``longest`` are whole."""
        if texts is not None:
            return cut(contigs(texts, self.alphabet, keep_unknown=self.keep_unknown))
        if "text" in samples.columns:
            return cut(contigs(spread(samples.select("sample_id", "text")), self.alphabet, keep_unknown=self.keep_unknown))
        return cut(item_chunks(samples, self.alphabet, longest - 1, keep_unknown=self.keep_unknown))

    def _counts(self, nodes: DataFrame, pool: SegmentPool) -> DataFrame:
        count = count_chunks if "own" in nodes.columns else count_segments
        got = count(nodes, pool.table, self.alphabet, strategy=self.count_strategy)
        return cut(got.select("sample_id", "seg_id", stored("n", uint16=self.uint16, presence=self.binary_features).alias("n")))

    def _fit(self, counts: DataFrame, samples: DataFrame, n: int, target: int, backend: str, step: str):
        log_of = f"{self.fit_progress}/{step}" if self.fit_progress else None
        levels = {"binary": self.binary, "rounds": self.num_rounds, "rate": self.lr, "depth": self.depth, "zero_as_missing": self.sparse}
        if backend == "levels":
            return fit_levels(counts, samples, self.labels, progress=log_of, **levels)
        parts = near_equal_parts(n, target)[0]
        if largest_part(counts, n, target) * ENTRY_BYTES > MOST_BYTES:  # more than a task holds: the same boosters, each grown by levels
            log.info("%s: a group of columns is more than a task holds; grown by levels", step)
            fitted = base = None
            for i in range(parts):
                one, base = fit_levels(counts.filter(partition_of("seg_id", n, target) == i), samples, self.labels, progress=log_of and f"{log_of}/part={i}", **levels)
                one = one.withColumn("part", F.lit(i))
                fitted = one if fitted is None else fitted.unionByName(one)
            return fitted, base
        return fit_partitions(counts, samples, n, self.labels, target=target, binary=self.binary, rounds=self.num_rounds, rate=self.lr, zero_as_missing=self.sparse, depth=self.depth)

    def _last_backend(self, entries: int) -> str:
        """Where the final fit, one group of all columns, is made: by levels if no task holds its entries, or the passes of its trees are sooner done than a task has these."""
        passes = self.num_rounds * (self.depth + 1) * len(self.labels)
        return "levels" if entries * ENTRY_BYTES > MOST_BYTES or entries > PASS_ENTRIES * passes else self.backend

    def _first_pool(self) -> SegmentPool:
        if self.import_file and os.path.exists(self.import_file):
            if self.import_file.endswith(".json"):
                return SegmentPool.load(self.spark, self.import_file)
            listed = segment_list(self.spark, self.import_file)
            longest = listed.agg(F.max(F.length("segment"))).first()[0] or 0
            return SegmentPool(number_rows(listed, [F.col("ord").asc()], "seg_id").select("seg_id", "segment"), longest - self.ext, longest)
        return SegmentPool.seed(self.spark, self.alphabet, self.k, self.ext)

    def _fold(self, fold: int, samples: DataFrame, texts: DataFrame | None, write: bool) -> FoldResult:
        scaler = LabelScaler.fit(samples.filter("NOT is_test"), self.labels) if self.standardise_labels else None
        fitted_on = scaler.transform(samples) if scaler else samples
        pool = self._first_pool()
        nodes = self._nodes(samples, texts, max(pool.current_max, self.target) + self.ext)
        n = pool.table.count()
        counts = self._counts(nodes, pool)
        while not self.baseline:
            fitted, _ = self._fit(counts, fitted_on, n, self.partition_size_target, self.backend, f"fold={fold}/length={pool.current_max}")
            importance = rank_importance(mean_gain(tree_nodes(fitted)), len(self.labels))
            best = top_features(importance, self.features)
            ranked = number_rows(best, [F.desc("importance"), F.col("seg_id").asc()], "rank").select("seg_id", "rank")
            if ranked.isEmpty():
                log.warning("no feature has gained anything; all are kept")
            else:
                pool = pool.subset(ranked).without_redundancy()
            self.rounds_done.append({"fold": fold, "current_max": pool.current_max, "kept": pool.table.count()})
            grown = None if pool.current_max >= self.target else pool.extended(self.alphabet, self.ext)
            pool = grown or pool
            n = pool.table.count()
            counts = self._counts(nodes, pool)
            if grown is None:
                break
            if write and self.save_file:
                pool.save(self.save_file)
        last = self.final_backend or self._last_backend(counts.count() if self.backend == "tasks" else 0)
        fitted, base = self._fit(counts, fitted_on, n, 0, last, f"fold={fold}/final")
        trees = tree_nodes(fitted)
        importance = rank_importance(mean_gain(trees), len(self.labels))
        listed = with_importance(pool.table, importance).orderBy("seg_id").toPandas()
        rows = [tuple(None if v != v else v for v in r) for r in trees.select(*NODE_COLUMNS).orderBy("tree_id", "node_id").collect()]
        model = SegmentModel(
            self.spark, rows, base, listed["Segment"].tolist(), listed["Importance"].tolist(), self.alphabet, self.labels, binary=self.binary, sparse=self.sparse, uint16=self.uint16, binary_features=self.binary_features,
            keep_unknown=self.keep_unknown, scaler=scaler,
        )
        pairs = prediction_columns(self.labels)
        held = wide_predictions(mean_predictions(fitted), samples.filter("is_test"), self.labels)
        if scaler:
            held = scaler.inverse(held, [p for _, p in pairs])
        held = cut(held)
        score, each = self.scorer.score_labels(held, pairs)
        log.info("fold %d: %s %.4f", fold, self.scorer.name, score)
        return FoldResult(fold, model, held, score, each, SegmentImportance(with_importance(pool.table, importance)))


class BaselinePipeline(TrainingPipeline):
    """All k-mers, no selection, no extension, one booster."""

    def __init__(self, *args, **kwargs) -> None:
        super().__init__(*args, **{**kwargs, "baseline": True})


def nested_cross_validation(make, samples: DataFrame, folds: DataFrame, *, export: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Outer folds held out from whole inner runs; the predictions for the outer folds and for the inner held-out ones, both with ``Fold``.

    ``folds(fold, item)`` are numbered from 0. For each outer fold, ``make(samples, fold_table)`` trains on the others, numbered so that
    the next one is fold 0, which that run holds out, and returns its ``TrainingResult``. With ``export``, writes
    ``<export>_inner_fold_<i>.csv``, ``<export>_outer_fold_<i>.csv``, ``<export>_nested_test.csv`` and ``<export>_nested_val.csv``.
    """
    folds = cut(folds)
    outer_all = inner_all = None
    for i, inner in nested_folds(1 + folds.agg(F.max("fold")).first()[0]):
        rest, held = (samples.join(folds.filter(f).select("item"), "item") for f in (F.col("fold") != i, F.col("fold") == i))
        result = make(rest, inner_folds(folds, i, inner))
        scored = cut(result.model.predict_table(held).join(held.select("sample_id", "item"), "sample_id").withColumn("Fold", F.lit(i)))
        checked = result.predictions.withColumn("Fold", F.lit(i))
        if export:
            write_csv(checked, f"{export}_inner_fold_{i}.csv")
            write_csv(scored, f"{export}_outer_fold_{i}.csv")
        outer_all = scored if outer_all is None else outer_all.unionByName(scored)
        inner_all = checked if inner_all is None else inner_all.unionByName(checked)
    if export and outer_all is not None:
        write_csv(outer_all, f"{export}_nested_test.csv")
        write_csv(inner_all, f"{export}_nested_val.csv")
    return outer_all, inner_all


@dataclass
class InferencePipeline:
    """Scores files or a table with a saved model; the model stays loaded between calls."""

    spark: SparkSession
    model_path: str

    def __post_init__(self) -> None:
        self.model = SegmentModel.load(self.spark, self.model_path)
        bad = [s for s in self.model.segments if not self.model.alphabet.fits(s)]
        if bad:
            raise ValueError(f"segments outside the alphabet: {bad[:5]}")

    def _named(self, scored: DataFrame, rows: DataFrame, name: str) -> DataFrame:
        return scored.join(rows.select("sample_id", F.col("item").alias(name)), "sample_id").orderBy("sample_id").drop("sample_id").select(name, *[c for c in scored.columns if c != "sample_id"])

    def score_files(self, files: list[str] | str) -> DataFrame:
        """``file, prediction`` of a list of files, or of the sequence files of a folder, sorted by path."""
        scored = self.model.predict_files(files, SEQUENCE_FILES if isinstance(files, str) else None)
        return scored.withColumnRenamed("sample_id", "file").orderBy("file")

    def score_table(self, table: DataFrame, data_column: str) -> DataFrame:
        """The text column with its prediction, row by row."""
        rows = cut(table.select(F.monotonically_increasing_id().alias("sample_id"), F.col(data_column).alias("item"), F.col(data_column).alias("text")))
        return self._named(self.model.predict_table(rows), rows, data_column)
