"""Batch job: a labelled table of texts to a training matrix of informative segments, by fold.

What a booster outside of Spark (or the pipelines of this library) is trained on: samples are joined with their labels, dealt to stratified folds,
and counted for the segments that tell the classes apart best. Segments are chosen without the rows of the fold ``test_fold``, so that fold
can judge a model. Under ``out`` there are

* ``segments`` (CSV with a header): ``seg_id, segment, positives, negatives, score``, best first; ``seg_id`` is the matrix column,
* ``matrix/fold=F`` (Parquet): ``sample_id, label, indices, values``, a sparse row per sample, empty ones included,
* ``folds`` (JSON): rows, positives and entries of every fold,
* ``rejects`` (Parquet): labels without a text or value, and how often an id came, with the reason.

A segment's score is ``abs(p n0 - q n1)`` for the ``p`` of ``n1`` positive and ``q`` of ``n0`` negative training samples that hold it: whole numbers, so reruns and other engines agree; equal
scores go by segment. All files are overwritten, so a rerun leaves the same output. Segments are aggregated per sample before they are shuffled, and only the chosen ones (``features`` at most) reach the counting plan.

    python -m jobs.training_matrix --documents docs/ --labels labels/ --out out/ --config jobs/training_matrix.json
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import check_settings, command_line, read_settings, stored
from strandloom.functions.alphabet import Alphabet
from strandloom.functions.sequence import contigs, windows
from strandloom.operators.counting import count_segments, sparse_counts
from strandloom.operators.counting import stored as storage
from strandloom.operators.splits import stratified_folds
from strandloom.operators.window_counts import count_windows, countable
from strandloom.plans.lineage import cut, number_rows, spread
from strandloom.sources.labels import numeric, require_columns, without_labels

log = logging.getLogger("jobs.training_matrix")

DEFAULTS: dict[str, Any] = {
    "id_column": "doc_id", "text_column": "text", "label_column": "quality", "alphabet": "abcdefghijklmnopqrstuvwxyz ", "fasta": False,
    "lengths": [3, 4], "features": 200, "min_samples": 2, "folds": 5, "test_fold": 0, "uint16": True, "presence": False,
}
#: Segments may begin or end with a space.
CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
SEGMENTS = "seg_id long, segment string, positives long, negatives long, score decimal(38,0)"
MATRIX = "sample_id long, label double, indices array<long>, values array<long>"


def labelled(documents: DataFrame, labels: DataFrame, s: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """``sample_id, label, text`` of the samples to use, and ``sample_id, reason`` of the rest."""
    require_columns(documents, [s["id_column"], s["text_column"]])
    require_columns(labels, [s["id_column"], s["label_column"]])
    texts = documents.select(F.col(s["id_column"]).cast("long").alias("sample_id"), F.col(s["text_column"]).alias("text"))
    texts = texts.filter(F.col("sample_id").isNotNull() & F.col("text").rlike(r"\S")).groupBy("sample_id").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("texts"))
    marks = labels.select(F.col(s["id_column"]).cast("long").alias("sample_id"), numeric(labels, s["label_column"]).alias("label"))
    marks = marks.filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min("label").alias("label"), F.max("label").alias("most"), F.count(F.lit(1)).alias("labels"))
    good = marks.filter("label IN (0, 1) AND label = most")
    both = good.join(texts, "sample_id")
    bad = marks.filter("label IS NULL OR label NOT IN (0, 1) OR label <> most").select("sample_id", F.when(F.col("label") != F.col("most"), "labels differ").otherwise("label is not 0 or 1").alias("reason"))
    rejects = bad.unionByName(without_labels(good, texts, "sample_id").select("sample_id", F.lit("no text").alias("reason")))
    rejects = rejects.unionByName(both.filter("texts > 1").select("sample_id", F.lit("more than one text").alias("reason")))
    return both.select("sample_id", "label", "text"), rejects


def informative(samples: DataFrame, nodes: DataFrame, s: dict[str, Any], alphabet: Alphabet) -> DataFrame:
    """The ``features`` segments of the given lengths that tell the classes apart best, numbered."""
    n1, n0 = samples.agg(F.count_if(F.expr("label = 1")), F.count_if(F.expr("label = 0"))).first()
    named = nodes.join(samples.select("sample_id", "label"), "sample_id")
    if countable(alphabet, s["lengths"]):  # a row for each segment that a text holds, with its label
        held = count_windows(named, alphabet, s["lengths"], keep=("sample_id", "label")).drop("n")
    else:
        held = windows(named, s["lengths"], keep=("sample_id", "label")).select("sample_id", "label", alphabet.canonical("window").alias("segment"))
    if s["fasta"] or not countable(alphabet, s["lengths"]):  # several contigs a sample, or a row for each place
        held = held.distinct()
    by_class = held.groupBy("segment").agg(F.count_if(F.expr("label = 1")).alias("positives"), F.count_if(F.expr("label = 0")).alias("negatives"))
    wide = lambda c, n: F.col(c).cast("decimal(19,0)") * F.lit(n or 0).cast("decimal(18,0)")
    score = F.abs(wide("positives", n0) - wide("negatives", n1)).cast("decimal(38,0)")
    order = [F.desc("score"), F.asc("segment")]
    best = by_class.filter(F.col("positives") + F.col("negatives") >= s["min_samples"]).withColumn("score", score).orderBy(*order).limit(s["features"])
    return number_rows(best, order, "seg_id").select("seg_id", "segment", "positives", "negatives", "score")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: str | None = None, settings: dict[str, Any] | None = None) -> dict[str, int]:
    """Builds the matrix of all labelled samples. Returns the numbers of rows, segments and entries written."""
    s = read_settings(spark, config, DEFAULTS) if settings is None else check_settings(settings, DEFAULTS)
    if not 0 <= s["test_fold"] < s["folds"]:
        raise ValueError("test_fold is not one of the folds")
    log.info("reads %s and %s", documents, labels)
    alphabet = Alphabet(s["alphabet"])
    usable, rejects = labelled(spread(spark.read.parquet(documents)), spark.read.parquet(labels), s)
    usable = cut(usable)  # the texts are joined with their labels once
    rejects.write.mode("overwrite").parquet(f"{out}/rejects")
    samples = cut(stratified_folds(usable.select("sample_id", "label"), s["folds"], label="label").select("sample_id", "label", "fold"))
    nodes = contigs(usable.select("sample_id", "text"), alphabet, fasta=s["fasta"])

    train = samples.filter(F.col("fold") != s["test_fold"])
    chosen = informative(train, nodes, s, alphabet)
    chosen.coalesce(1).write.mode("overwrite").options(**CSV).csv(f"{out}/segments")  # as many rows as there are features
    log.info("wrote %s/segments", out)
    pool = segments(spark, out)
    counts = count_segments(nodes, pool.select("seg_id", "segment"), alphabet).select("sample_id", "seg_id", storage("n", uint16=s["uint16"], presence=s["presence"]).alias("n"))
    none = F.array().cast("array<bigint>")
    rows = samples.join(sparse_counts(counts), "sample_id", "left").select("sample_id", "label", F.coalesce("indices", none).alias("indices"), F.coalesce("values", none).alias("values"), "fold")
    rows.hint("rebalance", "fold").write.mode("overwrite").partitionBy("fold").parquet(f"{out}/matrix")
    log.info("wrote %s/matrix", out)
    per_fold = stored(spark, f"{out}/matrix", MATRIX, "fold int").groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("label = 1")).alias("positives"), F.sum(F.size("indices")).alias("entries"))
    per_fold.coalesce(1).write.mode("overwrite").json(f"{out}/folds")  # a row for each fold
    total = spark.read.schema("fold int, rows long, positives long, entries long").json(f"{out}/folds").agg(F.sum("rows"), F.sum("entries")).first()
    found = {"rows": total[0] or 0, "segments": pool.count(), "entries": total[1] or 0}
    log.info("stored: %s", found)
    return found


def segments(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).options(**CSV).csv(f"{out}/segments")


def entries(spark: SparkSession, out: str) -> DataFrame:
    """``fold, sample_id, label, seg_id, segment, n``: the matrix in its long form, a row with nulls for a sample without entries."""
    m = stored(spark, f"{out}/matrix", MATRIX, "fold int")
    long = m.select("fold", "sample_id", "label", F.explode_outer(F.arrays_zip("indices", "values")).alias("e")).select("fold", "sample_id", "label", F.col("e.indices").alias("seg_id"), F.col("e.values").alias("n"))
    return long.join(F.broadcast(segments(spark, out).select("seg_id", "segment")), "seg_id", "left").select("fold", "sample_id", "label", "seg_id", "segment", "n")


if __name__ == "__main__":
    raise SystemExit(command_line(run, "training matrix", {"documents": "Parquet table of texts", "labels": "Parquet table of labels", "out": "folder of the matrix"}))
