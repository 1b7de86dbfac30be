"""Incremental job: canonical k-mer counts of every new sample, and profiles of the sources they come from.

Whoever trains or monitors on sequences wants each sample counted once, when it arrives. The folder of samples is read as a file
stream that takes what its checkpoint has not seen and stops (``availableNow``); each micro-batch is written under its own number, so one that
is repeated after a crash replaces itself. Under ``out`` there are

* ``samples/batch=N``: id, source, characters and a digest of every sample that was taken,
* ``counts/batch=N/part=...``: ``sample_id, source, code, n``,
* ``profiles/batch=N``: per source and k-mer what the batch adds, ``n`` and ``samples``; these add up (``profiles()``),
* ``rejects/batch=N``: rows without an id or a text, and samples that came before, with the reason,
* ``settings``: what the codes mean; a run with other settings is refused.

A sample's first version stays: an id that is stored already, or again in one batch, is rejected, so counts of a batch never change and sums of batches are right.
A run costs what is new (and a look at the ids stored). Counts are written by source in parts of even size, so a source with a third of all rows is not one file or task.

    python -m jobs.kmer_profiles --documents in/ --out out/ --checkpoint mark/ --config jobs/kmer_profiles.json
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import check_settings, command_line, keep_settings, read_settings, stored
from strandloom.functions.alphabet import Alphabet
from strandloom.functions.sequence import contigs
from strandloom.operators.counting import kmer_histogram
from strandloom.plans.lineage import spread

log = logging.getLogger("jobs.kmer_profiles")

DEFAULTS: dict[str, Any] = {"id_column": "doc_id", "text_column": "text", "source_column": "source", "alphabet": "atgc", "k": 6, "fasta": False, "files_per_batch": 1000}
#: Settings that the stored numbers depend on.
MEANING = ("id_column", "text_column", "source_column", "alphabet", "k", "fasta")

SAMPLES = "sample_id string, source string, n_chars long, digest string"
COUNTS = "sample_id string, source string, code long, n long"
PROFILES = "source string, code long, n long, samples long"
REJECTS = "sample_id string, source string, reason string"


def _write(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = (df.hint("rebalance", by) if by else df).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    log.info("wrote %s", path)


def take(batch: DataFrame, epoch: int, out: str, s: dict[str, Any]) -> None:
    """One micro-batch: its new samples, their counts and what these add to the profiles, each under the batch's number."""
    spark = batch.sparkSession
    rows = spread(batch.select(F.col(s["id_column"]).cast("string").alias("sample_id"), F.col(s["source_column"]).cast("string").alias("source"), F.col(s["text_column"]).alias("text")))
    no_id, no_text = F.col("sample_id").isNull(), F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    reason = F.when(no_id, "no id").when(no_text, "no text")
    known = stored(spark, f"{out}/samples", SAMPLES, "batch long").filter(F.col("batch") < epoch).select("sample_id")
    # one version of an id: the least digest of its source and text; of equal rows the aggregation leaves one
    usable = rows.filter(~no_id & ~no_text).withColumn("digest", F.sha2(F.concat_ws("\n", F.coalesce("source", F.lit("")), "text"), 256))
    versions = usable.groupBy("sample_id").agg(F.min(F.struct("digest", "source", F.length("text").cast("long").alias("n_chars"))).alias("v"), F.count(F.lit(1)).alias("rows"))
    fresh = versions.join(known, "sample_id", "left_anti").select("sample_id", "v.source", "v.n_chars", "v.digest")
    _write(fresh, f"{out}/samples/batch={epoch}")
    taken = spark.read.schema(SAMPLES).parquet(f"{out}/samples/batch={epoch}")

    again = versions.join(known, "sample_id", "left_semi").select("sample_id", "v.source", F.lit("came before").alias("reason"))
    more = versions.join(known, "sample_id", "left_anti").filter("rows > 1").select("sample_id", "v.source", F.lit("more than once").alias("reason"))
    _write(rows.select("sample_id", "source", reason.alias("reason")).filter("reason IS NOT NULL").unionByName(again).unionByName(more), f"{out}/rejects/batch={epoch}")

    alphabet = Alphabet(s["alphabet"])
    # a sample's source goes with its text, not with each of its counts: these are written as they come
    texts = usable.drop("source").join(taken.select("sample_id", "digest", "source"), ["sample_id", "digest"]).dropDuplicates(["sample_id"])
    keyed = texts.select(F.struct("sample_id", "source").alias("key"), "text")
    counts = kmer_histogram(contigs(keyed, alphabet, id_column="key", fasta=s["fasta"]), alphabet, s["k"], once=not s["fasta"])
    named = counts.select("sample_id.sample_id", "sample_id.source", "code", "n").withColumn("part", F.coalesce(F.concat(F.lit("s_"), F.col("source")), F.lit("none")))
    _write(named, f"{out}/counts/batch={epoch}", "part")
    written = stored(spark, f"{out}/counts/batch={epoch}", COUNTS, "part string")
    _write(written.groupBy("source", "code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("samples")), f"{out}/profiles/batch={epoch}")
    log.info("batch %d: took %d samples", epoch, taken.count())


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: str | None = None, settings: dict[str, Any] | None = None) -> dict[str, int]:
    """Takes what is new under ``documents`` (Parquet) and waits until it is stored. Returns the numbers of batches and samples stored in all."""
    s = read_settings(spark, config, DEFAULTS) if settings is None else check_settings(settings, DEFAULTS)
    keep_settings(spark, f"{out}/settings", {k: s[k] for k in MEANING})
    log.info("reads %s, mark %s", documents, checkpoint)
    schema = spark.read.parquet(documents).schema
    # as a pattern, the path may name a folder or a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", s["files_per_batch"]).parquet(f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]")
    query = stream.writeStream.foreachBatch(lambda batch, epoch: take(batch, epoch, out, s)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = stored(spark, f"{out}/samples", SAMPLES, "batch long").agg(F.count_distinct("batch"), F.count(F.lit(1))).first()
    log.info("stored: %d batches with samples, %d samples", *done)
    return {"batches": done[0], "samples": done[1]}


def sample_counts(spark: SparkSession, out: str) -> DataFrame:
    """``sample_id, source, code, n`` of all samples stored."""
    return stored(spark, f"{out}/counts", COUNTS, "batch long, part string").select("sample_id", "source", "code", "n")


def profiles(spark: SparkSession, out: str) -> DataFrame:
    """``source, code, n, samples`` over all batches."""
    return stored(spark, f"{out}/profiles", PROFILES, "batch long").groupBy("source", "code").agg(F.sum("n").alias("n"), F.sum("samples").alias("samples"))


if __name__ == "__main__":
    raise SystemExit(command_line(run, "kmer profiles", {"documents": "folder of Parquet files of samples", "out": "folder of the stored tables", "checkpoint": "folder of the stream's mark"}))
