"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key is hot with more than this part of all rows, so there are fewer hot keys than this.
HOT_KEYS = 1000
#: Keys that are sent to every task at most.
SENT_KEYS = 10_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one where it is unset and the master is local (tests), else an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="strandloom-")
    sc.setCheckpointDir(shared)
    return shared


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column as Python strings, null read as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Cut a record batch into runs of rows whose texts hold about ``max_bytes``, at least one row each."""
    col = batch.column(column)
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    part = np.cumsum(size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def split_hot(rows: DataFrame, key: str, member: str, chunk: int, own: str | None = None) -> DataFrame:
    """Deal the rows of large keys out to several cells, so that every pair of members still meets.

    A key with at most ``chunk`` rows keeps one cell (0, 0). A larger key has its members hashed
    into b = ceil(rows / chunk) parts and each member goes to the b cells (i, j), i <= j, that
    hold its part; two members of any parts i, j meet in the cell (i, j). Adds ``ci``, ``cj``, and the
    member's own part under the name ``own``. Members of large keys are told so by a broadcast while there are fewer than ``SENT_KEYS`` such
    keys; beyond that, only the few hottest are, and the rows of these are spread over the join with the others.
    """
    large = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > chunk).withColumn("__b", F.ceil(F.col("__n") / chunk).cast("int")))
    n_keys, total = large.agg(F.count(F.lit(1)), F.sum("__n")).first()
    if not n_keys:
        dealt = rows.withColumn("__b", F.lit(1))
    elif n_keys < SENT_KEYS:
        dealt = rows.join(F.broadcast(large.drop("__n")), key, "left").withColumn("__b", F.coalesce("__b", F.lit(1)))
    else:
        hot = large.filter(F.col("__n") * HOT_KEYS > total).select(key, F.col("__b").alias("__h"))
        cold = large.filter(F.col("__n") * HOT_KEYS <= total).select(key, "__b", F.lit(0).cast("long").alias("__s"))
        spread = F.when(F.col("__h").isNotNull(), F.pmod(F.xxhash64(member), F.lit(997)) + 1).otherwise(F.lit(0).cast("long"))
        dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__s", spread).join(cold, [key, "__s"], "left")
        dealt = dealt.withColumn("__b", F.coalesce("__h", "__b", F.lit(1))).drop("__h", "__s")
    dealt = dealt.withColumn("__c", F.pmod(F.xxhash64(F.lit(7), F.col(member)), F.col("__b")).cast("int"))
    dealt = dealt.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    if own:
        dealt = dealt.withColumn(own, F.col("__c"))
    return dealt.withColumn("ci", F.least("__c", "__j")).withColumn("cj", F.greatest("__c", "__j")).drop("__b", "__c", "__j")


def join_names(rows: DataFrame, names: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``rows`` with the columns that ``names`` has for their ``key``, where some keys have a large part of all rows.

    ``names`` is unique by ``key``; its column ``n`` counts the rows of each, ``total`` is their sum where it is known. Keys with more than a ``HOT_KEYS``-th of all rows, which are
    fewer than ``HOT_KEYS``, are sent to the rows; the other rows are shuffled, none of whose keys is large.
    """
    total = (names.agg(F.sum("n")).first()[0] or 0) if total is None else total
    hot = names.filter(F.col("n") * HOT_KEYS > total).drop("n")
    cold = names.filter(F.col("n") * HOT_KEYS <= total).drop("n")
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return here.unionByName(rest)


def runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values in ``keys`` (any structured or plain 1-d array)."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])

