"""Cutting lineage and numbering rows without a single-task sort."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and the master is local (tests), else an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strandloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, key: str | None = None) -> DataFrame:
    """Like ``cut``, and the plan goes on knowing how the rows are partitioned and sorted: by ``key`` if given, else as they are.

    Joins and groups by that key need no shuffle then. (A plan that adaptive execution may change does not say.)"""
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        if key:
            df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
        return cut(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to as many partitions as there are cores, if it has fewer or one holds more than twice its share of the rows.

    A file is read in many partitions, but all rows of a row group are in one of them, whatever is done with these rows."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        held = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if (held["most"] or 0) * wanted <= 2 * (held["all"] or 0) + wanted:
            return df
    return dealt(df)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, by a hash of the whole row: dealing rows out in turn sorts them first, all rows of a row group in one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *(F.col(f"`{c}`") for c in df.columns))


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (this row included) in the given total order.

    Rows are range-partitioned by the order; each partition sums its own rows and adds the total of the partitions
    before it, of which the driver holds one row per partition.
    """
    ranged = cut(df.withColumns({f"__v{i}": c for i, c in enumerate(sums.values())}).sort(*order).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy("__p").agg(*(F.sum(f"__v{i}").alias(f"t{i}") for i in range(len(sums)))).orderBy("__p").collect()
    kinds = [ranged.schema[f"__v{i}"].dataType.simpleString() for i in range(len(sums))]
    rows, at = [], [0] * len(sums)
    for r in totals:
        rows.append((r["__p"], *at))
        at = [x + (r[f"t{i}"] or 0) for i, x in enumerate(at)]
    rows = [(p, *(float(x) if k in ("double", "float") else int(x) for x, k in zip(xs, kinds, strict=True))) for p, *xs in rows]
    offsets = df.sparkSession.createDataFrame(rows, "__p int, " + ", ".join(f"__o{i} {'double' if k in ('double', 'float') else 'long'}" for i, k in enumerate(kinds)))
    own = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "__p")  # a row for each partition
    out = out.withColumns({name: F.sum(f"__v{i}").over(own) + F.col(f"__o{i}") for i, name in enumerate(sums)}).drop(*(f"__o{i}" for i in range(len(sums))))
    return out.drop("__p", *(f"__v{i}" for i in range(len(sums))))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in the given total order."""
    out = prefix_sums(df, order, {name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1)
