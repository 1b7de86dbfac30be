"""Sources: FASTA files, tables of texts, label tables, fold files, segment lists.

All give ``sample_id, item`` and label columns; ``text`` holds the content where it is read.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.alphabet import Alphabet
from strandloom.plans.lineage import cut, dealt, number_rows
from strandloom.sources.fasta import fasta_chunks, plain_path
from strandloom.sources.labels import label_names, require_columns, with_numeric_labels

log = logging.getLogger("strandloom")
#: Names of the label column of tables, of the path column of label files, and suffixes of sequence files.
DEFAULT_LABEL = "labels"
FILES = "files"
SUFFIXES = (".fna", ".fasta")
SEQUENCE_FILES = "*.{" + ",".join(s[1:] for s in SUFFIXES) + "}"
#: Paths that are given to a reader one by one at most, and samples whose paths are sent to every task at most.
DRIVER_PATHS, SENT_SAMPLES = 10_000, 200_000


def fasta_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``item, text``: each file whole."""
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(plain_path(F.col("_metadata.file_path")).alias("item"), F.col("value").alias("text"))


def fasta_directory(spark: SparkSession, folder: str) -> DataFrame:
    """``item, text`` of the sequence files of a folder; sort by ``item`` for a fixed order."""
    raw = spark.read.option("pathGlobFilter", SEQUENCE_FILES).text(folder, wholetext=True)
    return raw.select(plain_path(F.col("_metadata.file_path")).alias("item"), F.col("value").alias("text"))


def existing(paths: DataFrame) -> DataFrame:
    """The ``path`` of ``paths`` that exist, as they are spelled: a semi join with the listings of the folders they name, one request a folder."""
    spark = paths.sparkSession
    split = paths.select("path", F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name")).filter("name <> ''").distinct()
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    listed = []
    for r in split.select("folder").distinct().collect():  # folders, not files
        p = hadoop.Path(r["folder"] or ".")
        system = p.getFileSystem(conf)
        if system.exists(p):
            listed += [(r["folder"], x.getName()) for x in hadoop.FileUtil.stat2Paths(system.listStatus(p))]
    return split.join(spark.createDataFrame(listed, "folder string, name string"), ["folder", "name"], "left_semi").select("path")


def label_table(source: DataFrame | str | Mapping, label_columns: str | list[str], data_dir: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """``sample_id, item`` and labels of a label file, a DataFrame with a ``files`` column, or a mapping of files.

    A path stays as it is if it exists or there is no ``data_dir``, else it is looked for there. Files that do not exist are
    left out with a warning; of a path given twice the last label counts (in the order of the rows).
    """
    names = label_names(label_columns)
    if isinstance(source, str):
        spark = spark or SparkSession.getActiveSession()
        source = spark.read.csv(source, header=True, inferSchema=True)
    elif isinstance(source, Mapping):
        spark = spark or SparkSession.getActiveSession()
        rows = []
        for path, y in source.items():
            if not isinstance(y, Mapping):
                if len(names) > 1:
                    raise ValueError("one value for several labels")
                y = {names[0]: y}
            rows.append((path, *(None if y.get(n) is None else float(y[n]) for n in names)))
        source = spark.createDataFrame(rows, "files string, " + ", ".join(f"`{n}` double" for n in names))
    require_columns(source, [FILES, *names])
    spark = source.sparkSession
    numbered = cut(with_numeric_labels(source.select(FILES, *names), names).withColumn("__o", F.monotonically_increasing_id()))
    last = numbered.groupBy(FILES).agg(F.max_by(F.struct("__o", *names), "__o").alias("x")).select(FILES, "x.*")
    last = last.withColumns({"__a": F.col(FILES), "__b": F.concat(F.lit(data_dir.rstrip("/") + "/"), F.col(FILES)) if data_dir else F.col(FILES)})
    last = last.withColumn("__b", F.when(F.col(FILES).startswith("/") | F.col(FILES).contains("://"), F.col(FILES)).otherwise(F.col("__b")))
    there = cut(existing(last.select(F.col("__a").alias("path")).union(last.select("__b")).distinct()))
    found = last.join(there.select(F.col("path").alias("__a"), F.lit(True).alias("__as_is")), "__a", "left").join(there.select(F.col("path").alias("__b"), F.lit(True).alias("__in_dir")), "__b", "left")
    found = cut(found.withColumn("item", F.when(F.col("__as_is"), F.col("__a")).when(F.col("__in_dir"), F.col("__b"))))
    missing = found.filter("item IS NULL").count()
    if missing:
        log.warning("%d files with labels do not exist and are left out", missing)
    placed = number_rows(found.filter("item IS NOT NULL").select("__o", "item", *names), [F.col("__o").asc()], "sample_id")
    return placed.select("sample_id", "item", *(F.col(n).cast("float").alias(n) for n in names))


def item_paths(samples: DataFrame) -> list[str]:
    """What a reader is given for the samples' files: their paths while these are few, else the folders they lie in, whose other files the join with the samples leaves out."""
    items = samples.select("item").distinct()
    few = [r[0] for r in items.limit(DRIVER_PATHS + 1).collect()]
    if len(few) <= DRIVER_PATHS:
        return few
    return [r[0] for r in items.select(F.regexp_extract("item", "^(.*/)?[^/]*$", 1)).distinct().collect()]


def read_items(samples: DataFrame) -> DataFrame:
    """A label table with the files' ``text``, each whole; ``item_chunks`` has no limit on a file's size."""
    paths = item_paths(samples)
    if not paths:
        return samples.withColumn("text", F.lit(None).cast("string"))
    files = fasta_files(samples.sparkSession, paths)
    return samples.withColumn("__p", plain_path(F.col("item"))).join(files.withColumnRenamed("item", "__f"), F.col("__p") == F.col("__f")).drop("__p", "__f")


def item_chunks(samples: DataFrame, alphabet: Alphabet, overlap: int, *, keep_unknown: bool = False) -> DataFrame:
    """``sample_id, contig_idx, chunk_idx, own, seq``: the files of a label table in chunks that overlap, read in byte ranges."""
    spark = samples.sparkSession
    paths = item_paths(samples)
    named = samples.select("sample_id", plain_path(F.col("item")).alias("item"))
    if not paths:
        return named.select("sample_id", *(F.lit(0).cast("long").alias(c) for c in ("contig_idx", "chunk_idx", "own")), F.lit("").alias("seq")).limit(0)
    named = F.broadcast(named) if named.count() <= SENT_SAMPLES else named
    return fasta_chunks(spark, paths, alphabet, overlap, keep_unknown=keep_unknown).join(named, "item").drop("item")


def text_table(source: DataFrame | str, data_column: str, label_columns: str | list[str] | None = None, id_column: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """``sample_id, item, text`` and labels of a table with one text a row.

    Rows with a null or blank text or a null label are left out with a warning; none left is an error.
    """
    names = label_names(label_columns, DEFAULT_LABEL)
    if isinstance(source, str):
        source = (spark or SparkSession.getActiveSession()).read.csv(source, header=True, inferSchema=True)
    require_columns(source, [data_column, *names])
    picked = source.select((F.col(id_column) if id_column else F.monotonically_increasing_id()).cast("long").alias("sample_id"), F.col(data_column).cast("string").alias("text"), *names)
    usable = F.substring("text", 1, 64).rlike("\\S") | F.col("text").rlike("\\S")  # the head tells of most
    for n in names:
        usable = usable & F.col(n).isNotNull()
    # texts are read once and dealt out at once, as one task reads all rows of a row group
    kept = cut(dealt(picked.filter(F.coalesce(usable, F.lit(False)))))
    n_all, n_kept = picked.count(), kept.count()
    if not n_kept:
        raise ValueError("no row has both a text and labels")
    if n_kept < n_all:
        log.warning("%d rows without text or label are left out", n_all - n_kept)
    return with_numeric_labels(kept, names).select("sample_id", F.col("sample_id").cast("string").alias("item"), "text", *names)


def build_source(spark: SparkSession, *, table=None, data_column: str | None = None, label_file=None, label_columns=None, data_dir: str | None = None, id_column: str | None = None) -> DataFrame:
    """The samples of a run, with their ``text`` if they are of a table; a table goes before a label file, neither is an error."""
    if table is not None:
        if not data_column:
            raise ValueError("a table needs the name of its text column")
        return text_table(table, data_column, label_columns, id_column, spark)
    if label_file is None:
        raise ValueError("a table or a label file is needed")
    return label_table(label_file, label_columns, data_dir, spark)


def fold_file(spark: SparkSession, path: str, data_dir: str | None) -> DataFrame:
    """``fold, item`` of a JSON file ``{"fold_0": [names], ...}``, names taken in ``data_dir``."""
    if not data_dir:
        raise ValueError("predefined folds need the folder of the files")
    with open(path) as f:
        got = json.load(f)
    rows = [(int(k.rsplit("_", 1)[-1]), os.path.join(data_dir, x)) for k, v in got.items() for x in v]
    return spark.createDataFrame(rows, "fold int, item string")


def segment_list(spark: SparkSession, path: str) -> DataFrame:
    """``ord, segment`` of a ``.txt`` with one a line or a ``.csv`` with a column ``Segment``, numbered in the order of the lines without empty ones."""
    if path.endswith(".csv"):
        lines = spark.read.csv(path, header=True).withColumnRenamed("Segment", "segment")
    elif path.endswith(".txt"):
        lines = spark.read.text(path).withColumnRenamed("value", "segment")
    else:
        raise ValueError(f"a segment list is .txt or .csv, not {path!r}")
    # rows of a block of a file are in one partition, in order
    placed = lines.select("segment", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    return number_rows(placed.filter("segment <> ''"), [F.col("__f").asc(), F.col("__b").asc(), F.col("__i").asc()], "ord").select("ord", "segment")
