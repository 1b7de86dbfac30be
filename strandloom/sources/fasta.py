"""FASTA files of any size, read in byte ranges.

Spark's text reader cuts a file into blocks of ``spark.sql.files.maxPartitionBytes`` at line ends. A block does not know to which contig its first lines
belong, nor how far into it they are; both come from one row per block: its number of headers and the length after
the last of them, summed over the blocks before it. Lines are joined to pieces where they are read, so what is shuffled is pieces, not lines, and a contig need
never be in one row: ``fasta_chunks`` cuts contigs at fixed places into rows that overlap, from which windows and segments are counted.

The contigs are those of ``parse_fasta`` over the whole text of a file. What is read twice is the text (first for the row per block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.alphabet import Alphabet
from strandloom.plans.lineage import cut

#: Characters of a chunk that windows begin in.
CHUNK = 1 << 16
#: Blocks whose rows (a path and five numbers each) are sent to every task at most; with more, pieces are shuffled to them.
SENT_BLOCKS = 200_000

_PIECES = "item string, block long, header long, start long, piece string"


def plain_path(uri: Column) -> Column:
    """A file URI as a plain path; other schemes stay."""
    return F.regexp_replace(uri, "^file:/+", "/")


def fasta_paths(spark: SparkSession, paths: list[str] | str, glob: str | None = None) -> DataFrame:
    """``item, bytes`` of the files that are not empty; none of them is opened."""
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    return found.select(plain_path(F.col("path")).alias("item"), F.col("length").alias("bytes"))


def _lines(spark: SparkSession, paths: list[str] | str, alphabet: Alphabet | None, keep_unknown: bool, glob: str | None) -> DataFrame:
    """``item, block, head, value``: lines where they are read, in order within a block; headers without their text."""
    reader = spark.read.option("lineSep", "\n")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(paths)
    head = F.col("value").startswith(">")
    body = alphabet.sanitise("value", keep_unknown) if alphabet else F.col("value")
    return raw.select(plain_path(F.col("_metadata.file_path")).alias("item"), F.col("_metadata.file_block_start").alias("block"), head.alias("head"), F.when(head, F.lit("")).otherwise(body).alias("value"))


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a contig that lie in one batch as one piece, with the number of headers of the block up to it and its place after the last of these."""
    item = block = None
    headers = length = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        items, blocks = batch.column("item"), batch.column("block").to_numpy()
        head = batch.column("head").to_numpy(zero_copy_only=False)
        new = np.ones(n, dtype=bool)
        new[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(items.slice(1), items.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = item != items[0].as_py() or block != blocks[0]
        begins = new | head
        begins[0] = True
        at = np.flatnonzero(begins)
        seen = np.cumsum(head)
        # headers of the block: those of the batch, less those before the block began in it, and those of the batches before
        base = np.full(n, headers, dtype=np.int64)
        for i in np.flatnonzero(new):
            base[i:] = head[i] - seen[i]
        offsets = pa.array(np.append(at, n), pa.int32())
        pieces = pc.binary_join(pa.ListArray.from_arrays(offsets, batch.column("value")), "")
        start = np.zeros(len(at), dtype=np.int64)
        if not new[0] and not head[0]:
            start[0] = length
        number = (seen + base)[at]
        yield pa.RecordBatch.from_arrays([items.take(pa.array(at)), pa.array(blocks[at]), pa.array(number), pa.array(start), pieces], names=["item", "block", "header", "start", "piece"])
        item, block, headers = items[n - 1].as_py(), blocks[n - 1], int(number[-1])
        length = int(start[-1]) + len(pieces[len(at) - 1].as_py())


def _blocks(pieces: DataFrame) -> DataFrame:
    """One row per block: headers of its file before it, the length that its first contig has before it, and the file's headers."""
    last = pieces.groupBy("item", "block").agg(F.max(F.struct("header", (F.col("start") + F.length("piece")).alias("end"))).alias("x"))
    order = W.partitionBy("item").orderBy("block")
    upto = last.select("item", "block", F.col("x.header").alias("own"), F.col("x.end").alias("tail"), F.sum("x.header").over(order).alias("upto"))
    run = F.sum("tail").over(W.partitionBy("item", "upto").orderBy("block"))
    known = upto.withColumn("run", run).select("item", "block", (F.col("upto") - F.col("own")).alias("before"), F.coalesce(F.lag("run").over(order), F.lit(0)).alias("carried"), F.sum("own").over(W.partitionBy("item")).alias("headers"))
    return cut(known)


def fasta_pieces(spark: SparkSession, paths: list[str] | str, alphabet: Alphabet | None = None, *, keep_unknown: bool = False, glob: str | None = None) -> DataFrame:
    """``item, contig_idx, start, piece``: the contigs of the files in pieces with their place in the contig, sanitised if there is an alphabet.

    A file without headers is one contig; an empty contig has an empty piece; a file of no bytes has no row, as Spark's readers pass it over. Lines end with a line feed; a
    carriage return is a character like others, which no usual alphabet holds. One line must fit a row (2 GB).
    """
    pieces = _lines(spark, paths, alphabet, keep_unknown, glob).mapInArrow(_join_lines, _PIECES)
    blocks = _blocks(pieces)
    blocks = F.broadcast(blocks) if blocks.count() <= SENT_BLOCKS else blocks
    contig = F.when(F.col("headers") == 0, 0).otherwise(F.col("before") + F.col("header") - 1)
    start = F.col("start") + F.when(F.col("header") == 0, F.col("carried")).otherwise(0)
    return pieces.join(blocks, ["item", "block"]).select("item", contig.alias("contig_idx"), start.alias("start"), "piece").filter("contig_idx >= 0")


def fasta_contigs(spark: SparkSession, paths: list[str] | str, alphabet: Alphabet | None = None, **kw) -> DataFrame:
    """``item, contig_idx, seq``: each contig in one row, which it has to fit."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "piece")))
    return fasta_pieces(spark, paths, alphabet, **kw).groupBy("item", "contig_idx").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("seq"))


def chunks_of(pieces: DataFrame, overlap: int, chunk: int = CHUNK) -> DataFrame:
    """``item, contig_idx, chunk_idx, own, seq``: contigs cut every ``chunk`` characters, each row with the next ``overlap`` characters too.

    Every window of up to ``overlap + 1`` characters begins among the first ``own`` of exactly one row. Contigs without characters have no row.
    """
    a, n = F.col("start"), F.length("piece")
    first = F.greatest(F.floor((a - overlap) / chunk), F.lit(0)).cast("long")
    cells = pieces.filter(n > 0).withColumn("chunk_idx", F.explode(F.sequence(first, F.floor((a + n - 1) / chunk).cast("long"))))
    begin = F.col("chunk_idx") * chunk
    skip = F.greatest(begin - a, F.lit(0))
    take = F.least(begin + chunk + overlap - a, n.cast("long")) - skip
    parts = cells.select("item", "contig_idx", "chunk_idx", F.greatest(a, begin).alias("start"), F.substring("piece", (skip + 1).cast("int"), take.cast("int")).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "part")))
    seq = parts.groupBy("item", "contig_idx", "chunk_idx").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("seq"))
    return seq.select("item", "contig_idx", "chunk_idx", F.least(F.length("seq"), F.lit(chunk)).alias("own"), "seq")


def fasta_chunks(spark: SparkSession, paths: list[str] | str, alphabet: Alphabet, overlap: int, *, chunk: int = CHUNK, **kw) -> DataFrame:
    """The files' contigs as ``chunks_of`` their sanitised pieces."""
    return chunks_of(fasta_pieces(spark, paths, alphabet, **kw), overlap, chunk)
