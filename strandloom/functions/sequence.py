"""Functions of sequences: FASTA text, contigs, overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.alphabet import Alphabet, _col

#: Characters of a block that windows are cut from; long texts are blocked first, as a substring's cost grows with its place.
BLOCK = 256


def parse_fasta(text: Column | str) -> Column:
    """Contigs of FASTA text: the lines after each ``>`` line, joined; what stands before the first is left out.

    Text without a header is one contig of all its lines; a header without lines is an empty contig.
    """
    t = _col(text)
    joined = lambda x: F.replace(x, F.lit("\n"), F.lit(""))
    body = lambda x: F.when(F.instr(x, "\n") > 0, joined(F.substring(x, F.instr(x, "\n") + 1, F.length(x)))).otherwise("")
    # a text is split only where it has a header
    parts = F.split(F.concat(F.lit("\n"), t), "\n>")
    return F.when(t.startswith(">") | t.contains("\n>"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), body)).otherwise(F.array(joined(t)))


def contigs(samples: DataFrame, alphabet: Alphabet, *, id_column: str = "sample_id", text_column: str = "text", fasta: bool = True, keep_unknown: bool = False) -> DataFrame:
    """``sample_id, contig_idx, seq``: every contig of every sample, sanitised. Null texts have no contigs."""
    nodes = parse_fasta(text_column) if fasta else F.array(F.col(text_column))
    rows = samples.filter(F.col(text_column).isNotNull()).select(F.col(id_column).alias("sample_id"), F.posexplode(nodes).alias("contig_idx", "seq"))
    return rows.withColumn("seq", alphabet.sanitise("seq", keep_unknown))


def sequence_lengths(nodes: DataFrame) -> DataFrame:
    """``sample_id, n_contigs, length`` of a contig table."""
    return nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_contigs"), F.sum(F.length("seq").cast("long")).alias("length"))


def concatenated(nodes: DataFrame) -> DataFrame:
    """``sample_id, seq``: contigs joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("contig_idx", "seq")))
    return nodes.groupBy("sample_id").agg(ordered.alias("c")).select("sample_id", F.array_join(F.transform("c", lambda x: x["seq"]), "").alias("seq"))


def character_at(nodes: DataFrame, index: int) -> DataFrame:
    """``sample_id, character`` at a 0-based place counted through the contigs; null beyond the end."""
    return concatenated(nodes).select("sample_id", F.when(F.length("seq") > index, F.substring("seq", index + 1, 1)).alias("character"))


def blocks(seq: Column | str, longest: int, block: int = BLOCK) -> Column:
    """Blocks of a text that overlap by ``longest - 1``, so that every window lies whole in one.

    The text is cut by one pattern, in time linear in its length, and each part gets the head of the next."""
    parts = F.regexp_extract_all(_col(seq), F.lit(f"(?s).{{1,{max(block, longest)}}}"), F.lit(0))
    if longest <= 1:
        return parts
    return F.zip_with(parts, F.slice(parts, 2, F.size(parts)), lambda x, y: F.concat(x, F.coalesce(F.substring(y, F.lit(1), F.lit(longest - 1)), F.lit(""))))


def windows(nodes: DataFrame, lengths: list[int], *, keep: tuple[str, ...] = ("sample_id",), seq_column: str = "seq", block: int = BLOCK) -> DataFrame:
    """``keep, window``: every overlapping window of each of the lengths, within contigs."""
    lengths = sorted({n for n in lengths if n > 0})
    if not lengths:
        return nodes.select(*keep, F.lit("").alias("window")).limit(0)
    # one arm a length; places are exploded, not mapped over, so that cutting stays in generated code
    block = max(block, max(lengths))
    blocked = nodes.select(*keep, F.explode(blocks(seq_column, max(lengths), block)).alias("__b"))
    arms = []
    for n in lengths:
        places = F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.length("__b") - (n - 1))))
        placed = blocked.filter(F.length("__b") >= n).select(*keep, "__b", places.alias("__i"))
        arms.append(placed.select(*keep, F.substring("__b", F.col("__i"), F.lit(n)).alias("window")))
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out
