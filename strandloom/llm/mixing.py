"""Mixing sources to target weights by Pareto order sampling.

Sizes are words. A source's target is ``t`` words of its ``s``; every document gets ``floor(t / s)`` whole copies for certain, and
the ``r = t - floor(t / s) s`` words that are left are drawn as one further copy of some documents. The inclusion probability of a
document is proportional to its size, ``p = min(1, c size)`` with ``sum(p size) = r``; those with ``p = 1`` are certain as well. The
others are ranked by random odds divided by inclusion odds, ``u / (1 - u) : p / (1 - p)``, and taken in this order until the words
of the source are reached (the size of the sample is fixed in words, as the target is): the last document is taken if that brings
the sum nearer. Large documents rank early, so the one at the end, which is all a source can miss its target by, tends to be small.

``u`` is a hash of the document's id and text, so reruns agree. All of it is DataFrame functions.

Scale: texts are read once; from then on a row is an id, a source number, a size and a hash. Sums, the sizes of a source and the
ranks in 4,096 bins are aggregated before they are shuffled, so a source with a third of all rows is no large group; only
the bin in which a source reaches its target is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import cut, join_names

#: Weights of the sources in order, repeating; words of the mix in parts of all words; copies of a document at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 42
#: Bins of ranks. Bins whose words all fit are taken as they are; one bin of a source is sorted.
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 48 bits of a hash."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with a number ``k`` from 0 in code-point order, null last, by range partitions and a row for each of these."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sources.sort(*order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = totals.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return ranged.join(F.broadcast(offsets), "part").withColumn("k", F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``sources`` (source, source_size, n) with each one's weight ``w`` and ``target``.

    Targets share ``share`` times all words by weight; one stops at ``most`` times its source, and what is above is shared again
    by weight among the others until none is above. Each turn is a sum over the table of sources.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    known = cut(_numbered(sources).withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * most))
    words, total_w = known.agg(F.sum("source_size"), F.sum("w")).first()
    level = share * float(words or 0) / total_w if total_w else 0.0
    above = -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("w")
        n, cap, rest = known.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == above or not rest:
            break
        above, level = n, (share * float(words) - (cap or 0.0)) / rest
    return known.withColumn("target", F.when(F.col("cap") < F.lit(level) * F.col("w"), F.col("cap")).otherwise(F.lit(level) * F.col("w"))).drop("k", "cap")


def _inclusion(sized: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` with ``whole`` copies for all, the size ``sure`` from which one more is certain, the factor ``c`` and the words ``left`` to draw by rank."""
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    known = known.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size").cast("double"))
    sizes = sized.filter("size > 0").groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("m")).join(known.select("source_key", "rest"), "source_key")
    words, squares = (F.col("m") * F.col("size")).cast("decimal(38,0)"), F.col("m").cast("decimal(38,0)") * F.col("size") * F.col("size")
    down = W.partitionBy("source_key").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(words).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("double")
    below = F.sum(squares.cast("decimal(38,0)")).over(down.rowsBetween(0, W.unboundedFollowing)).cast("double")
    by_size = sizes.select("source_key", "size", words.cast("double").alias("words"), (F.col("rest") - larger).alias("open"), below.alias("below")).withColumn("certain", F.col("open") * F.col("size") >= F.col("below"))
    factors = by_size.groupBy("source_key").agg(
        F.min(F.when(F.col("certain"), F.col("size"))).alias("sure"),
        F.max_by(F.when(~F.col("certain"), F.col("open") / F.col("below")), F.when(~F.col("certain"), F.col("size"))).alias("c"),
        F.max_by(F.when(~F.col("certain"), F.col("open")), F.when(~F.col("certain"), F.col("size"))).alias("left"),
    )
    return known.drop("rest").join(factors, "source_key", "left")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED, keep: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """How many copies of each document the mix takes: a row per row of ``docs`` with ``row`` (a struct of ``keep``), ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (long, words).

    Reads ``doc_id``, ``source`` and ``text``; other columns, whatever their names, are only carried if in ``keep``, whose types must be groupable.
    A null text, or one without words, has size 0 and is never taken by rank, and gets its source's whole copies of nothing. A null source is a
    source of its own, the last; an empty one is the first. Null ids are ranked by their text. Rows equal in id and text have one rank and are taken one
    by one; which of them is told apart by nothing. Sources without words have target 0. An empty table gives an empty table. Texts of any length count as one size.
    """
    source = F.col("source").cast("string")
    sized = cut(
        docs.select(
            F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source_key"),
            source.alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _uniform(F.col("doc_id"), F.col("text"), seed).alias("u"),
        )
    )
    sources = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    known = cut(_inclusion(sized, targets(sources, weights, share, most)))
    p = F.col("c") * F.col("size")
    odds = F.try_divide(F.col("u"), 1 - F.col("u"))
    rank = F.try_divide(odds, F.try_divide(p, 1 - p))
    drawn = F.coalesce((F.col("size") > 0) & (p > 0) & (F.col("sure").isNull() | (F.col("size") < F.col("sure"))), F.lit(False))
    names = known.select("source_key", "source_size", "target", "whole", "sure", "c", "left", "n")
    ranked = join_names(sized.drop("source"), names, "source_key")
    ranked = ranked.select("row", "source_key", "size", "source_size", "target", "whole", "left", F.coalesce(F.col("size") >= F.col("sure"), F.lit(False)).alias("certain"), F.when(drawn, rank / (1 + rank)).alias("v"))
    ranked = ranked.withColumn("bin", F.when(F.col("v").isNotNull(), F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)).cast("int")))
    bins = ranked.filter("v IS NOT NULL").groupBy("source_key", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = F.sum("words").over(W.partitionBy("source_key").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    reached = bins.select("source_key", "bin", "left", (upto - F.col("words")).alias("before"), upto.alias("upto")).filter("upto > left").groupBy("source_key").agg(F.min("bin").alias("last_bin"), F.min("before").alias("before"))
    counts = known.select("source_key", "n").join(reached, "source_key", "left")
    placed = join_names(ranked, counts, "source_key")
    here = F.coalesce(F.col("bin") == F.col("last_bin"), F.lit(False))
    taken = F.when(F.col("certain"), 1).when(F.col("v").isNull(), 0).when(F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin")), 1).otherwise(0)
    out = ["row", "size", "source_size", "target", "whole", "extra"]
    clear = placed.filter(~here).withColumn("extra", taken).select(*out)
    equal = placed.filter(here).groupBy("source_key", "v", "row", "size", "source_size", "target", "whole", "left", "before").agg(F.count(F.lit(1)).alias("m"))
    so_far = F.col("before") + F.coalesce(F.sum(F.col("m") * F.col("size")).over(W.partitionBy("source_key").orderBy("v", "row", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fit = F.floor((F.col("left") - so_far) / F.col("size") + 0.5)
    last = equal.withColumn("fit", fit).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).withColumn("extra", F.when(F.col("i") <= F.col("fit"), 1).otherwise(0)).select(*out)
    both = clear.unionByName(last).withColumn("copies", F.col("whole") + F.col("extra"))
    return both.select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents themselves, all columns of ``docs``, a row for each copy taken."""
    mixed = mix(docs, keep=docs.columns, **settings)
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def report(mixed: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken; and ``copies``."""
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", "copies")
