"""Counting segments in sequences: every overlapping occurrence within a contig."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.alphabet import Alphabet
from strandloom.functions.sequence import windows
from strandloom.operators.window_counts import count_windows, countable, summed
from strandloom.plans.lineage import cut

#: Largest value of the compact count storage.
UINT16 = 65_535
#: Bytes of an automaton's part of a pool that are sent to every task at most; larger pools are dealt out to several. And what a segment takes besides its characters.
BROADCAST_BYTES, SEGMENT_BYTES = 128 << 20, 200
#: K-mers that are listed with their numbers at most.
LISTED_KMERS = 1 << 16
#: Bytes of a pool that thins windows before they are grouped.
THIN_BYTES = 16 << 20
#: Segments of a pool of several lengths that are counted by a pattern each at most.
PATTERNS = 32


def kmer_histogram(nodes: DataFrame, alphabet: Alphabet, k: int, dense: bool = False, *, once: bool = False) -> DataFrame:
    """``sample_id, code, n``: canonical k-mers by their number. ``dense`` adds the zeros of all base^k codes; ``once`` says that no sample has more than one row in ``nodes``.

    K-mers are counted text by text in Arrow batches. Those too long for a number of 62 bits are windows that are grouped: while there are no more than
    ``LISTED_KMERS`` of them they find their number in a table that is sent to every task; else it is worked out for each."""
    if k > 0 and countable(alphabet, [k]):
        got = count_windows(nodes, alphabet, [k], number=True, unknown=False)
        got = got if once else summed(got, nodes)
    else:
        got = _grouped_kmers(nodes, alphabet, k)
    if not dense:
        return got
    all_codes = nodes.select("sample_id").distinct().withColumn("code", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(alphabet.base**k - 1).cast("long"))))
    return all_codes.join(got, ["sample_id", "code"], "left").select("sample_id", "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _grouped_kmers(nodes: DataFrame, alphabet: Alphabet, k: int) -> DataFrame:
    w = windows(nodes, [k])
    if alphabet.base**k <= LISTED_KMERS:
        every = nodes.sparkSession.range(alphabet.base**k).select(alphabet.decode("id", k).alias("window"))
        w = w.join(F.broadcast(every.select("window", alphabet.encode(alphabet.canonical("window")).alias("code"))), "window")
    else:
        w = w.select("sample_id", alphabet.encode(alphabet.canonical("window")).alias("code")).filter("code IS NOT NULL")
    return w.groupBy("sample_id", "code").agg(F.count(F.lit(1)).alias("n"))


def count_segments(nodes: DataFrame, pool: DataFrame, alphabet: Alphabet, *, strategy: str = "auto") -> DataFrame:
    """``sample_id, seg_id, n``: occurrences of each pool segment (``seg_id, segment``), zeros left out.

    With a complement, a canonical segment counts on both strands and one that is not canonical counts nothing; empty
    segments and such outside the alphabet count nothing; equal segments count each. All strategies give the same rows:
    ``pattern`` counts look-ahead matches of each segment of a small pool, ``join`` joins windows with the pool, which are counted text by text first, ``arrow``
    runs automata over Arrow batches, one for each part of the pool of ``BROADCAST_BYTES``, and reads the texts once for each; ``auto`` takes these while that is less than the windows of all lengths,
    and patterns for a small pool of more than two lengths, or of lengths whose windows have no numbers.
    """
    usable = pool.filter(alphabet.matchable("segment")).select("seg_id", "segment")
    sized = usable.groupBy(F.length("segment").alias("len")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per length
    lengths = sorted(r["len"] for r in sized)
    total = sum(r["n"] for r in sized)
    size = sum(r["n"] * (SEGMENT_BYTES + 4 * r["len"]) for r in sized)
    text = nodes.withColumn("seq", alphabet.normalise("seq"))
    if strategy == "auto":
        few = len(lengths) <= 2 and countable(alphabet, lengths)  # windows are counted in one reading, patterns take one for each segment
        strategy = "pattern" if total <= PATTERNS and not few else "arrow" if len(lengths) > 2 and -(-size // BROADCAST_BYTES) <= len(lengths) else "join"
    if strategy == "pattern":
        return _count_patterns(text, usable, alphabet)
    if strategy == "arrow":
        return _count_arrow(text, usable, alphabet, max(1, -(-size // BROADCAST_BYTES)))
    if strategy != "join":
        raise ValueError("strategy is auto, pattern, join or arrow")
    if countable(alphabet, lengths):  # the windows of a text are counted where it lies, and a pool of checked size is looked up there too
        if size <= THIN_BYTES:
            return summed(count_windows(text, alphabet, lengths, pool=[(r["seg_id"], r["segment"]) for r in usable.collect()]), nodes)
        return summed(count_windows(text, alphabet, lengths), nodes).join(usable, "segment").select("sample_id", "seg_id", "n")
    w = windows(text, lengths).select("sample_id", alphabet.canonical("window").alias("segment"))
    if size <= THIN_BYTES:  # a pool of checked size thins the windows before they are grouped
        w = w.join(F.broadcast(usable.select("segment").distinct()), "segment", "left_semi")
    seen = w.groupBy("sample_id", "segment").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(usable, "segment").select("sample_id", "seg_id", "n")


def count_chunks(chunks: DataFrame, pool: DataFrame, alphabet: Alphabet, *, strategy: str = "auto") -> DataFrame:
    """``count_segments`` over rows that overlap their next: what begins beyond the first ``own`` characters of a row is the next row's.

    Occurrences in the overlaps are counted by themselves and taken off. Overlaps shorter than the longest segment less one are an error of the caller.
    """
    whole = count_segments(chunks, pool, alphabet, strategy=strategy)
    rest = chunks.withColumn("seq", F.substring("seq", F.col("own") + 1, F.length("seq"))).filter("seq <> ''")
    twice = count_segments(rest, pool, alphabet, strategy=strategy).withColumn("n", -F.col("n"))
    return whole.unionByName(twice).groupBy("sample_id", "seg_id").agg(F.sum("n").alias("n")).filter("n > 0")


def _count_patterns(nodes: DataFrame, usable: DataFrame, alphabet: Alphabet) -> DataFrame:
    exact = lambda form: "(?=" + "".join(f"\\x{{{ord(c):x}}}" for c in form) + ")"
    each = []
    for r in usable.orderBy("seg_id").collect():  # a small pool
        forms = sorted({r["segment"], alphabet.complement_of(r["segment"])})
        n = sum((F.regexp_count("seq", F.lit(exact(f))).cast("long") for f in forms), F.lit(0).cast("long"))
        each.append(F.struct(F.lit(r["seg_id"]).cast("long").alias("seg_id"), n.alias("n")))
    if not each:
        return nodes.select("sample_id", F.lit(0).cast("long").alias("seg_id"), F.lit(0).cast("long").alias("n")).limit(0)
    counted = nodes.select("sample_id", F.explode(F.array(*each)).alias("c")).select("sample_id", "c.seg_id", "c.n").filter("n > 0")
    return counted.groupBy("sample_id", "seg_id").agg(F.sum("n").alias("n"))


def _count_arrow(nodes: DataFrame, usable: DataFrame, alphabet: Alphabet, parts: int) -> DataFrame:
    """Automata of ``parts`` parts of the pool, dealt by a hash of the segment. The driver holds one part at a time; texts are cut from their lineage where they are read again."""
    if parts == 1:
        return _count_automaton(nodes, usable, alphabet)
    nodes, dealt = cut(nodes.select("sample_id", "seq")), cut(usable.withColumn("part", F.pmod(F.xxhash64("segment"), F.lit(parts))))
    out = None
    for i in range(parts):
        one = cut(_count_automaton(nodes, dealt.filter(F.col("part") == i).drop("part"), alphabet))
        out = one if out is None else out.unionByName(one)
    return out


def _count_automaton(nodes: DataFrame, usable: DataFrame, alphabet: Alphabet) -> DataFrame:
    table: dict[str, list[int]] = {}
    for r in usable.toLocalIterator():  # of a checked size
        for form in {r["segment"], alphabet.complement_of(r["segment"])}:
            table.setdefault(form, []).append(r["seg_id"])
    sent = nodes.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([nodes.schema["sample_id"], T.StructField("seg_id", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        occurrences = _matcher(sent.value)
        for b in batches:
            rows, segs, ns = [], [], []
            for i, s in enumerate(b.column("seq").to_pylist()):
                found: dict[int, int] = {}
                for form, n in Counter(occurrences(s)).items():
                    for seg in sent.value[form]:
                        found[seg] = found.get(seg, 0) + n
                rows += [i] * len(found)
                segs += found
                ns += found.values()
            yield pa.RecordBatch.from_arrays([b.column("sample_id").take(pa.array(rows, pa.int64())), pa.array(segs, pa.int64()), pa.array(ns, pa.int64())], names=schema.names)

    return nodes.select("sample_id", "seq").mapInArrow(run, schema).groupBy("sample_id", "seg_id").agg(F.sum("n").alias("n"))


def _matcher(forms: Iterable[str]) -> Callable[[str], Iterable[str]]:
    """All overlapping occurrences of the forms in a text: one pass of an automaton, or one for each length without it."""
    try:
        import ahocorasick
    except ImportError:
        lengths, known = sorted({len(f) for f in forms}), frozenset(forms)
        return lambda s: (w for n in lengths for at in range(len(s) - n + 1) if (w := s[at : at + n]) in known)
    a = ahocorasick.Automaton()
    for f in forms:
        a.add_word(f, f)
    if not len(a):
        return lambda s: ()
    a.make_automaton()
    return lambda s: (f for _, f in a.iter(s))


def stored(n: Column | str = "n", *, uint16: bool = False, presence: bool = False) -> Column:
    """A count as it is stored: saturated, then turned into presence."""
    c = F.col(n) if isinstance(n, str) else n
    if uint16:
        c = F.least(c, F.lit(UINT16))
    return F.least(c, F.lit(1)) if presence else c


def dense_counts(counts: DataFrame, samples: DataFrame, pool: DataFrame) -> DataFrame:
    """``sample_id, counts array<long>`` in pool order, zeros included, for every row of ``samples(sample_id)``."""
    size = pool.agg(F.max("seg_id")).first()[0]
    size = 0 if size is None else size + 1
    packed = counts.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("seg_id").cast("long"), "n"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max(size - 1, 0)).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    every = every if size else F.array().cast("array<bigint>")
    return samples.select("sample_id").join(packed, "sample_id", "left").select("sample_id", every.alias("counts"))


def sparse_counts(counts: DataFrame) -> DataFrame:
    """``sample_id, indices array<long>, values array<long>``: the rows of the matrix in compressed form, columns in order."""
    e = F.array_sort(F.collect_list(F.struct(F.col("seg_id").cast("long").alias("i"), F.col("n").alias("n"))))
    return counts.groupBy("sample_id").agg(e.alias("e")).select("sample_id", F.transform("e", lambda x: x["i"]).alias("indices"), F.transform("e", lambda x: x["n"]).alias("values"))


def matrix(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A dense float matrix from its long form."""
    out = np.zeros(shape, dtype=np.float32)
    out[rows, cols] = values
    return out
