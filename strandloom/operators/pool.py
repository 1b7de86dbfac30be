"""The segment pool: an ordered set of segments, and the algebra that grows and thins it."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.alphabet import Alphabet
from strandloom.plans.lineage import cut, number_rows

#: Largest number of k-mers that a seed pool may be generated from.
MOST_KMERS = 1 << 28
#: Pools of up to so many segments are thinned on the driver; larger ones by a distributed fix-point with the same result.
DRIVER_POOL = 20_000


def first_of_each(rows: DataFrame, order: list[str]) -> DataFrame:
    """``seg_id, segment``: equal segments once, at the place of the first in ``order``; renumbered from 0."""
    least = rows.groupBy("segment").agg(F.min(F.struct(*order)).alias("__o"))
    return number_rows(least, [F.col("__o").asc(), F.col("segment").asc()], "seg_id").select("seg_id", "segment")


def canonical_kmers(spark: SparkSession, alphabet: Alphabet, k: int) -> DataFrame:
    """``seg_id, segment``: all k-mers in alphabet order, canonical, first of each."""
    n = alphabet.base**k
    if k < 1 or n > MOST_KMERS:
        raise ValueError(f"{n} k-mers; the pool is limited to {MOST_KMERS}")
    every = spark.range(n).select(F.col("id").alias("ord"), alphabet.canonical(alphabet.decode("id", k)).alias("segment"))
    return first_of_each(every, ["ord"])


def extend(pool: DataFrame, alphabet: Alphabet, last_length: int, ext: int) -> DataFrame:
    """The pool with every extension, by 1..``ext`` characters around them, of the segments of ``last_length + 1 .. last_length + ext``.

    An extension string of i characters is split at every place, its head put before and its tail after the segment;
    results are canonical, new ones follow the pool in order of segment, i, string and split, first of each.
    """
    arms = [pool.select(F.lit(0).alias("part"), "seg_id", F.lit(0).alias("i"), F.lit(0).cast("long").alias("code"), F.lit(0).alias("j"), "segment")]
    due = pool.filter(F.length("segment").between(last_length + 1, last_length + ext))
    for i in range(1, ext + 1):
        codes = due.withColumn("code", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(alphabet.base**i - 1).cast("long"))))
        spelled = codes.withColumn("e", alphabet.decode("code", i)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(i))))
        grown = F.concat(F.substring("e", F.lit(1), F.col("j")), F.col("segment"), F.substring("e", F.col("j") + 1, F.lit(i)))
        arms.append(spelled.select(F.lit(1).alias("part"), "seg_id", F.lit(i).alias("i"), "code", "j", alphabet.canonical(grown).alias("segment")))
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return first_of_each(out, ["part", "seg_id", "i", "code", "j"])


def append(pool: DataFrame, more: DataFrame, order: str = "ord") -> DataFrame:
    """The pool followed by ``more(segment, ord)``, first of each."""
    both = pool.select(F.lit(0).alias("part"), F.col("seg_id").cast("long").alias("at"), "segment").unionByName(more.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("at"), "segment"))
    return first_of_each(both, ["part", "at"])


def graft(pool: DataFrame, shortest: int, longest: int) -> DataFrame:
    """The pool with every two different entries joined where the one's last n characters are the other's first, n from ``shortest`` to ``longest``."""
    out = pool.select(F.lit(0).alias("part"), F.lit(0).alias("n"), F.col("seg_id").alias("a"), F.lit(0).cast("long").alias("b"), "segment")
    for n in range(shortest, longest + 1):
        long_enough = pool.filter(F.length("segment") >= n)
        left = long_enough.select(F.col("seg_id").cast("long").alias("a"), F.col("segment").alias("sa"), F.expr(f"right(segment, {n})").alias("k"))
        right = long_enough.select(F.col("seg_id").cast("long").alias("b"), F.col("segment").alias("sb"), F.expr(f"left(segment, {n})").alias("k"))
        joined = left.join(right, "k").filter("a <> b")
        out = out.unionByName(joined.select(F.lit(1).alias("part"), F.lit(n).alias("n"), "a", "b", F.concat("sa", F.expr(f"substring(sb, {n + 1})")).alias("segment")))
    return first_of_each(out, ["part", "n", "a", "b"])


def containment_pairs(pool: DataFrame) -> DataFrame:
    """``outer_id, inner_id``: pairs of entries of which one's text holds the other's, equal ones included (smaller id first).

    An entry lies in another where it begins one of its suffixes. Entries and suffixes, one row for each character, are put in order together by range
    partitions; what begins a suffix then stands before it, and one pass keeps the chain of entries that begin the present row, which is
    no longer than there are lengths. Entries of the partitions before that begin a partition's first row are found by its beginnings.
    """
    named = pool.filter(F.length("segment") > 0).select(F.col("seg_id").cast("long").alias("seg_id"), "segment")
    texts = named.groupBy("segment").agg(F.min("seg_id").alias("rep"))
    entries = texts.select(F.col("segment").alias("text"), F.lit(0).alias("kind"), "rep")
    places = F.explode(F.sequence(F.lit(1), F.length("segment")))
    suffixes = texts.select("rep", "segment", places.alias("i")).select(F.expr("substring(segment, i)").alias("text"), F.lit(1).alias("kind"), "rep")
    ordered = cut(entries.unionByName(suffixes).sort("text", "kind", "rep").withColumn("part", F.spark_partition_id()))
    firsts = ordered.groupBy("part").agg(F.min("text").alias("first"))
    heads = firsts.select("part", F.explode(F.sequence(F.lit(1), F.length("first"))).alias("n"), "first").select("part", F.expr("left(first, n)").alias("text"))
    before = heads.join(ordered.filter("kind = 0").select("text", "rep", F.col("part").alias("of")), "text").filter("of < part")
    chains: dict[int, list[tuple[str, int]]] = {}
    for r in before.select("part", "text", "rep").orderBy("part", F.length("text")).collect():  # lengths that occur, for each partition
        chains.setdefault(r["part"], []).append((r["text"], r["rep"]))
    pairs = ordered.mapInArrow(_begins(chains), "outer_rep long, inner_rep long").distinct()
    members = named.join(texts, "segment").select("rep", "seg_id")
    outer, inner = (members.select(F.col("rep").alias(f"{x}_rep"), F.col("seg_id").alias(f"{x}_id")) for x in ("outer", "inner"))
    proper = pairs.join(outer, "outer_rep").join(inner, "inner_rep").select("outer_id", "inner_id")
    equal = outer.join(inner, F.col("outer_rep") == F.col("inner_rep")).filter("outer_id < inner_id").select("outer_id", "inner_id")
    return proper.unionByName(equal)


def _begins(chains: dict[int, list[tuple[str, int]]]):
    """Pairs of a suffix's entry and each other entry that begins the suffix, of rows in order."""

    def run(batches):
        chain = None
        for b in batches:
            outer, inner = [], []
            for text, kind, rep, part in zip(*(b.column(c).to_pylist() for c in ("text", "kind", "rep", "part")), strict=True):
                if chain is None:
                    chain = list(chains.get(part, []))
                while chain and not text.startswith(chain[-1][0]):
                    chain.pop()
                if kind == 0:
                    chain.append((text, rep))
                    continue
                for _, other in chain:
                    if other != rep:
                        outer.append(rep)
                        inner.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(outer, pa.int64()), pa.array(inner, pa.int64())], names=["outer_rep", "inner_rep"])

    return run


def eliminate_redundant(ranked: DataFrame) -> DataFrame:
    """``ranked(rank, segment)``, best first, without entries that contain, or are contained in, a better one that stays.

    The lexicographically first independent set of the containment graph; equal texts collapse. Ranks stay as they are.
    """
    if ranked.count() <= DRIVER_POOL:
        rows = ranked.orderBy("rank").collect()
        kept = _first_independent([r["segment"] for r in rows])
        return ranked.sparkSession.createDataFrame([(rows[i]["rank"], rows[i]["segment"]) for i in kept], ranked.select("rank", "segment").schema)
    return eliminate_distributed(ranked)


def _first_independent(segments: list[str]) -> list[int]:
    """Greedy scan: a kept entry is listed under itself and marks all its substrings of lengths that occur."""
    lengths = sorted({len(s) for s in segments})
    kept: set[str] = set()
    inside: set[str] = set()  # substrings of kept entries
    out = []
    for i, s in enumerate(segments):
        cuts = {s[a : a + n] for n in lengths if n <= len(s) for a in range(len(s) - n + 1)}
        if s in inside or cuts & kept:
            continue
        out.append(i)
        kept.add(s)
        inside |= cuts
    return out


def eliminate_distributed(ranked: DataFrame) -> DataFrame:
    """``eliminate_redundant`` as a fix-point of joins, for pools of any size."""
    pairs = containment_pairs(ranked.select(F.col("rank").alias("seg_id"), "segment"))
    edges = cut(pairs.select(F.least("outer_id", "inner_id").alias("better"), F.greatest("outer_id", "inner_id").alias("worse")).distinct())
    live = cut(ranked.select("rank", "segment"))
    kept = None
    while not live.isEmpty():
        # those with no better neighbour left stay; their worse neighbours go
        now = live.join(edges.select(F.col("worse").alias("rank")).distinct(), "rank", "left_anti")
        kept = now if kept is None else kept.unionByName(now)
        gone = edges.join(now.select(F.col("rank").alias("better")), "better").select(F.col("worse").alias("rank")).distinct()
        live = cut(live.join(now.select("rank"), "rank", "left_anti").join(gone, "rank", "left_anti"))
        names = live.select("rank")
        kept = cut(kept)
        edges = cut(edges.join(names.withColumnRenamed("rank", "better"), "better").join(names.withColumnRenamed("rank", "worse"), "worse").select("better", "worse"))
    return kept if kept is not None else live


class SegmentPool:
    """Segments in column order (``seg_id`` from 0) with the two lengths that steer extension."""

    def __init__(self, table: DataFrame, last_length: int = 0, current_max: int = 0) -> None:
        self.table, self.last_length, self.current_max = table, last_length, current_max

    @classmethod
    def seed(cls, spark: SparkSession, alphabet: Alphabet, k: int, ext: int) -> SegmentPool:
        return cls(canonical_kmers(spark, alphabet, k), k - ext, k)

    @classmethod
    def of(cls, spark: SparkSession, segments: list[str], last_length: int = 0, current_max: int = 0) -> SegmentPool:
        return cls(spark.createDataFrame(list(enumerate(segments)), "seg_id long, segment string"), last_length, current_max)

    def segments(self) -> list[str]:
        return [r["segment"] for r in self.table.orderBy("seg_id").collect()]

    def subset(self, ranked: DataFrame) -> SegmentPool:
        """The entries ``ranked(seg_id, rank)`` in rank order; an id outside the pool is an error."""
        if not ranked.join(self.table, "seg_id", "left_anti").isEmpty():
            raise IndexError("a selected column is not in the pool")
        got = self.table.join(ranked, "seg_id").select("rank", "segment")
        return SegmentPool(number_rows(got, [F.col("rank").asc()], "seg_id").select("seg_id", "segment"), self.last_length, self.current_max)

    def without_redundancy(self) -> SegmentPool:
        kept = eliminate_redundant(self.table.select(F.col("seg_id").alias("rank"), "segment"))
        return SegmentPool(number_rows(kept, [F.col("rank").asc()], "seg_id").select("seg_id", "segment"), self.last_length, self.current_max)

    def extended(self, alphabet: Alphabet, ext: int) -> SegmentPool | None:
        """The extended pool, or None where no entry has a length that is due."""
        if self.table.filter(F.length("segment").between(self.last_length + 1, self.last_length + ext)).isEmpty():
            return None
        return SegmentPool(extend(self.table, alphabet, self.last_length, ext), self.current_max, self.current_max + ext)

    def appended(self, segments: list[str], current_max: int) -> SegmentPool:
        more = self.table.sparkSession.createDataFrame(list(enumerate(segments)), "ord long, segment string")
        return SegmentPool(append(self.table, more), self.current_max, current_max)

    def grafted(self) -> SegmentPool:
        return SegmentPool(graft(self.table, self.last_length, self.current_max), self.last_length, self.current_max)

    def filled(self, alphabet: Alphabet, limit: int, length: int, seed: int = 42) -> SegmentPool:
        """Random segments added until there are ``limit``; a draw that repeats an entry adds nothing."""
        n = self.table.count()
        if n >= limit:
            return self
        wanted = min(limit, n + alphabet.base**length)
        drawn = self.table.sparkSession.range(4 * (wanted - n) + 16).select(F.col("id").alias("ord"), random_segment(alphabet, length, seed).alias("segment"))
        grown = append(self.table, drawn)
        return SegmentPool(grown.filter(F.col("seg_id") < limit), self.last_length, self.current_max)

    def save(self, path: str) -> None:
        """A JSON checkpoint of a pool that fits the driver."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps({"last_length": self.last_length, "current_max": self.current_max, "segments": self.segments()}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SegmentPool:
        d = json.loads(Path(path).read_text())
        return cls.of(spark, d["segments"], d["last_length"], d["current_max"])


    def save_table(self, path: str) -> None:
        """The pool under ``path``, written by Spark: ``segments`` as Parquet, its two lengths as JSON. Nothing passes through the driver."""
        self.table.write.mode("overwrite").parquet(f"{path}/segments")
        self.table.sparkSession.createDataFrame([(self.last_length, self.current_max)], "last_length int, current_max int").coalesce(1).write.mode("overwrite").json(f"{path}/lengths")

    @classmethod
    def load_table(cls, spark: SparkSession, path: str) -> SegmentPool:
        lengths = spark.read.schema("last_length int, current_max int").json(f"{path}/lengths").first()
        return cls(spark.read.parquet(f"{path}/segments"), lengths["last_length"], lengths["current_max"])


def random_segment(alphabet: Alphabet, length: int, seed: int = 42):
    """Uniform characters, the same for a row number ``id`` and seed."""
    pick = [F.substring(F.lit(alphabet.symbols()), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(alphabet.base)) + 1).cast("int"), F.lit(1)) for i in range(length)]
    return F.concat(*pick) if pick else F.lit("")


def near_equal_parts(n: int, target: int) -> tuple[int, int, int]:
    """Number of parts for ``n`` columns, their least size, and how many have one more."""
    parts = max(n // target, 1) if target > 0 else 1
    return parts, *divmod(n, parts)


def partition_of(seg_id: str, n: int, target: int):
    """The contiguous feature partition of a column."""
    _, size, extra = near_equal_parts(n, target)
    c, edge = F.col(seg_id).cast("long"), extra * (size + 1)
    late = F.call_function("div", c - edge, F.lit(max(size, 1))) + extra
    return F.when(c < edge, F.call_function("div", c, F.lit(size + 1))).otherwise(late).cast("int")


def oversample(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Every class repeated to the size of the largest: whole copies first, then its first rows in ``order``."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}  # one row per class
    most = max(sizes.values(), default=0)
    out = None
    for value, n in sizes.items():
        mine = number_rows(df.filter(F.col(label).eqNullSafe(F.lit(value))), [F.col(c).asc() for c in order], "__r")
        times = F.lit(most // n) + (F.col("__r") < most % n).cast("int")
        mine = mine.withColumn("copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int")))).drop("__r")
        out = mine if out is None else out.unionByName(mine)
    return out if out is not None else df.withColumn("copy", F.lit(0))


