"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are taken from a bounded sample. A vector is described by its nearest pivots in order of nearness; the
inverted lists of pivots, intersected two at a time, list the vectors that have both among their nearest.
Two vectors meet in the list of their lowest-numbered common pair only, are compared if they share enough pivots, their sign
sketches agree and the places of pivots in the two orders are near enough, and are then verified by their cosine in double
precision. Equal vectors are one entry with a count. Long lists are dealt out in parts that all meet, so no list is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, join_names, runs, split_hot
from strandloom.llm.components import connected_components

COSINE = 0.95
#: Nearest pivots that describe a vector, and how many of them two vectors must share.
NEAREST = 8
SHARED = 2
#: Vectors that pivots are chosen from: so many for each, taken by a hash.
SAMPLED = 4
#: Pivots grow as twice the root of the number of distinct vectors, up to this many, so that lists stay short.
MOST_PIVOTS = 1024
#: Bits of 64 random signs that may differ; at cosine 0.95 about 6.5 do, with a deviation of 2.4.
SKETCH_BITS = 18
#: Greatest footrule of two orders: places that shared pivots moved by, a pivot of one order only counting as the first place
#: past the end of the other. Without a shared pivot it is 72; of pairs at cosine 0.95 none was over 60.
FOOTRULE = 64
LIST_CHUNK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _choose_pivots(reps: DataFrame, n: int, size: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Pivots (unit rows) and sketch directions for vectors of ``size`` components."""
    m = max(16, min(MOST_PIVOTS, round(2 * math.sqrt(n))))
    hashed = reps.select("v", "rid", F.xxhash64("v").alias("h"))
    if n > 4 * SAMPLED * m:  # the hashes are even, so this leaves twice as many as are wanted, whatever the number of tasks
        hashed = hashed.filter(F.pmod("h", F.lit(1 << 40)) < int(2 * SAMPLED * m / n * (1 << 40)))
    some = hashed.orderBy(F.pmod("h", F.lit(1 << 40)), "h", "rid").limit(SAMPLED * m).select("v").collect()  # a bounded sample
    rng = np.random.default_rng(seed)
    x = np.array([r["v"] for r in some], dtype=np.float64).reshape(len(some), size)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    # each next pivot is the one least like those chosen, so that a crowd of like vectors gives one
    chosen, near = [], np.full(len(x), -2.0)
    while len(chosen) < min(m, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
        near[chosen] = np.inf
    p = x[chosen].reshape(len(chosen), size)
    p = np.concatenate([p, rng.normal(size=(m - len(p), size))]) if len(p) < m else p
    return p / np.linalg.norm(p, axis=1, keepdims=True), rng.normal(size=(size, 64))


def _postings(reps: DataFrame, pivots: np.ndarray, directions: np.ndarray) -> DataFrame:
    """``key, rid, prefix, sketch``: a row for each pair of a vector's nearest pivots; ``prefix`` holds these, nearest first."""
    k = min(NEAREST, len(pivots))
    a, b = np.triu_indices(k, 1)
    sent = reps.sparkSession.sparkContext.broadcast((pivots, directions))  # of a fixed size

    def run(batches):
        p, d = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = _matrix(batch.column("v"))
                x /= np.abs(x).max(axis=1, keepdims=True)
                like = x @ p.T
                near = np.argpartition(-like, k - 1, axis=1)[:, :k].astype(np.int64)
                near.sort(axis=1)
                order = np.take_along_axis(near, np.argsort(-np.take_along_axis(like, near, axis=1), axis=1, kind="stable"), axis=1)
                sketch = np.packbits(x @ d > 0, axis=1, bitorder="little").view(np.int64)[:, 0]
                key = (near[:, a] * len(p) + near[:, b]).ravel()
                row = np.repeat(np.arange(len(x)), len(a))
                prefix = pa.array([r.tobytes() for r in order.astype(np.uint16)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("rid").take(pa.array(row)), prefix.take(pa.array(row)), pa.array(sketch[row])], names=["key", "rid", "prefix", "sketch"])

    return reps.select("rid", "v").mapInArrow(run, "key long, rid long, prefix binary, sketch long")


def _footrule(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How far the orders in the rows of ``p`` and ``q`` are apart."""
    k = p.shape[1]
    same = p[:, :, None] == q[:, None, :]
    place = np.arange(k)
    moved = (np.abs(place[:, None] - place) * same).sum(axis=(1, 2))
    return moved + ((k - place) * ~same.any(axis=2)).sum(axis=1) + ((k - place) * ~same.any(axis=1)).sum(axis=1)


def _candidates(postings: DataFrame, n_pivots: int) -> DataFrame:
    """``a, b``: pairs that share enough pivots, each from the list of its first common pair."""
    k = min(NEAREST, n_pivots)
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = split_hot(postings, "key", "rid", LIST_CHUNK, own="cm").repartition(parts, "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "cm", "rid")

    def compare(i, j, key, rid, prefix, sketch):
        ok = np.bitwise_count(sketch[i] ^ sketch[j]) <= SKETCH_BITS
        i, j = i[ok], j[ok]
        if not len(i):
            return i, j
        numbers = np.sort(prefix[i], axis=1)
        common = (numbers[:, :, None] == prefix[j][:, None, :]).any(axis=2)
        enough = common.sum(axis=1) >= min(SHARED, k)
        i, j, common, numbers = i[enough], j[enough], common[enough], numbers[enough]
        if not len(i):
            return i, j
        first = common.argmax(axis=1)
        rest = common.copy()
        rest[np.arange(len(i)), first] = False
        second = rest.argmax(axis=1)
        rows = np.arange(len(i))
        mine = numbers[rows, first].astype(np.int64) * n_pivots + numbers[rows, second] == key[i]
        i, j = i[mine], j[mine]
        near = _footrule(prefix[i], prefix[j]) <= FOOTRULE
        return i[near], j[near]

    def run(batches):
        names = ("key", "ci", "cj", "cm", "rid", "prefix", "sketch")

        def solve(c):
            cell = np.zeros(len(c["key"]), dtype=[("k", "<i8"), ("i", "<i4"), ("j", "<i4")])
            cell["k"], cell["i"], cell["j"] = c["key"], c["ci"], c["cj"]
            edge = runs(cell)
            size = np.diff(edge)
            args = c["key"], c["rid"], c["prefix"], c["sketch"]
            found = []
            small = np.repeat(size, size)
            whole = c["ci"] == c["cj"]
            for step in range(1, int(min(64, size.max(initial=0)))):
                i = np.flatnonzero((cell[:-step] == cell[step:]) & (small[:-step] <= 64))
                i = i[whole[i] | (c["cm"][i] != c["cm"][i + step])]
                found.append(compare(i, i + step, *args))
            for r in np.flatnonzero(size > 64).tolist():
                a, e = int(edge[r]), int(edge[r + 1])
                if whole[a]:
                    pairs = ((np.full(e - i - 1, i), np.arange(i + 1, e)) for i in range(a, e - 1))
                else:
                    mid = a + int(np.searchsorted(c["cm"][a:e], c["cj"][a]))
                    pairs = ((np.full(e - mid, i), np.arange(mid, e)) for i in range(a, mid))
                held, n = [], 0
                for pair in pairs:
                    held.append(pair)
                    n += len(pair[0])
                    if n > 200_000:
                        found.append(compare(*map(np.concatenate, zip(*held, strict=True)), *args))
                        held, n = [], 0
                if held:
                    found.append(compare(*map(np.concatenate, zip(*held, strict=True)), *args))
            i = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
            j = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
            for at in range(0, max(1, len(i)), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(c["rid"][i[at : at + 500_000]]), pa.array(c["rid"][j[at : at + 500_000]])], names=["a", "b"])

        left = None
        for b in batches:
            c = {x: b.column(x).to_numpy(zero_copy_only=False) for x in names if x != "prefix"}
            c["sketch"] = c["sketch"].astype(np.int64).view(np.uint64)
            c["prefix"] = np.frombuffer(b"".join(b.column("prefix").to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, k), np.uint16)
            if left is not None:
                c = {x: np.concatenate([left[x], c[x]]) for x in c}
            n = len(c["key"])
            if not n:
                continue
            last = int(np.flatnonzero((c["key"] != c["key"][-1]) | (c["ci"] != c["ci"][-1]) | (c["cj"] != c["cj"][-1]))[-1]) + 1 if (c["key"][0], c["ci"][0], c["cj"][0]) != (c["key"][-1], c["ci"][-1], c["cj"][-1]) else 0
            if last:
                yield from solve({x: y[:last] for x, y in c.items()})
            left = {x: y[last:] for x, y in c.items()}
        if left is not None and len(left["key"]):
            yield from solve(left)

    return dealt.select("key", "ci", "cj", "cm", "rid", "prefix", "sketch").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    va = reps.select(F.col("rid").alias("a"), F.col("v").alias("va"), F.col("copies").alias("na"))
    vb = reps.select(F.col("rid").alias("b"), F.col("v").alias("vb"), F.col("copies").alias("nb"))

    def run(batches):
        for b in batches:
            x, y = _matrix(b.column("va")), _matrix(b.column("vb"))
            x /= np.abs(x).max(axis=1, keepdims=True)
            y /= np.abs(y).max(axis=1, keepdims=True)
            ok = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= cosine
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    return pairs.join(va, "a").join(vb, "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, "a long, b long, na long, nb long")


def links(reps: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """``a, b, na, nb``: pairs of distinct vectors ``reps(rid, v, copies)`` found by the index, with their counts of copies."""
    out = None
    for r in reps.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each length of vector
        mine = reps.filter(F.size("v") == r["size"])
        pivots, directions = _choose_pivots(mine, r["n"], r["size"])
        found = _verified(_candidates(_postings(mine, pivots, directions), len(pivots)), mine, cosine)
        out = found if out is None else out.unionByName(found)
    return out


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    A null or empty vector, one of zeros only, or with a null or non-finite component links with nothing and is its own
    component; vectors of different lengths never link. A null id never names a component unless all its ids are null, and is kept only then. Equal vectors link with each other. Repeated rows and ids keep a
    row each; extra columns are ignored; an empty table gives no rows.
    """
    named = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    big = F.lit(1.7976931348623157e308)
    ok = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big)) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = named.filter(ok)
    # equal vectors once, numbered; the checkpoint fixes the numbers
    reps = cut(good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("rid", F.monotonically_increasing_id()))
    found = links(reps, cosine=cosine)
    if found is None:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    degree = found.select(F.col("a").alias("rid"), F.col("nb").alias("n")).unionByName(found.select(F.col("b").alias("rid"), F.col("na").alias("n"))).groupBy("rid").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = reps.join(degree, "rid", "left").join(roots, reps.rid == roots.vertex, "left")
    known = cut(known.select("v", "least", F.col("copies").alias("n"), "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    grouped = known.filter("root IS NOT NULL")
    lowest = cut(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    names = join_names(grouped.select("v", "n", "n_links", "root").withColumnRenamed("n", "copies"), lowest, "root").select("v", F.col("copies").alias("n"), "n_links", "component_id")
    names = cut(names.unionByName(known.filter("root IS NULL").select("v", "n", "n_links", F.col("least").alias("component_id"))))
    linked = join_names(good, names, "v").select("vec_id", "n_links", "component_id")
    alone = named.filter(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
