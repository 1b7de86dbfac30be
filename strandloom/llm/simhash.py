"""SimHash near-duplicates found by pigeonhole blocks of the fingerprints.

A 64-bit fingerprint is cut into ``m`` blocks. Two fingerprints that differ in at most ``d`` bits
agree on at least ``m - d`` whole blocks, so each is listed under every choice of ``m - d`` blocks and
only those that share a choice are compared. ``m`` grows with the number of distinct fingerprints,
which keeps lists short; any ``m`` finds every pair.

Texts that share four of five shingles differ in some ten of 64 bits, too many for blocks of such a fingerprint: either
blocks get so short that everything shares them, or their number grows with the corpus. ``representatives`` therefore uses
long fingerprints each of whose blocks is the SimHash of a small sample of the shingles, the first few in an order that
belongs to the block. Texts of Jaccard similarity J have the same sample, and so the same block, with a probability of about
J^5; of 20 blocks they share one with 1 - (1 - 0.8^5)^20 = 0.9996 at least. Texts that share a block are compared by the Hamming
distance of the whole fingerprint and then by their shingle sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, join_names, runs, slices, split_hot
from strandloom.llm.components import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Members of a list compared in one task; larger lists are dealt out in parts that all meet.
LIST_CHUNK = 1024

#: Settings for alike texts: words of a shingle, Jaccard similarity of a link.
ALIKE_SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of 64 bits, and shingles sampled for each.
BLOCKS, SAMPLE = 20, 5
#: Bits of all blocks that alike texts differ in at most: at a similarity of 0.8 they are 185 with a deviation of 35, of unlike texts 640 with one of 20.
BLOCK_BITS = 400
#: Members of a block compared in one task; larger lists are dealt out in parts that all meet.
ALIKE_CHUNK = 256

_MULTIPLY, _ADD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BLOCKS, 1), dtype=np.uint64)
_MULTIPLY |= np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; 0 where there are no words."""
    h = _shingles(_words(text), shingle)
    n = len(h)
    count = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 16):
        count += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * count > n
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp long`` for every row, the 64 bits read as a signed number."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], names=schema.names)

    return docs.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text").mapInArrow(run, schema)


def plan_blocks(n: int, distance: int = DISTANCE) -> tuple[int, list[int]]:
    """Number of blocks and the masks of every choice of blocks, for ``n`` distinct fingerprints."""
    want = max(1, n).bit_length() + 2
    m = distance + 1
    while m < distance + 5 and 64 * (m - distance) // m < want:
        m += 1
    edge = [64 * i // m for i in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return m, [sum(x) for x in combinations(block, m - distance)]


def _close(fps: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(fps[a] ^ fps[b]) <= distance


def _links(distance: int):
    """Within each run of (key, ci, cj): a spanning forest of the pairs at most ``distance`` bits apart."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def in_run(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Breadth first: each member is compared with those not reached yet."""
        us, vs, left = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(f))
        while len(left) > 1:
            stack, left = [int(left[0])], left[1:]
            while stack and len(left):
                i = stack.pop()
                near = np.bitwise_count(f[left] ^ f[i]) <= distance
                if near.any():
                    got, left = left[near], left[~near]
                    us.append(np.full(len(got), i))
                    vs.append(got)
                    stack += got.tolist()
        return np.concatenate(us), np.concatenate(vs)

    def solve(cells: np.ndarray, fps: np.ndarray):
        edge = runs(cells)
        size = np.diff(edge)
        us, vs = [], []
        small = np.repeat(size, size)
        for step in range(1, int(min(32, size.max(initial=0)))):  # short runs, all at once
            i = np.flatnonzero((cells[:-step] == cells[step:]) & (small[:-step] <= 32))
            i = i[_close(fps, i, i + step, distance)]
            us.append(fps[i])
            vs.append(fps[i + step])
        for k in np.flatnonzero(size > 32).tolist():
            f = np.unique(fps[edge[k] : edge[k + 1]])
            i, j = in_run(f)
            us.append(f[i])
            vs.append(f[j])
        u = np.concatenate([np.zeros(0, np.uint64), *us]).view(np.int64)
        v = np.concatenate([np.zeros(0, np.uint64), *vs]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        left = None  # the last run may go on in the next batch
        for b in batches:
            key = np.zeros(b.num_rows, dtype=[("k", "<i8"), ("m", "<i4"), ("i", "<i4"), ("j", "<i4")])
            for name, column in (("k", "key"), ("m", "mask"), ("i", "ci"), ("j", "cj")):
                key[name] = b.column(column).to_numpy(zero_copy_only=False)
            fps = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if left is not None:
                key, fps = np.concatenate([left[0], key]), np.concatenate([left[1], fps])
            if not len(key):
                continue
            cut_at = int(runs(key)[-2])
            if cut_at:
                yield solve(key[:cut_at], fps[:cut_at])
            left = key[cut_at:], fps[cut_at:]
        if left is not None and len(left[0]):
            yield solve(*left)

    return run, schema


def close_pairs(distinct: DataFrame, *, distance: int = DISTANCE, n: int | None = None) -> DataFrame:
    """``u, v``: links between distinct fingerprints (column ``fp``) that connect just what all close pairs connect."""
    n = distinct.count() if n is None else n
    _, masks = plan_blocks(n, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("mask", "key"))
    rows = rows.withColumn("cell", F.xxhash64("mask", "key"))
    dealt = split_hot(rows, "cell", "fp", LIST_CHUNK)
    run, schema = _links(distance)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "cell", "ci", "cj").sortWithinPartitions("mask", "key", "ci", "cj")
    return dealt.select("key", "mask", "ci", "cj", "fp").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable by links of at most ``distance`` differing bits.
    Null, empty and white-space texts have fingerprint zero and link like any other. Documents with one
    fingerprint are one vertex, so copies cost one row. Repeated rows and ids keep a row each; a null
    ``doc_id`` is never a component's name unless all ids there are null; extra columns are ignored; an empty table gives no
    rows, and a text of any length is read whole.
    """
    marked = cut(fingerprints(docs, id_column=id_column, text_column=text_column, shingle=shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(close_pairs(distinct, distance=distance))
    linked = cut(distinct.join(roots, distinct.fp == roots.vertex).select("fp", "least", "n", "root"))
    lowest = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    alone = distinct.join(linked.select("fp"), "fp", "left_anti").select("fp", "n", F.col("least").alias("component_id"))
    named = cut(join_names(linked.select("fp", "n", "root"), lowest, "root").select("fp", "n", "component_id").unionByName(alone))
    return join_names(marked, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- alike texts, by blocks of their own samples


def _shingles(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles in order; a shorter text is one shingle, one without words none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], dtype=np.uint64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, shingle: int = ALIKE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(_shingles(_words(text), shingle))


def block_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The ``BLOCKS`` blocks of 64 bits of a set: block b is the SimHash of the ``SAMPLE`` members that come first in an order of its own. None for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    best = np.zeros((BLOCKS, 0), np.uint64)
    for a in range(0, len(hashes), 1 << 14):
        some = hashes[a : a + (1 << 14)]
        best = np.concatenate([best, np.broadcast_to(some, (BLOCKS, len(some)))], axis=1)
        if best.shape[1] > SAMPLE:
            first = np.argpartition(best * _MULTIPLY + _ADD, SAMPLE - 1, axis=1)[:, :SAMPLE]
            best = np.take_along_axis(best, first, axis=1)
    n = best.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(best).view(np.uint8).reshape(BLOCKS, n, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(2 * bits > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def links_within(sets: list[np.ndarray], blocks: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets alike to ``similarity``; breadth first, each compared with those not reached yet.

    ``blocks[i]`` is a set's fingerprint: only pairs within ``BLOCK_BITS`` bits have their sets compared."""
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(len(ids), bool)
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            fits = np.minimum(size[left], size[i]) >= similarity * np.maximum(size[left], size[i])
            fits &= np.bitwise_count(blocks[left] ^ blocks[i]).sum(axis=1, dtype=np.int64) <= BLOCK_BITS
            near = np.zeros(len(left), bool)
            held[ids[at[i] : at[i + 1]]] = True
            for k in np.flatnonzero(fits).tolist():
                j = left[k]
                both = int(np.count_nonzero(held[ids[at[j] : at[j + 1]]]))
                near[k] = both >= similarity * (size[i] + size[j] - both)
            held[ids[at[i] : at[i + 1]]] = False
            got, left = left[near].tolist(), left[~near]
            out += [(i, j) for j in got]
            stack += got
    return out


def _number(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _marked(docs: DataFrame, id_columns: list[str], text_column: str) -> DataFrame:
    """The id columns, ``v`` (a number of the shingle set) and ``blocks`` of every row."""
    kept = docs.select(*id_columns, F.col(text_column).alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("v", T.LongType()), T.StructField("blocks", T.ArrayType(T.LongType()))])

    def run(batches):
        for whole in batches:
            for b in slices(whole, "__text"):
                sets = [shingle_set(t) for t in b.column("__text").to_pylist()]
                v = np.array([_number(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(v), pa.array([block_fingerprint(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], names=schema.names)

    return kept.mapInArrow(run, schema)


def _sets(texts: DataFrame) -> DataFrame:
    """``v, blocks binary, shingles binary`` of the distinct shingle sets of ``text``."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [shingle_set(t) for t in b.column("text").to_pylist()]
                v = np.array([_number(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array([block_fingerprint(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["v", "blocks", "shingles"])

    return texts.select("text").mapInArrow(run, "v long, blocks binary, shingles binary").groupBy("v").agg(F.first("blocks").alias("blocks"), F.first("shingles").alias("shingles"))


def _alike(batches):
    """Verified links ``u, v`` within each run of (key, ci, cj)."""

    def solve(held):
        found = links_within([np.frombuffer(s, np.uint64) for *_, s in held], np.array([np.frombuffer(x, np.uint64) for _, x, _ in held]))
        return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[j][0] for _, j in found], pa.int64())], names=["u", "v"])

    now, held = None, []
    for b in batches:
        for *cell, v, x, s in zip(*(b.column(k).to_pylist() for k in ("key", "ci", "cj", "v", "blocks", "shingles")), strict=True):
            if cell != now:
                if len(held) > 1:
                    yield solve(held)
                now, held = cell, []
            held.append((v, x, s))
    if len(held) > 1:
        yield solve(held)


def representatives(docs: DataFrame, id_columns: list[str], *, text_column: str = "text") -> DataFrame:
    """The least ``id_columns`` of each group of rows that links of alike texts connect, one row a group.

    Texts are linked whose sets of ``ALIKE_SHINGLE``-word shingles have a Jaccard similarity of ``SIMILARITY`` or more, every link verified; links
    are looked for among texts that share a whole block. Texts without words are equal to each other. Ids must not be null; repeated rows and ids
    are fine, an empty table gives no rows, and a text of any length is read whole.
    """
    marked = cut(_marked(docs, id_columns, text_column))
    distinct = cut(marked.groupBy("v").agg(F.min(F.struct(*id_columns)).alias("least"), F.first("blocks").alias("blocks")))
    rows = distinct.select("v", F.posexplode("blocks").alias("place", "block")).select("v", F.xxhash64("place", "block").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v")).alias("x"), F.min("v").alias("m")).filter("n > 1")
    shared = shared.groupBy("n", "x", "m").agg(F.min("key").alias("key")).select("key", "n")  # blocks shared by the same texts once
    members = cut(join_names(rows, cut(shared), "key").select("key", "v"))
    # one text of every candidate
    wanted = distinct.join(members.select("v").distinct(), "v", "left_semi").select(*(F.col(f"least.{c}").alias(c) for c in id_columns))
    sets = _sets(docs.select(*id_columns, F.col(text_column).alias("text")).join(wanted, id_columns, "left_semi"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = split_hot(members, "key", "v", ALIKE_CHUNK).join(sets, "v")
    dealt = dealt.repartition(parts, "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj").select("key", "ci", "cj", "v", "blocks", "shingles")
    roots = connected_components(dealt.mapInArrow(_alike, "u long, v long"))
    named = distinct.join(roots, distinct.v == roots.vertex, "left").select("least", F.coalesce("root", "v").alias("root"))
    return named.groupBy("root").agg(F.min("least").alias("least")).select(*(F.col(f"least.{c}").alias(c) for c in id_columns))
