"""Histogram boosting as plans, for more samples and entries than a task can hold.

Samples are dealt to blocks by a hash, and a block's entries, about ``BLOCK_ENTRIES``, are packed into one row with the samples' labels. Bins come from an exact
histogram of the values of every column, aggregated over all training samples. One level of a tree is one pass over the blocks, each task of which sums the
gradients of its samples by node, column and bin; only these sums are shuffled, no group holds more than the bins of a column in a node, and the driver sees the best
split of each node only, and the cuts of the columns (255 each at most), which it sends to the tasks.
Bins, splits and ties are those of ``boosting.Booster``: the trees are the same. With ``zero_as_missing`` what a sample has no entry for is
missing, and each split learns to which side it goes from the sums of what is there.

With ``progress`` every few rounds are logged, from which a run that was killed goes on to the same trees.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.plans.boosting import DEPTH, NODE_COLUMNS, NODE_SCHEMA, PATIENCE
from strandloom.plans.lineage import cut

BINS = 256
#: Rounds between two entries of the log.
LOGGED = 10
#: Entries of a block, sums that a task keeps side by side at most, and rounds after which predictions are stored with the blocks.
BLOCK_ENTRIES, SUMS, STORED = 1 << 18, 1 << 22, 25


def histogram_bins(counts: DataFrame, n_rows: int, *, bins: int = BINS, zero_as_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """``seg_id, n, bin`` of every value of ``counts(seg_id, n)``, the entries of ``n_rows`` samples, and ``seg_id, bin, threshold``: the cut above a bin.

    A column with fewer than ``bins`` values has a bin for each, else one for every (bins - 1)th part of its rows; zeros count as a value
    unless they are missing. What is missing lies above one more cut.
    """
    return _bins_of(counts.groupBy("seg_id", "n").agg(F.count(F.lit(1)).alias("m")), n_rows, bins, zero_as_missing)


def _bins_of(seen: DataFrame, n_rows: int, bins: int, zero_as_missing: bool) -> tuple[DataFrame, DataFrame]:
    if not zero_as_missing:
        zeros = seen.groupBy("seg_id").agg((F.lit(n_rows) - F.sum("m")).alias("m")).filter("m > 0").select("seg_id", F.lit(0.0).alias("n"), "m")
        seen = seen.unionByName(zeros)
    column, up = W.partitionBy("seg_id"), W.partitionBy("seg_id").orderBy("n")
    ranked = seen.select("seg_id", "n", F.count(F.lit(1)).over(column).alias("d"), (F.sum("m").over(column) - 1).alias("last"), (F.sum("m").over(up) - F.col("m")).alias("lo"), F.sum("m").over(up).alias("hi"))
    near = F.floor(F.col("lo") * (bins - 2) / F.greatest(F.col("last"), F.lit(1)))
    quantile = F.exists(F.sequence(near - 1, near + 2), lambda j: (j >= 0) & (j <= bins - 2) & (F.rint(j * F.col("last") / (bins - 2)) >= F.col("lo")) & (F.rint(j * F.col("last") / (bins - 2)) < F.col("hi")))
    kept = ranked.select("seg_id", "n", ((F.col("d") <= bins - 1) | quantile).alias("kept"))
    after = F.min(F.when(F.col("kept"), F.col("n"))).over(up.rowsBetween(1, W.unboundedFollowing))
    placed = kept.select("seg_id", "n", "kept", (F.sum(F.col("kept").cast("int")).over(up) - 1).alias("k"), F.max(F.when(F.col("kept"), F.col("n"))).over(up).alias("at"), after.alias("after"))
    placed = cut(placed.withColumn("threshold", (F.col("at") + F.col("after")) / 2.0))
    values = placed.filter("n <> 0").select("seg_id", "n", (F.col("k") + F.when(~F.col("kept") & (F.col("n") >= F.col("threshold")), 1).otherwise(0)).cast("int").alias("bin"))
    top = F.col("at") + 1.0 if zero_as_missing else F.lit(None).cast("double")
    cuts = placed.filter("kept").select("seg_id", F.col("k").cast("int").alias("bin"), F.coalesce("threshold", top).alias("threshold")).filter("threshold IS NOT NULL")
    return values, cuts


def best_splits(seen: DataFrame, totals: dict[int, tuple[float, float]], *, zero_as_missing: bool = False, reg_lambda: float = 1.0, min_child: float = 1.0) -> dict[int, tuple]:
    """``node -> (gain, seg_id, bin, missing goes left, g, h)`` by ``seen(node, seg_id, bin, g, h)``, of which bins add up; ``totals`` are the nodes' ``g, h``, those of a split are of its left side.

    Equal gains go to missing left, then the smallest column, then the smallest threshold."""
    spark = seen.sparkSession
    sums = F.broadcast(spark.createDataFrame([(k, *map(float, x)) for k, x in totals.items()], "node int, tg double, th double"))  # one row per node of a level
    seen = seen.repartition("node", "seg_id").groupBy("node", "seg_id", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.max("cuts").alias("cuts"))
    column, up = W.partitionBy("node", "seg_id"), W.partitionBy("node", "seg_id").orderBy("bin")
    s = seen.select("node", "seg_id", "bin", "cuts", F.sum("g").over(up).alias("g"), F.sum("h").over(up).alias("h"), F.sum("g").over(column).alias("pg"), F.sum("h").over(column).alias("ph"), F.row_number().over(up).alias("i")).join(sums, "node")
    side = lambda j, g, h: F.struct(j.cast("int").alias("bin"), g.alias("g"), h.alias("h"))
    upto, zero = side(F.col("bin"), F.col("g"), F.col("h")), F.lit(0.0)
    # a cut after each bin of the node; and one below the first, if the column has a lower bin
    s = s.withColumn("c", F.explode(F.when((F.col("i") == 1) & (F.col("bin") > 0), F.array(side(F.lit(0), zero, zero), upto)).otherwise(F.array(upto))))
    rest_g, rest_h = F.col("tg") - F.col("pg"), F.col("th") - F.col("ph")
    to_left = F.struct(F.lit(True).alias("left"), (F.col("c.g") + rest_g).alias("g"), (F.col("c.h") + rest_h).alias("h"))
    if zero_as_missing:
        ways = F.array(to_left, F.struct(F.lit(False).alias("left"), F.col("c.g").alias("g"), F.col("c.h").alias("h")))
    else:  # zeros lie below every cut
        ways = F.array(to_left.withField("left", F.lit(False)))
    s = s.select("node", "seg_id", F.col("c.bin").alias("bin"), "cuts", "tg", "th", F.explode(ways).alias("w")).select("node", "seg_id", "bin", "cuts", "tg", "th", "w.*")
    gr, hr = F.col("tg") - F.col("g"), F.col("th") - F.col("h")
    score = lambda g, h: g * g / (h + reg_lambda)
    gain = 0.5 * (score(F.col("g"), F.col("h")) + score(gr, hr) - score(F.col("tg"), F.col("th")))
    good = s.filter((F.col("bin") < F.col("cuts")) & (F.col("h") >= min_child - 1e-9) & (hr >= min_child - 1e-9)).select("node", F.round(gain, 10).alias("gain"), "left", "seg_id", "bin", "g", "h").filter("gain > 1e-9")
    best = good.groupBy("node").agg(F.max(F.struct("gain", "left", (-F.col("seg_id")).alias("s"), (-F.col("bin")).alias("b"), "g", "h")).alias("x")).collect()  # one row per node
    return {r["node"]: (r["x"]["gain"], -r["x"]["s"], -r["x"]["b"], r["x"]["left"], r["x"]["g"], r["x"]["h"]) for r in best}


_BLOCK = "ids binary, test binary, y binary, f binary, columns binary, ends binary, rows binary, n binary"


def _blocks(counts: DataFrame, samples: DataFrame, labels: list[str], base: np.ndarray) -> DataFrame:
    """A row for each block: its samples in order of their ids, and its entries by column and sample, those of ``columns[i]`` up to ``ends[i]``."""
    tasks = counts.sparkSession.sparkContext.defaultParallelism
    n = max(tasks, -(-counts.count() // BLOCK_ENTRIES))
    block = F.pmod(F.xxhash64("sample_id"), F.lit(n)).alias("block")
    left = samples.select(block, "sample_id", "is_test", *(F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)))
    right = counts.select(block, F.col("sample_id").cast("long").alias("sample_id"), F.col("seg_id").cast("long").alias("seg_id"), F.col("n").cast("double").alias("n"))

    def pack(mine: pa.Table, entries: pa.Table) -> pa.Table:
        ids = mine["sample_id"].to_numpy().astype(np.int64)
        order = np.argsort(ids)
        ids, y = ids[order], np.stack([mine[f"y{i}"].to_numpy()[order] for i in range(len(base))], axis=1)
        who, column, n = entries["sample_id"].to_numpy(), entries["seg_id"].to_numpy(), entries["n"].to_numpy()
        row = np.searchsorted(ids, who)
        known = (row < len(ids)) & (ids[np.minimum(row, len(ids) - 1)] == who) if len(ids) else np.zeros(len(who), dtype=bool)
        row, column, n = row[known], column[known], n[known]
        by = np.lexsort((row, column))
        columns, ends = np.unique(column[by], return_index=True)
        ends = np.append(ends[1:], len(by))[: len(columns)]
        parts = ids, mine["is_test"].to_numpy(zero_copy_only=False)[order].astype(bool), y, np.tile(base, (len(ids), 1)), columns.astype(np.int64), ends.astype(np.int64), row[by].astype(np.int32), n[by].astype(np.float64)
        return pa.table([pa.array([x.tobytes()], pa.binary()) for x in parts], names=[c.split()[0] for c in _BLOCK.split(", ")])

    packed = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(pack, _BLOCK)
    return cut(packed.coalesce(tasks))


class _Block:
    def __init__(self, batch: pa.RecordBatch, i: int, labels: int, value) -> None:
        of = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
        self.ids, self.test, self.columns, self.ends, self.rows, self.n = of("ids", np.int64), of("test", bool), of("columns", np.int64), of("ends", np.int64), of("rows", np.int32), of("n", value)
        self.y, self.f = of("y", np.float64).reshape(-1, labels), of("f", np.float64).reshape(-1, labels).copy()
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def entries(self, column: int) -> slice:
        i = int(np.searchsorted(self.columns, column))
        return slice(self.begins[i], self.ends[i]) if i < len(self.columns) and self.columns[i] == column else slice(0, 0)

    def placed(self, tree: list[tuple]) -> np.ndarray:
        """The node that each sample has come to; ``tree`` has ``node, column, bin, where zeros go, left, right``, parents first."""
        at = np.zeros(len(self.ids), dtype=np.int32)
        for node, column, b, zeros_left, left, right in tree:
            goes = np.full(len(self.ids), zeros_left)
            mine = self.entries(column)
            goes[self.rows[mine]] = self.n[mine] <= b
            here = at == node
            at[here] = np.where(goes[here], left, right)
        return at

    def gradients(self, label: int, binary: bool) -> tuple[np.ndarray, np.ndarray]:
        f, y = self.f[:, label], self.y[:, label]
        if not binary:
            return f - y, np.ones_like(f)
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-16)

    def losses(self, binary: bool) -> np.ndarray:
        f, y = self.f[self.test], self.y[self.test]
        p = np.clip(1 / (1 + np.exp(-f)), 1e-15, 1 - 1e-15) if binary else f
        return (-(y * np.log(p) + (1 - y) * np.log(1 - p)) if binary else (f - y) ** 2).sum(axis=0)


class _Grower:
    """The blocks with bins for values, and the trees that their predictions do not hold yet."""

    def __init__(self, blocks: DataFrame, cuts: tuple[np.ndarray, np.ndarray, np.ndarray], labels: int, binary: bool, zero_as_missing: bool) -> None:
        self.spark, self.labels, self.binary, self.zero_as_missing = blocks.sparkSession, labels, binary, zero_as_missing
        self.known, self.begins, self.thresholds = cuts  # columns, where the cuts of each begin (and the last end), all cuts
        self.trees: list[tuple[int, list[tuple], dict[int, float]]] = []
        self.sent = self.spark.sparkContext.broadcast(cuts)
        sent = self.sent

        def bins(batches):
            known, begins, thresholds = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    b = _Block(batch, i, labels, np.float64)
                    out = np.zeros(len(b.n), dtype=np.uint16)
                    for k, (column, lo, hi) in enumerate(zip(b.columns, b.begins, b.ends, strict=True)):
                        j = int(np.searchsorted(known, column))
                        if j < len(known) and known[j] == column:
                            out[lo:hi] = np.searchsorted(thresholds[begins[j] : begins[j + 1]], b.n[lo:hi], side="right")
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([out.tobytes()], pa.binary())] if batch.num_rows == 1 else [*(c.slice(i, 1) for c in batch.columns[:-1]), pa.array([out.tobytes()], pa.binary())], names=batch.schema.names)

        self.blocks = cut(blocks.mapInArrow(bins, _BLOCK))

    def _walk(self):
        """A function of a block that brings its predictions up to date."""
        trees = list(self.trees)

        def upto(b: _Block) -> _Block:
            for label, tree, leaves in trees:
                at, value = b.placed(tree), np.zeros(1 + max(leaves))
                value[list(leaves)] = list(leaves.values())
                b.f[:, label] += value[at]
            return b

        return upto

    def tree(self, nodes: list[tuple]) -> tuple[int, list[tuple], dict[int, float]]:
        """A tree of the node table in the form that blocks are walked by."""
        splits, leaves = [], {}
        for label, _, node, column, threshold, _, _, left, right, default_left, leaf in nodes:
            if column is None:
                leaves[node] = leaf
                continue
            j = int(np.searchsorted(self.known, column))
            b = int(np.searchsorted(self.thresholds[self.begins[j] : self.begins[j + 1]], threshold, side="left"))
            splits.append((node, column, b, bool(default_left) if self.zero_as_missing else 0.0 < threshold, left, right))
        return label, splits, leaves

    def add(self, nodes: list[tuple]) -> None:
        self.trees.append(self.tree(nodes))
        if len(self.trees) >= STORED * self.labels:
            self.store()

    def store(self) -> None:
        upto, labels = self._walk(), self.labels

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    f = upto(_Block(batch, i, labels, np.uint16)).f
                    yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()], pa.binary()) if c == "f" else batch.column(c).slice(i, 1) for c in batch.schema.names], names=batch.schema.names)

        self.blocks, self.trees = cut(self.blocks.mapInArrow(run, _BLOCK)), []

    def totals(self) -> tuple[list[tuple[float, float]], list[float], int]:
        """Sums of ``g, h`` over the training samples for each label, sums of the losses over the test samples, and how many these are."""
        upto, labels, binary = self._walk(), self.labels, self.binary

        def run(batches):
            out, tests = np.zeros((labels, 3)), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    b = upto(_Block(batch, i, labels, np.uint16))
                    for k in range(labels):
                        g, h = b.gradients(k, binary)
                        out[k, :2] += g[~b.test].sum(), h[~b.test].sum()
                    out[:, 2] += b.losses(binary)
                    tests += int(b.test.sum())
            yield pa.RecordBatch.from_arrays([pa.array(range(labels), pa.int32()), *(pa.array(x) for x in out.T), pa.array([tests] * labels, pa.int64())], names=["label", "g", "h", "loss", "tests"])

        rows = self.blocks.mapInArrow(run, "label int, g double, h double, loss double, tests long").collect()  # a row for each label and task
        of = lambda k, c: float(np.sum(sorted(r[c] for r in rows if r["label"] == k)))
        return [(of(k, "g"), of(k, "h")) for k in range(labels)], [of(k, "loss") for k in range(labels)], int(of(0, "tests"))

    def sums(self, label: int, tree: list[tuple], live: list[int]) -> DataFrame:
        """``node, seg_id, bin, g, h, cuts`` of what is there in the live nodes of a growing tree, by task."""
        upto, labels, binary, sent = self._walk(), self.labels, self.binary, self.sent
        schema = pa.schema([("node", pa.int32()), ("seg_id", pa.int64()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64()), ("cuts", pa.int32())])

        def run(batches):
            known, begins, _ = sent.value
            n_cuts = np.diff(begins)
            first = np.concatenate([[0], np.cumsum(n_cuts + 1)])
            cells, kept = int(first[-1]), None

            def rows(at, g, h, n):
                there = np.flatnonzero(n)
                key, g, h = at[there], g[there], h[there]
                j = np.searchsorted(first, key % cells, side="right") - 1
                return pa.RecordBatch.from_arrays([pa.array(np.array(live, dtype=np.int32)[key // cells]), pa.array(known[j]), pa.array((key % cells - first[j]).astype(np.int32)), pa.array(g), pa.array(h), pa.array(n_cuts[j].astype(np.int32))], schema=schema)

            for batch in batches:
                for i in range(batch.num_rows):
                    b = upto(_Block(batch, i, labels, np.uint16))
                    place = np.full(1 + max(live), -1)
                    place[live] = np.arange(len(live))
                    at = b.placed(tree)
                    node = np.where((at <= max(live)) & ~b.test, place[np.minimum(at, max(live))], -1)
                    g, h = b.gradients(label, binary)
                    j = np.minimum(np.searchsorted(known, b.columns), max(len(known) - 1, 0))
                    used = known[j] == b.columns if len(known) else np.zeros(len(b.columns), dtype=bool)
                    width = b.ends - b.begins
                    begin = np.repeat(np.where(used, first[j], -1), width)
                    mine = node[b.rows]
                    some = np.flatnonzero((mine >= 0) & (begin >= 0))
                    key, row = mine[some] * cells + begin[some] + b.n[some], b.rows[some]
                    if cells * len(live) <= SUMS:
                        got = [np.bincount(key, weights=w, minlength=cells * len(live)) for w in (g[row], h[row], np.ones(len(row)))]
                        kept = got if kept is None else [x + y for x, y in zip(kept, got, strict=True)]
                    elif len(key):
                        key, to = np.unique(key, return_inverse=True)
                        yield rows(key, *(np.bincount(to, weights=w, minlength=len(key)) for w in (g[row], h[row], np.ones(len(row)))))
            if kept is not None:
                yield rows(np.arange(cells * len(live)), *kept)

        return self.blocks.mapInArrow(run, "node int, seg_id long, bin int, g double, h double, cuts int")

    def predictions(self) -> DataFrame:
        upto, labels, binary = self._walk(), self.labels, self.binary

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    b = upto(_Block(batch, i, labels, np.uint16))
                    p = 1 / (1 + np.exp(-b.f)) if binary else b.f
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, labels)), pa.array(p.ravel()), pa.array(np.tile(np.arange(labels, dtype=np.int32), len(b.ids)))], names=["sample_id", "prediction", "label_idx"])

        return self.blocks.mapInArrow(run, "sample_id long, prediction double, label_idx int")


def _values(blocks: DataFrame, labels: int) -> DataFrame:
    """``seg_id, n, m``: how many training samples have a value."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i, labels, np.float64)
                some = ~b.test[b.rows]
                pairs = np.stack([np.repeat(b.columns, b.ends - b.begins)[some].astype(np.float64), b.n[some]])
                by = np.lexsort((pairs[1], pairs[0]))
                pairs = pairs[:, by]
                first = np.flatnonzero(np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])) if len(by) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0][first].astype(np.int64)), pa.array(pairs[1][first]), pa.array(np.diff(np.append(first, len(by))).astype(np.int64))], names=["seg_id", "n", "m"])

    return blocks.mapInArrow(run, "seg_id long, n double, m long").groupBy("seg_id", "n").agg(F.sum("m").alias("m"))


def fit_levels(
    counts: DataFrame, samples: DataFrame, labels: list[str], *, binary: bool, rounds: int, rate: float, depth: int = DEPTH, patience: int = PATIENCE, reg_lambda: float = 1.0, bins: int = BINS, zero_as_missing: bool = False, progress: str | None = None,
    logged: int = LOGGED,
) -> tuple[DataFrame, np.ndarray]:
    """Same arguments and result as ``fit_partitions``: rows of trees and predictions, and the base scores.

    ``progress`` names a folder for the log of this very fit; it is left there, and a finished fit is not grown again."""
    spark = samples.sparkSession
    train = samples.filter("NOT is_test")
    n_train = train.count()
    nodes: list[tuple] = []
    best, best_at, begin = np.inf, -1, 0
    settings = json.dumps([labels, binary, rate, depth, patience, reg_lambda, bins, zero_as_missing, n_train])
    if progress and (was := _last_logged(spark, progress, settings)):
        begin, best, best_at, base = was["round"] + 1, was["best"], was["best_at"], np.array(was["base"])
        nodes = [tuple(r[c] for c in NODE_COLUMNS) for r in spark.read.schema(f"i int, {NODE_SCHEMA}").parquet(f"{progress}/round={was['round']}/nodes").orderBy("i").collect()]
    else:
        base = np.array([x or 0.0 for x in train.agg(*(F.avg(F.col(c).cast("double")) for c in labels)).first()])
        if binary:
            base = np.clip(base, 1e-6, 1 - 1e-6)
            base = np.log(base / (1 - base))
    blocks = _blocks(counts, samples, labels, base)
    cuts = _bins_of(_values(blocks, len(labels)), n_train, bins, zero_as_missing)[1].toPandas().sort_values(["seg_id", "bin"])  # 255 a column at most
    known, first = np.unique(cuts["seg_id"].to_numpy(np.int64), return_index=True)
    grower = _Grower(blocks, (known, np.append(first, len(cuts)), cuts["threshold"].to_numpy(np.float64)), len(labels), binary, zero_as_missing)
    by_tree: dict[int, list[tuple]] = {}
    for n in nodes:
        by_tree.setdefault(n[1], []).append(n)
    for t in sorted(by_tree):
        grower.add(by_tree[t])
    stopped = best_at >= 0 and begin - 1 - best_at >= patience
    totals = grower.totals()[0] if rounds > begin and not stopped else []
    for r in range(begin, 0 if stopped else rounds):
        grown = [_one_tree(grower, totals[i], nodes, rate, i, r * len(labels) + i, depth, reg_lambda) for i in range(len(labels))]
        for tree in grown:
            grower.add(tree)
        totals, losses, tests = grower.totals()
        last = False
        if tests:
            loss = float(np.mean(losses) / tests) if binary else float(np.sqrt(np.mean(losses) / tests))
            if loss < best:
                best, best_at = loss, r
            else:
                last = r - best_at >= patience
        if progress and ((r + 1) % logged == 0 or last or r + 1 == rounds):
            _log_round(spark, progress, r, nodes, {"settings": settings, "round": r, "best": best, "best_at": best_at, "base": base.tolist()})
        if last:
            break
    out = spark.createDataFrame([("node", 0, None, None, *n) for n in nodes] + [("base", 0, None, float(b), i, *[None] * (len(NODE_COLUMNS) - 1)) for i, b in enumerate(base)], f"kind string, part int, sample_id long, prediction double, {NODE_SCHEMA}")
    rows = cut(grower.predictions()).select(F.lit("prediction").alias("kind"), F.lit(0).alias("part"), "sample_id", "prediction", "label_idx")
    return out.unionByName(rows, allowMissingColumns=True), base


def _log_round(spark: SparkSession, progress: str, r: int, nodes: list[tuple], about: dict) -> None:
    """Writes what a run goes on from; the note that it is whole comes last."""
    at = f"{progress}/round={r}"
    spark.createDataFrame([(i, *n) for i, n in enumerate(nodes)], f"i int, {NODE_SCHEMA}").write.mode("overwrite").parquet(f"{at}/nodes")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/whole")


def _last_logged(spark: SparkSession, progress: str, settings: str) -> dict | None:
    try:
        rows = [json.loads(r[0]) for r in spark.read.text(f"{progress}/round=*/whole").collect()]  # one row per log entry
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if any(r["settings"] != settings for r in rows):
        raise ValueError(f"{progress} is the log of a fit with other settings or samples")
    return max(rows, key=lambda r: r["round"], default=None)


def _one_tree(grower: _Grower, total: tuple[float, float], nodes: list[tuple], rate: float, label: int, tree: int, depth: int, reg_lambda: float) -> list[tuple]:
    """Grows a tree, a pass for each level, and adds it to ``nodes``; returns its own."""
    mine: list[tuple] = []
    level, made = {0: total}, 1
    for d in range(depth + 1):
        splits = {}
        if d < depth and len(grower.known):
            splits = best_splits(grower.sums(label, grower.tree(mine)[1] if mine else [], sorted(level)), level, zero_as_missing=grower.zero_as_missing, reg_lambda=reg_lambda)
        grown: dict[int, tuple[float, float]] = {}
        for k in sorted(level):
            g, h = level[k]
            if k not in splits:
                mine.append((label, tree, k, None, None, None, h, None, None, None, float(-rate * g / (h + reg_lambda))))
                continue
            gain, seg, b, left, gl, hl = splits[k]
            threshold = grower.thresholds[grower.begins[np.searchsorted(grower.known, seg)] + b]
            mine.append((label, tree, k, int(seg), float(threshold), float(gain), h, made, made + 1, bool(left), None))
            grown |= {made: (gl, hl), made + 1: (g - gl, h - hl)}
            made += 2
        level = grown
        if not level:
            break
    nodes.extend(mine)
    return mine
