"""Gradient boosted trees on counts: second-order, histogram based, in numpy (Chen and Guestrin, KDD 2016).

A booster runs inside one task on the columns of one feature partition, of which it holds the entries that are not
zero; the trees are rows of a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

#: Fixed values of the trainer: depth of trees, rounds without gain before it stops.
DEPTH = 3
PATIENCE = 20

NODE_SCHEMA = "label_idx int, tree_id int, node_id int, seg_id long, threshold double, gain double, cover double, left int, right int, default_left boolean, leaf double"
NODE_COLUMNS = [x.split()[0] for x in NODE_SCHEMA.split(", ")]


class Entries:
    """The entries of a matrix that are not zero, by column and row; its size in memory is theirs, whatever its shape."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> None:
        order = np.lexsort((rows, columns))
        self.rows, self.columns, self.values = rows[order].astype(np.int64), columns[order].astype(np.int64), values[order].astype(np.float32)
        self.shape = shape
        self.bounds = np.searchsorted(self.columns, np.arange(shape[1] + 1))

    @classmethod
    def of(cls, x: np.ndarray) -> Entries:
        rows, columns = np.nonzero(x)
        return cls(rows, columns, x[rows, columns], x.shape)

    def of_rows(self, keep: np.ndarray) -> Entries:
        """The rows that ``keep`` marks, numbered anew."""
        some = keep[self.rows]
        return Entries((np.cumsum(keep) - 1)[self.rows[some]], self.columns[some], self.values[some], (int(keep.sum()), self.shape[1]))

    def column(self, j: int) -> np.ndarray:
        out = np.zeros(self.shape[0], dtype=np.float32)
        a, b = self.bounds[j], self.bounds[j + 1]
        out[self.rows[a:b]] = self.values[a:b]
        return out


@dataclass
class Booster:
    """``fit`` grows one tree per label and round; ``trees`` is the node table with ``seg_id`` as the column number."""

    binary: bool = False
    rounds: int = 1500
    rate: float = 0.03
    depth: int = DEPTH
    patience: int = PATIENCE
    reg_lambda: float = 1.0
    min_child: float = 1.0
    bins: int = 256
    zero_as_missing: bool = False
    base: np.ndarray = field(default_factory=lambda: np.zeros(1))
    nodes: list[tuple] = field(default_factory=list)
    best_round: int = -1

    def _bin(self, e: Entries) -> None:
        """Thresholds per column, and the bin of every entry; the last bin is for missing values."""
        n, f = e.shape
        self.entries = e
        self.cuts: list[np.ndarray] = []
        self.entry_bin = np.zeros(len(e.values), dtype=np.uint16)
        for j in range(f):
            a, b = e.bounds[j], e.bounds[j + 1]
            col, zeros = e.values[a:b], 0 if self.zero_as_missing else n - (b - a)
            values = np.unique(np.append(col, np.float32(0)) if zeros else col)
            if len(values) > self.bins - 1:
                known = np.append(col, np.zeros(zeros, dtype=np.float32))
                values = np.unique(np.quantile(known, np.linspace(0, 1, self.bins - 1), method="nearest"))
            cuts = (values[:-1] + values[1:]) / 2.0 if len(values) > 1 else np.zeros(0)
            if self.zero_as_missing and len(values):
                cuts = np.append(cuts, values[-1] + 1.0)  # all that is there against what is missing
            self.cuts.append(cuts)
            self.entry_bin[a:b] = np.searchsorted(cuts, col, side="right")
        self.n_cuts = np.array([len(c) for c in self.cuts], dtype=np.int64)
        self._lay_out()
        # histograms are summed over what is not zero; the bin of zeros gets the rest of a node's total
        self.zero_bin = self.missing if self.zero_as_missing else np.array([int(np.searchsorted(c, 0.0, side="right")) for c in self.cuts], dtype=np.int64)
        self.entry_row = e.rows
        self.entry_cell = self.first_cell[e.columns] + self.entry_bin

    def _lay_out(self) -> None:
        """Places of the columns' bins in a flat histogram: columns of like width make a rectangle, in their order, so narrow ones are not as wide as the widest."""
        needed = self.n_cuts + 2  # bins, and one for what is missing
        widths = 1 << np.ceil(np.log2(np.maximum(needed, 2))).astype(np.int64)
        self.first_cell = np.zeros(len(widths), dtype=np.int64)
        self.missing = widths - 1
        self.shapes: list[tuple[int, np.ndarray, int]] = []  # where a rectangle begins, its columns, their width
        at = 0
        for w in np.unique(widths):
            columns = np.flatnonzero(widths == w)
            self.first_cell[columns] = at + np.arange(len(columns)) * w
            self.shapes.append((at, columns, int(w)))
            at += len(columns) * int(w)
        self.cells = at

    def _bins_of(self, column: int) -> np.ndarray:
        """The bins of all rows in a column."""
        a, b = self.entries.bounds[column], self.entries.bounds[column + 1]
        out = np.full(self.entries.shape[0], self.zero_bin[column], dtype=np.int64)
        out[self.entry_row[a:b]] = self.entry_bin[a:b]
        return out

    def _grad(self, f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.binary:
            return f - y, np.ones_like(f)
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-16)

    def _loss(self, f: np.ndarray, y: np.ndarray) -> float:
        if not self.binary:
            return float(np.sqrt(np.mean((f - y) ** 2)))
        p = np.clip(1 / (1 + np.exp(-f)), 1e-15, 1 - 1e-15)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    def _histograms(self, nodes: list[np.ndarray], values: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Sums of both ``values`` by cell for each node's rows: ``[2, cells]``."""
        k = len(nodes)
        if k == 1 and len(nodes[0]) == len(values[0]):
            rows, cells = self.entry_row, self.entry_cell
        else:
            place = np.full(len(values[0]), -1, dtype=np.int64)
            for i, mine in enumerate(nodes):
                place[mine] = i
            at = place[self.entry_row]
            live = np.flatnonzero(at >= 0)
            rows = self.entry_row[live]
            cells = self.entry_cell[live] + at[live] * self.cells
        out = np.empty((k, 2, self.cells))
        for i, v in enumerate(values):
            out[:, i] = np.bincount(cells, weights=v[rows], minlength=k * self.cells).reshape(k, self.cells)
            totals = np.array([v[mine].sum() for mine in nodes])
            for begin, columns, w in self.shapes:
                block = out[:, i, begin : begin + len(columns) * w].reshape(k, len(columns), w)
                block[:, np.arange(len(columns)), self.zero_bin[columns]] += totals[:, None] - block.sum(axis=2)
        return list(out)

    def _level(self, level: list[tuple[int, np.ndarray]], parents: list[np.ndarray], values: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Histograms of a level's nodes, which come in pairs: the smaller of a pair is summed, the other is what it leaves of the parent."""
        if not parents:
            return self._histograms([rows for _, rows in level], values)
        small = [i if len(level[i][1]) <= len(level[i + 1][1]) else i + 1 for i in range(0, len(level), 2)]
        out: list = [None] * len(level)
        for i, parent, h in zip(small, parents, self._histograms([level[i][1] for i in small], values), strict=True):
            out[i], out[i ^ 1] = h, parent - h
        return out

    def _split(self, hg: np.ndarray, hh: np.ndarray, tg: float, th: float):
        """The best split of a node by its histograms: ``(gain, column, bin, missing goes left)`` or None; of equal gains missing left, then the first column and bin."""
        lam = self.reg_lambda
        best = None
        for begin, columns, w in self.shapes:
            g, h = (x[begin : begin + len(columns) * w].reshape(len(columns), w) for x in (hg, hh))
            gl, hl = np.cumsum(g[:, :-1], axis=1), np.cumsum(h[:, :-1], axis=1)
            possible = np.arange(w - 1)[None, :] < self.n_cuts[columns][:, None]
            for left in (True, False) if self.zero_as_missing else (False,):
                a, b = (gl + g[:, -1:], hl + h[:, -1:]) if left else (gl, hl)
                c, d = tg - a, th - b
                # sums of what is left over carry rounding of some last digits
                ok = possible & (b >= self.min_child - 1e-9) & (d >= self.min_child - 1e-9)
                gain = np.where(ok, 0.5 * (a * a / (b + lam) + c * c / (d + lam) - tg * tg / (th + lam)), -np.inf)
                gain = np.round(gain, 10)  # equal gains stay equal
                k = int(np.argmax(gain))
                found = (float(gain.flat[k]), left, -int(columns[k // (w - 1)]), -(k % (w - 1)))
                if found[0] > 1e-9 and (best is None or found > best):
                    best = found
        return best and (best[0], -best[2], -best[3], best[1])

    def _tree(self, label: int, tree: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Grows a tree, a level at a time; returns what it adds to each training row."""
        add = np.zeros(len(g))
        level, made, parents = [(0, np.arange(len(g)))], 1, []
        for depth in range(self.depth + 1):
            hists = self._level(level, parents, (g, h)) if depth < self.depth else []
            grown, parents = [], []
            for i, (node, rows) in enumerate(level):
                tg, th = float(g[rows].sum()), float(h[rows].sum())
                s = self._split(*hists[i], tg, th) if depth < self.depth and len(rows) > 1 else None
                if s is None:
                    leaf = -self.rate * tg / (th + self.reg_lambda)
                    add[rows] = leaf
                    self.nodes.append((label, tree, node, None, None, None, th, None, None, None, leaf))
                    continue
                gain, col, b, left = s
                bins = self._bins_of(col)[rows]
                goes = np.where(bins == self.missing[col], left, bins <= b) if self.zero_as_missing else bins <= b
                self.nodes.append((label, tree, node, col, float(self.cuts[col][b]), gain, th, made, made + 1, bool(left), None))
                grown += [(made, rows[goes]), (made + 1, rows[~goes])]
                parents.append(hists[i])
                made += 2
            level = grown
            if not level:
                break
        return add

    def fit(self, x: np.ndarray | Entries, y: np.ndarray, x_test: np.ndarray | Entries | None = None, y_test: np.ndarray | None = None) -> Booster:
        x = x if isinstance(x, Entries) else Entries.of(x)
        y = y.reshape(len(y), -1).astype(np.float64)
        labels = y.shape[1]
        mean = y.mean(axis=0) if len(y) else np.zeros(labels)
        self.base = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6))) if self.binary else mean
        self._bin(x)
        f = np.tile(self.base, (len(y), 1))
        watch = x_test is not None and x_test.shape[0] > 0
        ft = np.tile(self.base, (x_test.shape[0], 1)) if watch else None
        yt = y_test.reshape(len(y_test), -1).astype(np.float64) if watch else None
        best, best_at = np.inf, -1
        for r in range(self.rounds if x.shape[1] and len(y) else 0):
            g, h = self._grad(f, y)
            begin = len(self.nodes)
            for label in range(labels):
                f[:, label] += self._tree(label, r * labels + label, g[:, label], h[:, label])
            if watch:
                ft += self.raw(x_test, self.nodes[begin:], labels)
                loss = self._loss(ft, yt)
                if loss < best:
                    best, best_at = loss, r
                elif r - best_at >= self.patience:
                    break
        self.best_round = best_at
        del self.entries, self.entry_bin, self.entry_row, self.entry_cell
        return self

    def raw(self, x: np.ndarray | Entries, nodes: list[tuple], labels: int) -> np.ndarray:
        return walk(x, nodes, labels, self.zero_as_missing)

    def predict(self, x: np.ndarray | Entries) -> np.ndarray:
        return predict(x, self.nodes, self.base, self.binary, self.zero_as_missing)

    def table(self) -> pd.DataFrame:
        return pd.DataFrame(self.nodes, columns=NODE_COLUMNS)


def walk(x: np.ndarray | Entries, nodes: list[tuple], labels: int, zero_as_missing: bool = False) -> np.ndarray:
    """Sums of leaves per row and label over the trees of a node table."""
    column = x.column if isinstance(x, Entries) else lambda c: x[:, c]
    out = np.zeros((x.shape[0], labels))
    trees: dict[int, dict[int, tuple]] = {}
    for n in nodes:
        trees.setdefault(n[1], {})[n[2]] = n
    for t in trees.values():
        todo = [(0, np.arange(x.shape[0]))]
        while todo:
            k, rows = todo.pop()
            label, _, _, col, threshold, _, _, left, right, default_left, leaf = t[k]
            if col is None:
                out[rows, label] += leaf
                continue
            v = column(col)[rows]
            goes = v < threshold
            if zero_as_missing:
                goes = np.where(v == 0, default_left, goes)
            todo += [(left, rows[goes]), (right, rows[~goes])]
    return out


def predict(x: np.ndarray | Entries, nodes: list[tuple], base: np.ndarray, binary: bool, zero_as_missing: bool = False) -> np.ndarray:
    f = base + walk(x, nodes, len(base), zero_as_missing)
    return 1 / (1 + np.exp(-f)) if binary else f
