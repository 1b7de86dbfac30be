"""Windows counted text by text, in numpy over Arrow batches: a row for each window that a text holds, not for each place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.alphabet import Alphabet

#: Characters that are worked on at once, and what the number of a window and its row may come to.
AT_ONCE, MOST = 1 << 16, 1 << 62
#: Windows of a length whose numbers are looked up in a list at most.
LISTED = 1 << 20


def countable(alphabet: Alphabet, lengths: list[int]) -> bool:
    """Whether windows of these lengths have numbers of 62 bits."""
    return bool(lengths) and (alphabet.base + 1) ** max(lengths) <= MOST


class _Length:
    """Numbers of the windows of one length, to the base of the symbols in code-point order, so that the smaller number is the smaller string."""

    def __init__(self, symbols: list[str], pairs: dict[str, str] | None, n: int) -> None:
        self.symbols, self.base, self.n, self.size = np.array(symbols), len(symbols), n, len(symbols) ** n
        self.swap = np.array([symbols.index(pairs.get(c, c)) for c in symbols]) if pairs else None

    def of(self, digits: np.ndarray) -> np.ndarray:
        """The number of the canonical window at every place."""
        p, kind = len(digits) - self.n + 1, np.int32 if self.size < 1 << 31 else np.int64
        code = np.zeros(p, dtype=kind)
        for j in range(self.n):
            code *= self.base
            code += digits[j : j + p]
        if self.swap is None:
            return code
        back, other = np.zeros(p, dtype=kind), self.swap[digits].astype(kind)  # what is not in the alphabet is left out later
        for j in range(self.n - 1, -1, -1):
            back *= self.base
            back += other[j : j + p]
        return np.minimum(code, back)

    def digits(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([codes // self.base ** (self.n - 1 - j) % self.base for j in range(self.n)], axis=1)

    def strings(self, codes: np.ndarray) -> pa.Array:
        distinct, at = np.unique(codes, return_inverse=True)
        written = np.ascontiguousarray(self.symbols[self.digits(distinct)]).view(f"<U{self.n}").ravel()
        return pa.array(written.tolist(), pa.string()).take(pa.array(at))


def _characters(column: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts on end and where each begins; bytes do for an alphabet of ASCII, as those of other characters are none of it."""
    if plain:
        b = column.cast(pa.large_binary())
        at = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + len(b) + 1]
        return np.frombuffer(b.buffers()[2] or b"", np.uint8), at
    texts = column.to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def _tally(row: np.ndarray | int, code: np.ndarray, rows: int, size: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, code, n`` of what occurs, in their order."""
    keys = code.astype(np.int64) + np.asarray(row, dtype=np.int64) * size
    if rows * size <= 4 * places:
        n = np.bincount(keys, minlength=1)
        keys = np.flatnonzero(n)
        n = n[keys]
    else:
        keys.sort()
        first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        keys = keys[first]
    return keys // size, keys % size, n


def _pieces(start: np.ndarray, size: int, at_once: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``at_once`` characters."""
    a, last = 0, len(start) - 1
    while a < last:
        b = int(np.searchsorted(start, start[a] + at_once, side="right")) - 1
        b = min(max(b, a + 1), a + max(1, MOST // size), last)
        yield a, b
        a = b


def count_windows(nodes: DataFrame, alphabet: Alphabet, lengths: list[int], *, keep: tuple[str, ...] = ("sample_id",), number: bool = False, pool: list[tuple[int, str]] | None = None, unknown: bool = True) -> DataFrame:
    """``*keep, segment, n``: the canonical windows of every row of ``nodes(*keep, seq)`` and how often they occur in it.

    ``number`` gives their ``code`` in the alphabet's order instead; ``pool`` (pairs of id and segment) their ``seg_id``, once for each, and
    leaves out what is not in it. Windows with characters outside the alphabet (and placeholder, if ``unknown``) are left out. Rows are
    not added up: a sample of several contigs has several rows for a window. A text of any length is worked on piece by piece.
    """
    symbols = sorted(alphabet.symbols(unknown and bool(alphabet.unknown)))
    kinds = [_Length(symbols, dict(alphabet.pairs) if alphabet.pairs else None, n) for n in sorted({n for n in lengths if n > 0})]
    place = {c: i for i, c in enumerate(alphabet.symbols())}
    own = np.array([place.get(c, 0) for c in symbols], dtype=np.int64)
    points = np.array([ord(c) for c in symbols])
    plain = bool(points[-1] < 128)
    digit_of = np.full(max(int(points[-1]) + 2, 256 if plain else 0), -1, dtype=np.int16)
    digit_of[points] = np.arange(len(points))
    at_once = AT_ONCE
    sent = nodes.sparkSession.sparkContext.broadcast(pool) if pool is not None else None
    name, kind = ("code", T.LongType()) if number else ("seg_id", T.LongType()) if pool is not None else ("segment", T.StringType())
    schema = T.StructType([*(nodes.schema[c] for c in keep), T.StructField(name, kind), T.StructField("n", T.LongType())])

    def run(batches):
        wanted = {}
        if sent is not None:
            digit = {c: i for i, c in enumerate(symbols)}
            for k in kinds:
                mine = sorted((sum(digit[c] * k.base ** (k.n - 1 - j) for j, c in enumerate(s)), i) for i, s in sent.value if len(s) == k.n)
                codes, ids = np.array([c for c, _ in mine], dtype=np.int64), np.array([i for _, i in mine], dtype=np.int64)
                listed = None
                if k.size <= LISTED:
                    listed = np.zeros(k.size, dtype=bool)
                    listed[codes] = True
                wanted[k.n] = codes, ids, listed

        def windows_of(k, digits, row_of):
            """Rows and numbers of the windows that count."""
            p = len(digits) - k.n + 1
            if p <= 0:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            code, good = k.of(digits), None
            if isinstance(row_of, np.ndarray):
                good = row_of[:p] == row_of[k.n - 1 :]
            if (digits < 0).any():
                bad = np.concatenate([[0], np.cumsum(digits < 0)])
                none = bad[k.n :] == bad[: p]
                good = none if good is None else good & none
            if good is not None:
                code = code[good]
            rows = row_of[:p] if good is None and isinstance(row_of, np.ndarray) else row_of[:p][good] if isinstance(row_of, np.ndarray) else 0
            if k.n in wanted:
                codes, _, listed = wanted[k.n]
                if listed is not None:
                    some = listed[code]
                elif len(codes):
                    some = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
                else:
                    some = np.zeros(len(code), dtype=bool)
                code, rows = code[some], rows[some] if isinstance(rows, np.ndarray) else rows
            return rows, code

        def named(k, row, code, n):
            if number:
                out = np.zeros(len(code), dtype=np.int64)
                for d in k.digits(code).T:
                    out = out * alphabet.base + own[d]
                return row, pa.array(out), n
            if k.n in wanted:
                codes, ids, _ = wanted[k.n]
                lo, hi = np.searchsorted(codes, code, side="left"), np.searchsorted(codes, code, side="right")
                times = hi - lo
                at = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                return np.repeat(row, times), pa.array(ids[at]), np.repeat(n, times)
            return row, k.strings(code), n

        for b in batches:
            data, start = _characters(b.column("seq"), plain)
            for k in kinds:
                for lo, hi in _pieces(start, k.size, at_once):
                    if start[hi] - start[lo] <= at_once or hi > lo + 1:
                        digits = digit_of[np.minimum(data[start[lo] : start[hi]], len(digit_of) - 1)]
                        row_of = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(start[lo : hi + 1]))
                        rows, code = windows_of(k, digits, row_of)
                        row, code, n = _tally(rows, code, hi - lo, k.size, len(digits))
                    else:  # one long text
                        got = []
                        for at in range(int(start[lo]), int(start[hi]), at_once):
                            digits = digit_of[np.minimum(data[at : min(at + at_once + k.n - 1, start[hi])], len(digit_of) - 1)]
                            got.append(_tally(0, windows_of(k, digits, 0)[1], 1, k.size, len(digits))[1:])
                        code, at = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([n for _, n in got]), minlength=len(code)).astype(np.int64)
                        row = np.zeros(len(code), dtype=np.int64)
                    if len(code):
                        row, what, n = named(k, row, code, n)
                        at = pa.array(row + lo)
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), what, pa.array(n.astype(np.int64))], schema=_arrow(schema, b, keep, what))

    return nodes.filter(F.col("seq").isNotNull()).select(*dict.fromkeys((*keep, "seq"))).mapInArrow(run, schema)


def _arrow(schema: T.StructType, batch: pa.RecordBatch, keep: tuple[str, ...], what: pa.Array) -> pa.Schema:
    kinds = [*(batch.schema.field(c).type for c in keep), what.type, pa.int64()]
    return pa.schema([pa.field(f.name, k) for f, k in zip(schema, kinds, strict=True)])


def summed(counts: DataFrame, nodes: DataFrame, key: str = "sample_id") -> DataFrame:
    """Counts of ``count_windows`` by sample: added up where some sample has several rows in ``nodes``; else they are already, and are not shuffled."""
    if nodes.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty():
        return counts
    return counts.groupBy(*(c for c in counts.columns if c != "n")).agg(F.sum("n").alias("n"))
