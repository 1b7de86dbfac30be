"""Token counts that follow edits.

A document is cut into pre-tokens by the vocabulary's own pattern; a pre-token's tokens do not depend on what stands
around it. Counts lie in a segment tree: leaves are short runs of pre-tokens, inner nodes hold the
characters and tokens below them. An edit finds its leaves by descent, re-encodes the pre-tokens it touches plus two
before them as boundary context, goes on until a new boundary falls on an old one, and updates the sums on the paths
upwards. Everything else keeps its counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandloom.llm.common import slices
from strandloom.llm.packing import SPACE, Encoder, public_encoder

#: Pre-tokens in a leaf when a tree is built.
LEAF = 32
#: Counts remembered per task before the memory is emptied.
REMEMBERED = 400_000


def pretoken_pattern() -> regex.Pattern:
    import public_tokenizers as P

    # the class stands in brackets in one place of the pattern and alone in the others
    return regex.compile(P.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.known = encoder, {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoder(piece))
        return n


class TokenTree:
    """Token count of a text under edits; ``total`` is the count, ``encoded`` the pre-tokens encoded by edits so far.

    Leaves hold their own part of the text, so an edit costs what it touches, however long the text is. ``saved`` keeps the
    counts as bytes, and a tree made with them starts without encoding anything."""

    def __init__(self, text: str, count: Callable[[str], int], pattern: regex.Pattern, leaf: int = LEAF, saved: bytes | None = None) -> None:
        self.count, self.pattern, self.leaf, self.encoded = count, pattern, leaf, 0
        if saved is None:
            self._build([(len(p), count(p)) for p in pattern.findall(text)], text)
        else:
            pairs = np.frombuffer(saved, "<u4").reshape(-1, 2).tolist()
            if sum(n for n, _ in pairs) != len(text):
                raise ValueError("the saved counts are of another text")
            self._build([(a, b) for a, b in pairs], text)

    @property
    def saved(self) -> bytes:
        return np.array([t for x in self.leaves for t in x], dtype="<u4").tobytes()

    @property
    def text(self) -> str:
        return "".join(self.parts)

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    def _build(self, tokens: list[tuple[int, int]], text: str) -> None:
        self.leaves = [tokens[i : i + self.leaf] for i in range(0, len(tokens), self.leaf)] or [[]]
        n = 1 << (len(self.leaves) - 1).bit_length()
        self.base = n
        self.sums = [(0, 0, 0)] * (2 * n)  # characters, tokens, pre-tokens
        self.parts, at = [], 0
        for i, x in enumerate(self.leaves):
            self.sums[n + i] = self._sum(x)
            self.parts.append(text[at : at + self.sums[n + i][0]])
            at += self.sums[n + i][0]
        for i in range(n - 1, 0, -1):
            self._pull(i)

    @staticmethod
    def _sum(leaf: list[tuple[int, int]]) -> tuple[int, int, int]:
        return sum(a for a, _ in leaf), sum(b for _, b in leaf), len(leaf)

    def _pull(self, i: int) -> None:
        (a, b, c), (d, e, f) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + d, b + e, c + f)

    @property
    def total(self) -> int:
        return self.sums[1][1]

    @property
    def pretokens(self) -> int:
        return self.sums[1][2]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and where it begins; the last leaf with pre-tokens for the text's end."""
        i, begin = 1, 0
        at = min(at, self.sums[1][0] - 1)
        while i < self.base:
            i *= 2
            if at - begin >= self.sums[i][0]:
                begin += self.sums[i][0]
                i += 1
        return i - self.base, begin

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces characters ``start..end`` by ``new``; returns the text's token count."""
        old_len, shift = self.chars, len(new) - (end - start)
        if not 0 <= start <= end <= old_len:
            raise ValueError("edit outside the text")
        if not self.pretokens:
            self._build([(len(p), self.count(p)) for p in self.pattern.findall(new)], new)
            self.encoded += self.pretokens
            return self.total
        # the pre-token with the character before the edit, and two before it
        k, begin = self._find(max(0, start - 1))
        bounds = [(k, j, begin) for j, begin in self._begins(k, begin)]
        while k > 0 and (len(bounds) < 3 or bounds[2][2] > start - 1):
            k -= 1
            begin -= self.sums[self.base + k][0]
            bounds = [(k, j, b) for j, b in self._begins(k, begin)] + bounds
        inside = max((i for i, x in enumerate(bounds) if x[2] <= max(0, start - 1)), default=0)
        k, j, at = bounds[max(0, inside - 2)]
        # the text around the edit, by whole leaves; more are read as matching goes on
        first, high = begin, k
        local = self.parts[k]
        while first + len(local) < end:
            high += 1
            local += self.parts[high]
        local = local[: start - first] + new + local[end - first :]
        fresh: list[tuple[int, int]] = []
        last, left, here = k, j, at  # the old pre-token reached: leaf, place in it, where it began in the old text
        now = at
        while True:
            # skip old pre-tokens that begin before the place reached, or inside the edit
            while here < old_len and (here < end or here + shift < now):
                here += self.leaves[last][left][0]
                left += 1
                while left >= len(self.leaves[last]) and last + 1 < len(self.leaves):
                    last, left = last + 1, 0
            if here >= end and here + shift == now:
                break
            m = self.pattern.match(local, now - first)
            while (m is None or m.end() == len(local)) and high + 1 < len(self.parts):  # it may go on, or look ahead
                more = min(len(self.parts), high + 1 + max(1, high - k))
                local += "".join(self.parts[high + 1 : more])
                high = more - 1
                m = self.pattern.match(local, now - first)
            fresh.append((m.end() - m.start(), self.count(m[0])))
            now = first + m.end()
        self.encoded += len(fresh)
        rest = self.leaves[last][left:]
        stop = here + shift + sum(n for n, _ in rest)
        while first + len(local) < stop:
            high += 1
            local += self.parts[high]
        for i in range(k + 1, last + 1):
            self.leaves[i], self.parts[i] = [], ""
        self.leaves[k] = self.leaves[k][:j] + fresh + rest
        self.parts[k] = local[: stop - first]
        if len(self.leaves[k]) > 16 * self.leaf:  # spread an overgrown leaf; amortised over the edits that grew it
            self._build([t for x in self.leaves for t in x], self.text)
            return self.total
        dirty = {self.base + i for i in range(k, last + 1)}
        for i in dirty:
            self.sums[i] = self._sum(self.leaves[i - self.base])
        while dirty := {i // 2 for i in dirty if i > 1}:
            for i in dirty:
                self._pull(i)
        return self.total

    def _begins(self, k: int, begin: int) -> Iterable[tuple[int, int]]:
        for j, (n, _) in enumerate(self.leaves[k]):
            yield j, begin
            begin += n


#: Runs of four and more digits, the edits of the registered query.
NUMBERS = re.compile("[0-9]{4,}")


def mask_numbers(text: str) -> list[tuple[int, int, str]]:
    """Edits ``(start, end, new)`` of the text as it stands, in order: long numbers are masked."""
    return [(m.start(), m.end(), "<NUM>") for m in NUMBERS.finditer(text)]


NAMES = ("n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after", "n_chars_after")


def _edited(tree: TokenTree, edits: list[tuple[int, int, str]]) -> list[int]:
    row = [tree.pretokens, tree.total]
    for start, end, new in reversed(edits):  # from the back, so that places stay true
        tree.edit(start, end, new)
    return [*row, len(edits), tree.encoded, tree.total, tree.chars]


def token_trees(docs: DataFrame, encoder: Encoder | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, tree binary``: the counts of every document, to be stored and edited by ``edit_trees`` in later runs.

    A null text counts as empty; repeated rows and ids keep a row each; other columns are ignored; an empty table gives no rows.
    """
    encoder = encoder or public_encoder()
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("text", T.StringType()), T.StructField("tree", T.BinaryType())])

    def run(batches):
        count, pattern = Counter(encoder), pretoken_pattern()
        for whole in batches:
            for b in slices(whole, "text"):
                got = [t or "" for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.string()), pa.array([TokenTree(t, count, pattern).saved for t in got], pa.binary())], names=schema.names)

    return docs.selectExpr(f"`{id_column}` AS id", f"CAST(`{text_column}` AS STRING) AS text").mapInArrow(run, schema)


def edit_trees(trees: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]], encoder: Encoder | None = None) -> DataFrame:
    """Applies edits to stored trees: ``doc_id, text, tree`` afterwards and the columns of ``count_tokens``. Only what edits touch is encoded."""
    encoder = encoder or public_encoder()
    schema = T.StructType([trees.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("tree", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in NAMES)])

    def run(batches):
        count, pattern = Counter(encoder), pretoken_pattern()
        for whole in batches:
            for b in slices(whole, "text"):
                made, out = [], []
                for text, tree in zip(b.column("text").to_pylist(), b.column("tree").to_pylist(), strict=True):
                    made.append(TokenTree(text, count, pattern, saved=tree))
                    out.append(_edited(made[-1], edits(text)))
                columns = list(zip(*out, strict=True)) if out else [()] * len(NAMES)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.text for x in made], pa.string()), pa.array([x.saved for x in made], pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return trees.select("doc_id", "text", "tree").mapInArrow(run, schema)


def count_tokens(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = mask_numbers, encoder: Encoder | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_after, n_chars_after`` for every row.

    ``edits`` lists changes of a text, not overlapping, in order. A null text counts as empty and has no
    tokens; repeated rows and ids keep a row each; other columns are ignored; an empty table gives no rows; a text of
    any length is counted whole, and an edit of it costs what it touches. Nothing is shuffled.
    """
    encoder = encoder or public_encoder()
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), *(T.StructField(c, T.LongType()) for c in NAMES)])

    def run(batches):
        count, pattern = Counter(encoder), pretoken_pattern()
        for whole in batches:
            for b in slices(whole, "text"):
                out = [_edited(TokenTree(t or "", count, pattern), edits(t or "")) for t in b.column("text").to_pylist()]
                columns = list(zip(*out, strict=True)) if out else [()] * len(NAMES)
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return docs.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text").mapInArrow(run, schema)
