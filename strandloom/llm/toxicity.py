"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, no accents, look-alike letters of other scripts and digit or sign
substitutions read as Latin letters, everything else as one space. The lexicon holds whole words and word
beginnings (stems) with log-odds weights learned from labelled texts, and phrases that excuse a hit inside them.
One automaton holds both. Weighted hits are divided by a slow function of the text's length and
a logistic curve maps them to 0..1.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, slices

THRESHOLD = 0.7
#: Labelled rows the lexicon is learned from at most, in an order given by a hash of the id.
FIT_ROWS = 20_000

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s", "æ": "a", "œ": "o",
}
#: Digits and signs written for letters; read so only next to a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}
#: Plain insults that count even where labels say nothing of them.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting")
#: Phrases in which such a word is harmless.
SEED_PHRASES = ("trash can", "trash bin", "take out the trash", "clown fish", "sore loser rule", "class clown award", "pond scum")

_DROPPED = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF))


class _Fold(dict):
    """str.translate table: letters to a-z or themselves, substitutes kept for later, the rest to a space."""

    def __missing__(self, code: int):
        if code in _DROPPED:
            out = ""
        else:
            ch = chr(code)
            parts = [LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c)]
            out = "".join(LOOKALIKES.get(c, c) if c.isalpha() or c in SUBSTITUTES else " " for c in parts) if parts else ""
        self[code] = out
        return out


_FOLD = _Fold()
_LETTER = str.maketrans(SUBSTITUTES)
_SIGNS = frozenset(SUBSTITUTES)


def _unmask(word: str) -> str:
    """Reads substitutes as letters where the word has letters too; trailing signs are punctuation."""
    if _SIGNS.isdisjoint(word):
        return word
    core = word.rstrip("!|$€£@")
    if not any(c.isalpha() for c in core):
        return ""
    return core.lstrip("!|€£").translate(_LETTER)


def fold(text: str | None) -> str:
    """Folded words, one space before, between and after; empty for a text without words."""
    words = [w for w in map(_unmask, (text or "").translate(_FOLD).split()) if w]
    return f" {' '.join(words)} " if words else ""


@dataclass
class Lexicon:
    """``entries``: pattern -> weight, patterns as they occur in folded text (" stem", " word "). ``excuses``: phrases."""

    entries: dict[str, float]
    excuses: list[str] = field(default_factory=list)
    slope: float = 1.5
    shift: float = -2.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.entries.items():
            a.add_word(p, (len(p), w))
        for p in self.excuses:
            a.add_word(f" {p} ", (len(p) + 2, 0.0))
        if len(a):
            a.make_automaton()
        return a

    def raw(self, automaton, text: str | None) -> tuple[float, int]:
        """Normalised weighted hits and the number of words hit."""
        folded = fold(text)
        if not folded or not len(automaton):
            return 0.0, 0
        best: dict[int, float] = {}
        shield: list[tuple[int, int]] = []
        for end, (size, w) in automaton.iter(folded):
            at = end - size + 1
            if w:
                best[at] = max(w, best.get(at, 0.0))
            else:
                shield.append((at, end))
        if shield:  # as stretches apart from each other
            shield.sort()
            begins, ends = [shield[0][0]], [shield[0][1]]
            for a, b in shield[1:]:
                if a < ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    begins.append(a)
                    ends.append(b)
            best = {at: w for at, w in best.items() if (i := bisect_right(begins, at)) == 0 or at >= ends[i - 1]}
        return sum(best.values()) / math.log2(8 + folded.count(" ")), len(best)

    def score(self, raw: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.slope * raw + self.shift))))


def _contexts(labelled: DataFrame) -> DataFrame:
    """``y, word, c``: every folded word with a hash of itself and its neighbours; within a slice of texts each once."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                for label in (0, 1):
                    seen: set[tuple[str, int]] = set()
                    for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                        if y == label:
                            w = ["", *fold(t).split(), ""]
                            seen.update((v, xxhash.xxh64_intdigest(f"{u} {v} {x}") >> 1) for u, v, x in zip(w, w[1:], w[2:], strict=False))
                    words, hashes = ([k[i] for k in seen] for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(seen), pa.int32()), pa.array(words, pa.string()), pa.array(hashes, pa.int64())], names=["y", "word", "c"])

    return labelled.select("text", "y").mapInArrow(run, "y int, word string, c long").distinct()


def learn_lexicon(labelled: DataFrame, *, longest: int = 16, least: int = 4, odds: float = 3.0) -> Lexicon:
    """``labelled(text, y)``, a bounded sample, to a lexicon and its curve.

    Words are counted by the distinct contexts they stand in, so that copies of a text count once. Candidates are whole
    words and beginnings of 3..``longest`` letters; one enters if its log-odds for toxic texts reach ``odds`` and its
    likelihood ratio would be a surprise among all candidates. Of candidates that begin with each other the one with the
    largest likelihood ratio is taken, in the longest form that covers the same contexts. Without toxic or clean rows the seed words alone stay.
    """
    seeds = {f" {w} ": 3.0 for w in SEED_WORDS}
    words = cut(_contexts(labelled).groupBy("word").agg(F.sum(F.col("y").cast("long")).alias("a"), F.sum((1 - F.col("y")).cast("long")).alias("b")))
    total = words.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not total["a"] or not total["b"]:
        return Lexicon(seeds, list(SEED_PHRASES))
    ta, tb = float(total["a"]), float(total["b"])
    n = F.length("word")
    stems = F.when(n >= 3, F.transform(F.sequence(F.lit(3), F.least(n, F.lit(longest))), lambda k: F.concat(F.lit(" "), F.substring("word", F.lit(1), k)))).otherwise(F.array().cast("array<string>"))
    forms = words.select(F.explode(F.concat(stems, F.array(F.concat(F.lit(" "), "word", F.lit(" "))))).alias("f"), "a", "b").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tested = forms.filter(F.col("a") >= least)
    odd = F.log((F.col("a") + 0.5) / ta) - F.log((F.col("b") + 0.5) / tb)
    part = lambda x, share: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / ((F.col("a") + F.col("b")) * share))).otherwise(0.0)
    ratio = 2 * (part("a", ta / (ta + tb)) + part("b", tb / (ta + tb)))
    rated = cut(tested.select("f", "a", "b", odd.alias("w"), ratio.alias("g")))
    bound = 2 * (math.log(max(1, rated.count())) + 3)
    best = rated.filter((F.col("w") >= odds) & (F.col("g") >= bound)).orderBy(F.desc("g"), "f").collect()  # of a bounded sample
    known = {r["f"]: r for r in best}
    longer: dict[str, list[str]] = {}
    for f in known:
        longer.setdefault(f[:-1], []).append(f)
    entries: dict[str, float] = {}
    taken: set[str] = set()  # all beginnings of entries
    for r in best:
        f = r["f"]
        begins = [f[:k] for k in range(4, len(f) + 1)]
        if f in taken or any(x in entries for x in begins):
            continue
        while more := [x for x in longer.get(f, ()) if known[x]["a"] >= 0.95 * r["a"]]:  # as long a form as covers the same
            f = max(more, key=lambda x: (known[x]["a"], x))
        entries[f] = known[f]["w"]
        taken.update(f[:k] for k in range(4, len(f) + 1))
    against = {r["f"] for r in rated.filter(F.col("f").isin(list(seeds)) & (F.col("w") < 1)).collect()}
    lexicon = Lexicon({**{k: v for k, v in seeds.items() if k not in against and not any(k[:j] in entries for j in range(4, len(k) + 1))}, **entries}, list(SEED_PHRASES))
    _calibrate(lexicon, labelled)
    return lexicon


def _calibrate(lexicon: Lexicon, labelled: DataFrame) -> None:
    """Logistic curve over the normalised hits, by Newton steps with a weak prior; the slope stays positive."""

    def run(batches):
        a = lexicon.automaton()
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([round(lexicon.raw(a, t)[0], 3) for t in b.column("text").to_pylist()], pa.float64()), b.column("y").cast(pa.int64())], names=["x", "y"])

    got = labelled.select("text", "y").mapInArrow(run, "x double, y long").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    x, y, n = (np.array([r[k] for r in got], dtype=float) for k in ("x", "y", "n"))
    b = np.array([-2.0, 1.5])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -40, 40)))
        grad = design.T @ (n * (y - p)) - 0.05 * (b - [-2.0, 1.5])
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    lexicon.shift, lexicon.slope = float(b[0]), float(max(b[1], 0.1))


def score(docs: DataFrame, lexicon: Lexicon, *, text_column: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, names: tuple[str, str, str] = ("score", "predicted", "n_hits")) -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs`` with ``score double``, ``predicted int`` and ``n_hits long`` under ``names``.

    Columns that have one of these names already are replaced. Null and empty texts score as texts without hits; repeated rows
    score alike, whatever their ids; an empty table gives no rows; a text of any length is matched whole in one pass. Memory holds some MB of text at a time; nothing is shuffled.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    added = [T.StructField(n, k) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), T.LongType()), strict=True)]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # what a bounded sample has

    def run(batches):
        lex = sent.value
        a = lex.automaton()
        for whole in batches:
            for b in slices(whole, "__text"):
                raw = [lex.raw(a, t) for t in b.column("__text").to_pylist()]
                scores = [lex.score(r) for r, _ in raw]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array([k for _, k in raw], pa.int64())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_column}`").cast("string").alias("__text")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows kept from learning: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> DataFrame:
    """A sample of labelled texts ``(text, y)`` outside the held-out fold, of ``rows`` labels and as many texts at most.

    Null ids and labels other than 0 and 1 are left out; an id labelled twice counts as toxic if one label says so, and one that has
    several texts gives the least of them."""
    kept = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    some = cut(kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    parts = max(2, docs.sparkSession.sparkContext.defaultParallelism)
    return cut(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y").repartition(parts))
