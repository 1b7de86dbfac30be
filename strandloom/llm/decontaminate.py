"""Benchmark decontamination with a stored, distributed positional inverted index.

The training texts are indexed once and the index is written as Parquet: a row for each shard of some MB of text
holds the sorted hashes of its words, their counts, and their position lists (postings) one after another. The
terms and counts of all shards are the index's directory.

A benchmark is a table of windows. Joins find what each needs: the directory gives the number of postings of
every test term over all texts, so each window has its terms in order of rarity; it is routed to the shards that hold its two
rarest terms and to no other. There the list of its rarest term, shifted by the term's offset, is intersected with the
shifted lists of the others, for many windows at once. What is left are the exact starts of the phrase. A proximity
match asks instead for all terms of a window within a span of positions, anchored at the rarest term.

The benchmark is never collected. The hashes of its terms are sent to the directory while there are at most ``SENT_TERMS``;
its windows are joined, and come to a shard in lists of a bounded size.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, ensure_checkpoint_dir, join_names, slices

WINDOW = 10
#: Positions that hold all terms of a window in a proximity match of the registered query.
NEAR_SPAN = 20
#: Bytes of text in a shard, about (a single longer text is one shard).
SHARD_BYTES = 4 << 20
#: Windows sent to a shard in one list, about; a shard that more are routed to is read once for each list.
LIST_WINDOWS = 65_536
#: Starts looked at together in a shard.
AT_ONCE = 1 << 20
#: Terms of a benchmark whose hashes are sent to every task at most (8 bytes each).
SENT_TERMS = 1 << 20
#: Pairs of a window and a shard that are made in one cell, about.
CELL = 1 << 20

#: Bytes of words are digits, letters and all of non-ASCII; A-Z is lower-cased, the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64).view(np.int64)


def text_hash(text_column: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")))


class Shard:
    """Positional postings of some documents, whose positions run through.

    ``terms`` are sorted; ``keys`` are all postings as term number * ``size`` + position, in order."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> None:
        self.ends = np.cumsum(lengths, dtype=np.int64)
        self.begins = self.ends - lengths
        self.size = max(1, len(positions))
        self.terms, self.positions = terms, positions.astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), counts) * self.size + self.positions

    @staticmethod
    def postings(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``terms, counts, positions`` of documents given as words."""
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        get = number.__getitem__
        tokens = np.concatenate([np.zeros(0, np.int32), *(np.fromiter(map(get, x), np.int32, len(x)) for x in lists)])
        hashes = _hashes(list(number))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        tokens = rank[tokens]
        return hashes[order], np.bincount(tokens, minlength=len(order)), np.argsort(tokens, kind="stable")

    @staticmethod
    def squeezed(counts: np.ndarray, positions: np.ndarray) -> bytes:
        """Positions as compressed gaps within each list."""
        gaps = positions.astype(np.int64)
        gaps[1:] -= positions[:-1]
        first = (np.cumsum(counts) - counts)[counts > 0]
        gaps[first] = positions[first]
        return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())

    @classmethod
    def read(cls, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, squeezed: bytes) -> Shard:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(squeezed), np.uint8).reshape(4, -1)
        run = np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0], dtype=np.int64)
        first = np.cumsum(counts) - counts
        before = np.where(first > 0, run[np.maximum(first - 1, 0)], 0)  # the sum of all gaps of earlier lists
        return cls(lengths, terms, counts, run - np.repeat(before, counts))

    def _next(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The posting of ``term`` at ``at`` or later; the size of the shard where there is none."""
        i = np.searchsorted(self.keys, term * self.size + at)
        found = self.keys[np.minimum(i, len(self.keys) - 1)] - term * self.size
        return np.where((i < len(self.keys)) & (found < self.size) & (found >= 0), found, self.size)

    def _of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")

    def phrases(self, terms: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and starts of all exact occurrences.

        ``terms[w]`` are a window's term numbers, ``order[w]`` its offsets from the rarest term on, both padded to one width."""
        return self._each(terms, order, sizes, self._phrases)

    def near(self, terms: np.ndarray, order: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and starts of spans of ``span`` positions in one document that hold all terms of the window in any order."""
        return self._each(terms, order, sizes, lambda *x: self._near(*x, span))

    def _each(self, terms, order, sizes, solve) -> tuple[np.ndarray, np.ndarray]:
        first = terms[np.arange(len(terms)), order[:, 0]] if len(terms) else np.zeros(0, np.int64)
        n = self.bounds[first + 1] - self.bounds[first]
        part = np.cumsum(n) // AT_ONCE
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(terms)]
        for a, e in zip(cuts, cuts[1:], strict=False):
            if e > a:
                w = np.repeat(np.arange(a, e), n[a:e])
                inside = np.arange(len(w)) - np.repeat(np.cumsum(n[a:e]) - n[a:e], n[a:e])
                out.append(solve(terms, order, sizes, w, self.positions[self.bounds[first[w]] + inside]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _phrases(self, terms, order, sizes, w, at):
        start = at - order[w, 0]
        ok = start >= 0
        w, start = w[ok], start[ok]
        for r in range(1, terms.shape[1]):
            k = order[w, r]
            want = start + k
            probe = np.where(want < self.size, terms[w, k] * self.size + want, -1)
            i = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            ok = (self.keys[i] == probe) | (sizes[w] <= r)
            w, start = w[ok], start[ok]
        ok = self._of(start) == self._of(np.minimum(start + sizes[w], self.size) - 1)
        return w[ok], start[ok]

    def _near(self, terms, order, sizes, w, at, span):
        for r in range(1, terms.shape[1]):  # every other term is close to the anchor
            d = self._of(at)
            other = np.where(sizes[w] > r, terms[w, order[w, r]], terms[w, order[w, 0]])
            ok = self._next(other, np.maximum(at - span + 1, self.begins[d])) < np.minimum(at + span, self.ends[d])
            w, at = w[ok], at[ok]
        begin = (at[:, None] - np.arange(span)).ravel()
        w, d = np.repeat(w, span), np.repeat(self._of(at), span)
        ok = begin >= self.begins[d]
        w, begin, d = w[ok], begin[ok], d[ok]
        for r in range(terms.shape[1]):  # all are in one span
            other = np.where(sizes[w] > r, terms[w, order[w, r]], terms[w, order[w, 0]])
            ok = self._next(other, begin) < np.minimum(begin + span, self.ends[d])
            w, begin, d = w[ok], begin[ok], d[ok]
        return w, begin


def build_index(docs: DataFrame, folder: str | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the index of a table of texts as Parquet to ``folder`` (one in the shared folder if none is given) and reads it.

    A row a shard: ``shard, ids, hashes, lengths, terms, counts, postings``. It can be kept and searched for any benchmark with ``search``.
    Null and empty texts have no words; repeated rows and null ids are documents of their own.
    """
    folder = folder or f"{ensure_checkpoint_dir(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    source = docs.select(F.col(f"`{id_column}`").alias("id"), text_hash(text_column).alias("h"), F.col(f"`{text_column}`").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(source.schema["id"].dataType)), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("postings", T.BinaryType()),
    ])

    def whole(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches):
        at = TaskContext.get().partitionId() << 24
        for big in batches:
            for b in slices(big, "text", SHARD_BYTES):
                lists = [words_of(t) for t in b.column("text").to_pylist()]
                terms, counts, positions = Shard.postings(lists)
                lengths = pa.array([len(x) for x in lists], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([at]), whole(b.column("id")), whole(b.column("h")), whole(lengths), whole(pa.array(terms)), whole(pa.array(counts, pa.int64())), pa.array([Shard.squeezed(counts, positions)], pa.binary())], names=schema.names)
                at += 1

    source.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def windows_of(bench: DataFrame, *, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``wid, terms, item`` of every window of every test item; an item of fewer words than ``window``, but not none, is one window."""

    def run(batches):
        for big in batches:
            for b in slices(big, "text", 1 << 20):
                rows: list[tuple[int, list[int], str]] = []
                for name, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                    h = _hashes(words_of(text))
                    if not len(h):
                        continue
                    for i in range(max(1, len(h) - window + 1)):
                        rows.append((xxhash.xxh64_intdigest(h[i : i + window].tobytes()), h[i : i + window], name))
                for a in range(0, len(rows), 100_000):
                    some = rows[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array([r[0] for r in some], np.uint64).view(np.int64)), pa.array([r[1] for r in some], pa.list_(pa.int64())), pa.array([r[2] for r in some], pa.string())], names=["wid", "terms", "item"])

    source = bench.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("None")).alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "wid long, terms array<long>, item string")


def _routed(index: DataFrame, windows: DataFrame) -> DataFrame:
    """``shard, wid, terms, offsets``: each window with its offsets in order of rarity, once for every shard that holds its two rarest terms.

    A term may be in most shards, or in most windows: what is joined on terms is told apart by the number of rows of each, and the
    windows and shards that meet at a rarest term do so in cells of about ``CELL`` pairs.
    """
    placed = cut(windows.select("wid", F.posexplode("terms").alias("k", "h")))
    asked = cut(placed.groupBy("h").agg(F.count(F.lit(1)).alias("places")))
    directory = index.select("shard", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("shard", F.col("x.terms").alias("h"), F.col("x.counts").alias("c"))
    if asked.count() <= SENT_TERMS:
        directory = directory.join(F.broadcast(asked.select("h")), "h", "left_semi")
    known = cut(directory.groupBy("h").agg(F.count(F.lit(1)).alias("shards"), F.sum("c").alias("cf")).join(asked, "h"))
    held = cut(join_names(directory.select("shard", "h"), known.select("h", F.col("shards").alias("n")), "h"))
    rarity = join_names(placed, known.select("h", "cf", F.col("places").alias("n")), "h")
    ranked = rarity.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("cf", "h", "k"))).alias("x"))  # a window's terms
    ranked = ranked.join(windows, "wid").filter(F.size("x") == F.size("terms"))  # a term that no text has: no match
    other = F.filter("x", lambda t: t["h"] != F.col("x")[0]["h"])
    ranked = cut(ranked.select("wid", "terms", F.col("x.k").alias("offsets"), F.col("x")[0]["h"].alias("h"), F.coalesce(F.get(other, F.lit(0))["h"], F.col("x")[0]["h"]).alias("h2")))
    meet = ranked.groupBy("h").agg(F.count(F.lit(1)).alias("wins")).join(known.select("h", "shards"), "h")
    meet = cut(meet.withColumn("cells", F.least("shards", F.ceil(F.col("shards") * F.col("wins") / CELL))))
    here = join_names(ranked, meet.select("h", "cells", F.col("wins").alias("n")), "h").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    there = join_names(held, meet.select("h", "cells", F.col("shards").alias("n")), "h").select("shard", "h", F.pmod(F.xxhash64("shard"), "cells").alias("cell"))
    routed = here.join(there, ["h", "cell"]).join(held.withColumnRenamed("h", "h2"), ["shard", "h2"], "left_semi")
    return routed.select("shard", "wid", "terms", "offsets")


def _items(matches: DataFrame, owners: DataFrame) -> DataFrame:
    """``shard, d, items, near``: the items of each document's exact and proximity matches, sorted.

    Windows of the same items are one owner, and documents with the same owners one set; items are listed once for each set. So a passage
    of all items in all documents costs its items once, and its documents a key each.
    """
    owned = owners.groupBy("wid").agg(F.array_sort(F.collect_set("item")).alias("list"))
    owned = cut(owned.withColumn("owner", F.sha2(F.to_json("list"), 256)))
    hits = cut(matches.select("shard", "d", "wid", (F.col("start") >= 0).alias("exact")).distinct())
    named = join_names(hits, hits.groupBy("wid").agg(F.count(F.lit(1)).alias("n")).join(owned.select("wid", "owner"), "wid"), "wid")
    held = named.groupBy("shard", "d", "exact").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    held = cut(held.withColumn("set", F.sha2(F.array_join("owners", ","), 256)))
    sets = held.groupBy("set").agg(F.first("owners").alias("owners"), F.count(F.lit(1)).alias("n"))
    lists = owned.groupBy("owner").agg(F.first("list").alias("list"))
    listed = sets.select("set", "n", F.explode("owners").alias("owner")).join(lists, "owner").groupBy("set", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("list")))).alias("list"))
    whole = join_names(held.select("shard", "d", "exact", "set"), cut(listed), "set").groupBy("shard", "d")
    return whole.agg(F.first(F.when(F.col("exact"), F.col("list")), ignorenulls=True).alias("items"), F.first(F.when(~F.col("exact"), F.col("list")), ignorenulls=True).alias("near"))


def search(index: DataFrame, bench: DataFrame, *, window: int = WINDOW, near_span: int = 0, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every document of an index with what of the benchmark it holds, as ``find_overlaps`` returns it."""
    listed = cut(windows_of(bench, window=window, item_id=item_id, item_text=item_text))
    owners = listed.select("wid", "item").distinct()
    windows = listed.groupBy("wid").agg(F.first("terms").alias("terms"))
    routed = cut(_routed(index, windows))
    most = routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    lists = -(-most // LIST_WINDOWS) or 1
    sent = routed.groupBy("shard", F.pmod("wid", F.lit(lists)).alias("list")).agg(F.collect_list("wid").alias("wids"), F.flatten(F.collect_list("terms")).alias("wterms"), F.flatten(F.collect_list("offsets")).alias("woffsets"), F.collect_list(F.size("terms")).alias("wsizes"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: np.asarray(b.column(c)[i].values)  # noqa: B023, E731
                shard = Shard.read(get("lengths"), get("terms"), get("counts"), b.column("postings")[i].as_py())
                wids, sizes = get("wids"), get("wsizes").astype(np.int64)
                inside = np.arange(sizes.max()) < sizes[:, None]
                terms, order = np.zeros((2, *inside.shape), dtype=np.int64)
                terms[inside] = np.searchsorted(shard.terms, get("wterms"))
                order[inside] = get("woffsets")
                terms = np.minimum(terms, len(shard.terms) - 1)
                want = np.zeros(inside.shape, dtype=np.int64)
                want[inside] = get("wterms")
                ok = ((shard.terms[terms] == want) | ~inside).all(axis=1)  # the shard holds all terms
                wids, sizes, terms, order = wids[ok], sizes[ok], terms[ok], order[ok]
                w, start = shard.phrases(terms, order, sizes)
                d = shard._of(start)
                found = [(d, wids[w], start - shard.begins[d], sizes[w])]
                if near_span:
                    w, begin = shard.near(terms, order, sizes, near_span)
                    pairs = np.unique(np.stack([shard._of(begin), w]), axis=1)
                    found.append((pairs[0], wids[pairs[1]], np.full(pairs.shape[1], -1), sizes[pairs[1]]))
                d, wid, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
                for a in range(0, len(d), 500_000):
                    s = slice(a, a + 500_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d[s]), b.column("shard")[i].as_py())), pa.array(d[s]), pa.array(wid[s]), pa.array(start[s]), pa.array(n[s])], names=["shard", "d", "wid", "start", "n"])

    columns = ("shard", "lengths", "terms", "counts", "postings", "wids", "wterms", "woffsets", "wsizes")
    matches = cut(index.join(sent, "shard").select(*columns).mapInArrow(run, "shard long, d long, wid long, start long, n long"))
    # what a document holds is bounded by its own length
    spans = matches.filter("start >= 0").groupBy("shard", "d").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("found"))
    names = _items(matches, owners)
    texts = index.select("shard", F.posexplode(F.arrays_zip("ids", "hashes", "lengths")).alias("d", "x")).select("shard", F.col("d").cast("long").alias("d"), F.col("x.ids").alias("doc_id"), F.col("x.hashes").alias("text_hash"), F.col("x.lengths").alias("n_words"))
    none = F.array().cast("array<string>")
    whole = texts.join(_merged(spans), ["shard", "d"], "left").join(names, ["shard", "d"], "left")
    return whole.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


def _merged(spans: DataFrame) -> DataFrame:
    """``shard, d, spans, n_hit``: overlapping and touching spans as one, and the words in them."""
    schema = "shard long, d long, spans array<struct<start:bigint,end:bigint>>, n_hit long"

    def run(batches):
        for b in batches:
            out, hits = [], []
            for found in b.column("found").to_pylist():
                mine: list[dict] = []
                for x in found:
                    if mine and x["start"] <= mine[-1]["end"]:
                        mine[-1]["end"] = max(mine[-1]["end"], x["end"])
                    else:
                        mine.append(dict(x))
                out.append(mine)
                hits.append(sum(x["end"] - x["start"] for x in mine))
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("d"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(hits, pa.int64())], names=["shard", "d", "spans", "n_hit"])

    return spans.mapInArrow(run, schema)


def find_overlaps(docs: DataFrame, bench: DataFrame, *, window: int = WINDOW, near_span: int = 0, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Indexes ``docs`` and returns every document with what of the benchmark it holds.

    ``doc_id, text_hash, n_words, n_hit`` (words inside any exact occurrence of a window), ``spans`` (these as
    word positions, end exclusive), ``items array<string>`` (ids of items with exact occurrences, sorted) and ``near
    array<string>`` (items with a window whose terms all lie within ``near_span`` positions; empty when
    that is 0). An item of fewer words than ``window`` is one window; an item without words never matches. Null and empty
    texts have no words; repeated documents or items, null ids (an item's null id reads as ``None``), extra columns and
    empty tables are fine; a text of any length is one document of one shard.
    """
    index = build_index(docs, id_column=id_column, text_column=text_column)
    return search(index, bench, window=window, near_span=near_span, item_id=item_id, item_text=item_text)


def digest(found: DataFrame) -> DataFrame:
    """The counts of ``find_overlaps``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))
