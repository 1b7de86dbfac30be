"""Language-model scores of whole texts: a smoothed unigram base and a causal self-attention model.

The texts are read once. Each task turns its texts into chunks: a list of the chunk's distinct words with hashes,
training counts and subword ids, and the texts as word numbers. Chunks are written to the shared
folder. Word counts over all training texts come from one row per chunk and word, and go back to
the chunks by a join; no word, however common, has more rows than there are chunks.

All the model gathers grows with the corpus: word counts, the classes' neighbour counts and the table of what follows what cover all
training texts, and so does fitting, which takes every window of them but ``MOST_KEPT`` or so that are kept to tell how far attention helps.
A first fit on the driver gives the weights to begin with, by ``FIT_WINDOWS`` at most; then every group of windows goes on from there
where its texts are, and the mean of their weights is the model.

A text's score mixes two ways to foretell a word, the attention model's spelling and the word's frequency, in each
of the parts ``MIXES``, all equally likely beforehand. A word without a training count is the event of an unknown word in
the second way, as it is in the base score; so no text can score below the base by more than log10 of their number.
"""

from __future__ import annotations

import logging
import math
import uuid
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.attention import CONTEXT, WINDOW, Contexts, Model, group_subwords, neighbour_places
from strandloom.llm.common import cut, ensure_checkpoint_dir, slices
from strandloom.llm.packing import Encoder, public_encoder

log = logging.getLogger("strandloom")

#: Bytes of text in a chunk, about.
CHUNK_BYTES = 8 << 20
#: Windows of the first fit at most, in an order given by their hash, and its steps.
FIT_WINDOWS = 16_384
FIT_STEPS = 1200
#: One in so many of the windows is kept from fitting, to tell what helps, while that is less than about so many in all.
KEEP_ONE_IN, MOST_KEPT = 8, 2048
#: Windows of a group that goes on fitting by itself, at most.
GROUP_WINDOWS = 16_384
#: Parts of the attention model in the mix with word frequencies.
MIXES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Id of a text's end: the vocabulary's own special id.
END = 50_256
VOCAB = 50_257


def is_held_out(doc_id: object, folds: int = 10) -> bool:
    """crc32 of the id as text, modulo ``folds``, is 0; a null id is held out."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def _squeeze(a: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _swell(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int32)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of runs of given sizes, one after another."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((starts - ends + sizes).astype(np.int32), sizes)


class Chunk:
    """Some texts as numbers of distinct words. Number 0 is a text's end, the others are in order of frequency."""

    FIELDS = ("held", "lengths", "words", "sub_len", "sub_ids")

    def __init__(self, held, lengths, words, sub_len, sub_ids) -> None:
        self.held = np.frombuffer(held, bool)
        self.lengths, self.words, self.sub_len, self.sub_ids = map(_swell, (lengths, words, sub_len, sub_ids))  # lengths in words, the end included

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Chunk:
        return cls(*(batch.column(c)[i].as_py() for c in cls.FIELDS))

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of the texts one after another, and the texts' numbers of them."""
        sizes = self.sub_len[self.words]
        begin = np.cumsum(self.sub_len, dtype=np.int32) - self.sub_len
        flat = self.sub_ids[_ragged(begin[self.words], sizes)]
        done = np.cumsum(sizes, dtype=np.int64)[np.cumsum(self.lengths) - 1]
        return flat, np.diff(done, prepend=0)


class _Speller:
    """Subwords of many words at once: words joined by spaces are cut again where a subword begins with a space."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.begins = np.zeros(VOCAB, dtype=bool)
        for token, i in encoder.vocabulary().items():
            if token.startswith("\u0120"):  # how the vocabulary spells a space
                self.begins[i] = True

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of subwords of each word, and the subwords of all."""
        lens, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        for a in range(0, len(words), 20_000):
            some = words[a : a + 20_000]
            joined = " ".join(some)
            got = self.encoder(" " + joined)
            at = np.flatnonzero(self.begins[got])
            if len(at) != len(some) or len(joined.split()) != len(some):  # other white space in a word
                each = [self.encoder(" " + w) for w in some]
                lens.append(np.array([len(x) for x in each], dtype=np.int32))
                ids += each
            else:
                lens.append(np.diff(at, append=len(got)).astype(np.int32))
                ids.append(got)
        return np.concatenate(lens), np.concatenate(ids)


def _chunks(docs: DataFrame, encoder: Encoder) -> DataFrame:
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema["id"].dataType)), *(T.StructField(c, T.BinaryType()) for c in Chunk.FIELDS),
        T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("ns", T.ArrayType(T.IntegerType())), T.StructField("train_docs", T.LongType()), T.StructField("train_windows", T.LongType()),
    ])

    def run(batches):
        at = TaskContext.get().partitionId() << 24
        spell = _Speller(encoder)
        for whole in batches:
            for b in slices(whole, "text", CHUNK_BYTES):
                ids = b.column("id").to_pylist()
                held = np.array([is_held_out(x) for x in ids])
                number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
                get = number.__getitem__
                lists = []
                for t in b.column("text").to_pylist():
                    w = (t or "").encode("utf-8", "surrogatepass").lower().split()
                    x = np.zeros(len(w) + 1, dtype=np.int32)  # the last is the end
                    x[:-1] = np.fromiter(map(get, w), np.int32, len(w))
                    lists.append(x)
                lengths = np.array([len(x) for x in lists], dtype=np.int64)
                words = np.concatenate(lists)
                n = len(number) + 1
                order = np.argsort(-np.bincount(words, minlength=n)[1:], kind="stable") + 1
                rank = np.zeros(n, dtype=np.int32)
                rank[order] = np.arange(1, n)
                words = rank[words]
                ns = np.bincount(words[np.repeat(~held, lengths)], minlength=n)[1:]
                known = list(number)
                spelled = [known[i - 1] for i in order.tolist()]
                sub_len, sub_ids = spell([w.decode("utf-8", "replace") for w in spelled])
                digest = xxhash.xxh64_intdigest
                hashes = np.array([digest(w) for w in spelled], dtype=np.uint64).view(np.int64)
                reach = np.concatenate([[0], np.cumsum(np.insert(sub_len, 0, 1)[words], dtype=np.int64)])
                sizes = np.diff(reach[np.concatenate([[0], np.cumsum(lengths)])])
                windows = int((-(-sizes // WINDOW))[~held].sum())
                packed = [held.tobytes(), *map(_squeeze, (lengths, words, np.insert(sub_len, 0, 1), np.insert(sub_ids, 0, END)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([ids], pa.list_(b.schema.field("id").type)), *(pa.array([x], pa.binary()) for x in packed), pa.array([hashes], pa.list_(pa.int64())), pa.array([ns], pa.list_(pa.int32())), pa.array([int((~held).sum())]), pa.array([windows])],
                    names=schema.names,
                )
                at += 1

    return docs.mapInArrow(run, schema)


def _places(c: Chunk, chunk: int, window: int) -> tuple[np.ndarray, ...]:
    """A chunk's subwords, where each of its training texts' windows and its text begin, where that text ends, and a hash of the place."""
    stream, sizes = c.stream()
    ends = np.cumsum(sizes)
    begins = ends - sizes
    n = np.where(c.held, 0, -(-sizes // window))
    text = np.repeat(np.arange(len(n)), n)
    start = begins[text] + _ragged(np.zeros(len(n), np.int32), n).astype(np.int64) * window
    mix = (start.astype(np.uint64) + np.uint64((chunk * 2_654_435_761 + 1) % (1 << 63))) * np.uint64(0x9E3779B97F4A7C15)
    mix ^= mix >> np.uint64(29)
    mix *= np.uint64(0xBF58476D1CE4E5B9)
    mix ^= mix >> np.uint64(32)
    return stream, start, begins[text], ends[text], (mix >> np.uint64(2)).astype(np.int64)


def _windows(stream: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Windows with the subword before each: -1 at a text's start, -2 behind its end."""
    spot = start[:, None] + np.arange(-1, window)
    w = stream[np.clip(spot, 0, max(0, len(stream) - 1))] if len(start) else np.zeros((0, window + 1), np.int32)
    w[spot >= end[:, None]] = -2
    w[start == begin, 0] = -1
    return w


def _sampled(chunks: DataFrame, share: float, window: int) -> DataFrame:
    """``windows, k``: a share of the windows of training texts, by a hash ``k`` of their place, 16 bits a subword; ``r, part`` in other rows: the counts of their subwords."""
    bound = int(share * (1 << 62))

    def run(batches):
        counts = np.zeros(VOCAB, dtype=np.int64)
        for b in batches:
            rows, keys = [], []
            for i in range(b.num_rows):
                c = Chunk.of(b, i)
                times = np.bincount(c.words[np.repeat(~c.held, c.lengths)], minlength=len(c.sub_len))
                counts += np.bincount(c.sub_ids, weights=np.repeat(times, c.sub_len), minlength=VOCAB).astype(np.int64)
                stream, *at, k = _places(c, b.column("chunk")[i].as_py(), window)
                some = np.flatnonzero(k < bound)
                rows += [x.tobytes() for x in _windows(stream, *(x[some] for x in at), window).astype("<u2")]
                keys.append(k[some])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(np.concatenate(keys)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=["windows", "k", "r", "part"])
        part = _parts(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.binary()), pa.nulls(part.num_rows, pa.int64()), *part.columns], names=["windows", "k", "r", "part"])

    return chunks.select("chunk", *Chunk.FIELDS).mapInArrow(run, f"windows binary, k long, {PARTS}")


#: Numbers in a row that tasks send their sums in.
BLOCK = 8192
PARTS = "r int, part binary"


def _parts(vector: np.ndarray) -> pa.RecordBatch:
    """A vector in compressed blocks, those of zeros left out."""
    blocks = [(r, vector[a : a + BLOCK]) for r, a in enumerate(range(0, len(vector), BLOCK))]
    blocks = [(r, x) for r, x in blocks if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in blocks], pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for _, x in blocks], pa.binary())], names=["r", "part"])


def _summed(rows: DataFrame, dtype: str) -> DataFrame:
    """``r, part``: the sums of the blocks of each ``r``, one after another as they arrive; a row at a time is held, whatever the number of tasks."""

    def add(batches):
        now, total = None, np.zeros(0)
        for b in batches:
            for r, x in zip(b.column("r").to_pylist(), b.column("part").to_pylist(), strict=True):
                x = np.frombuffer(zstandard.decompress(x), dtype).astype("<f8" if "f" in dtype else "<i8")
                if r != now and now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["r", "part"])
                now, total = r, x + total if r == now else x
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["r", "part"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "r").sortWithinPartitions("r").mapInArrow(add, PARTS)


def _gathered(sums: DataFrame, n: int, dtype: str, of: str = "<i8") -> np.ndarray:
    """A vector of ``n`` numbers, a size that does not depend on the input, on the driver; ``of`` is the kind of the sums."""
    out = np.zeros(n, dtype)
    for r in sums.toLocalIterator():
        out[r["r"] * BLOCK : (r["r"] + 1) * BLOCK] = np.frombuffer(zstandard.decompress(r["part"]), of)
    return out


def _counted(chunks: DataFrame, cells, size: int) -> DataFrame:
    """``r, part``: how often the training texts have each of ``size`` cells; ``cells(stream, sizes, held)`` gives lists of cells of a chunk's subwords."""

    def run(batches):
        table = np.zeros(size, dtype=np.int32)
        one = np.int32(1)
        for b in batches:
            for i in range(b.num_rows):
                c = Chunk.of(b, i)
                for x in cells(*c.stream(), c.held):
                    np.add.at(table, x, one)
        yield _parts(table)

    return _summed(chunks.select("chunk", *Chunk.FIELDS).mapInArrow(run, PARTS), "<i4")


def _neighbours(chunks: DataFrame, place: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``[id, before or after]``: how often the frequent ids stand beside each id in all training texts."""
    sent = chunks.sparkSession.sparkContext.broadcast(place)  # of a fixed size
    wide = CONTEXT + 1

    def cells(stream, sizes, held):
        p = sent.value
        inside = np.repeat(~held, sizes)
        inside[(np.cumsum(sizes) - sizes)[sizes > 0]] = False  # a text's first has none before it
        at = np.flatnonzero(inside)
        a, b = stream[at - 1], stream[at]
        pa_, pb = p[a], p[b]
        left, right = np.flatnonzero(pa_ < CONTEXT), np.flatnonzero(pb < CONTEXT)
        return b[left] * np.int32(2 * wide) + pa_[left], a[right] * np.int32(2 * wide) + wide + pb[right]

    x = _gathered(_counted(chunks, cells, VOCAB * 2 * wide), VOCAB * 2 * wide, "<f4").reshape(VOCAB, 2, wide)
    x[:, :, CONTEXT] = np.maximum(counts[:, None] - x.sum(axis=2), 0)  # all others, and a text's ends
    return x.reshape(VOCAB, 2 * wide)


def _followed(chunks: DataFrame, contexts: Contexts) -> np.ndarray:
    """The contexts' table: what follows what in all training texts."""
    sent = chunks.sparkSession.sparkContext.broadcast(contexts)  # of a fixed size

    def cells(stream, sizes, held):
        return (sent.value.cells(stream, np.cumsum(sizes) - sizes)[np.repeat(~held, sizes)],)

    n = contexts.shape[0] * contexts.shape[1]
    return _gathered(_counted(chunks, cells, n), n, "<f4").reshape(contexts.shape)


def _as_windows(rows) -> np.ndarray:
    w = np.frombuffer(b"".join(rows), "<u2").astype(np.int64).reshape(-1, WINDOW + 1)
    return np.where(w >= (1 << 16) - 2, w - (1 << 16), w)


def _went_on(chunks: DataFrame, kept: int, model: Model) -> tuple[np.ndarray, int]:
    """The mean of the weights that groups of all windows whose hash is not below ``kept`` lead to, each group going on from ``model`` by itself, weighted by their windows; and how many these are."""
    sent = chunks.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    size, group = len(model.vector()), GROUP_WINDOWS

    def run(batches):
        total = np.zeros(size + 1)
        for b in batches:
            for i in range(b.num_rows):
                stream, *at, k = _places(Chunk.of(b, i), b.column("chunk")[i].as_py(), WINDOW)
                used = np.flatnonzero(k >= kept)
                used = used[np.argsort(k[used], kind="stable")]
                # a chunk's windows are dealt to even groups by their hashes
                for mine in np.array_split(used, -(-len(used) // group)) if len(used) else ():
                    m = sent.value.copied()
                    m.fit(_windows(stream, *(x[mine] for x in at), WINDOW), steps=-(-len(mine) // 128), rate=0.003)
                    total += np.append(m.vector(), np.float32(1)) * float(len(mine))
        yield _parts(total)

    got = _gathered(_summed(chunks.select("chunk", *Chunk.FIELDS).mapInArrow(run, PARTS), "<f8"), size + 1, "<f8", "<f8")
    return got[:-1] / max(got[-1], 1.0), round(got[-1])


def fit_model(chunks: DataFrame, *, fit_windows: int = FIT_WINDOWS, steps: int = FIT_STEPS) -> Model:
    """The attention model for the training texts of ``chunks``. The driver holds tables of a fixed size and ``fit_windows`` windows; all else is done where the texts are.

    ``model.report`` tells the windows used and kept, and the losses on the kept ones without attention, after the first fit, and at last.
    """
    total = chunks.agg(F.sum("train_windows")).first()[0] or 0
    # windows with the lowest hashes are kept from fitting, those with the next are the first fit's
    keep = min(1 / KEEP_ONE_IN, MOST_KEPT / max(total, 1))
    bound = int(keep * (1 << 62))
    seen = cut(_sampled(chunks, min(1.0, keep + 1.25 * fit_windows / max(total, 1)), WINDOW))
    counts = _gathered(_summed(seen.filter("r IS NOT NULL").select("r", "part"), "<i8"), VOCAB, "<i8")

    def taken(rows: DataFrame) -> np.ndarray:
        return _as_windows(r["windows"] for r in rows.orderBy("k", "windows").select("windows").collect())

    windows, kept = taken(seen.filter(F.col("k") >= bound).orderBy("k", "windows").limit(fit_windows)), taken(seen.filter(F.col("k") < bound))
    contexts = Contexts(group_subwords(_neighbours(chunks, neighbour_places(counts), counts)), counts)
    model = Model(contexts, counts.astype(np.float64), _followed(chunks, contexts))
    losses = [model.loss(kept, 0.0)]
    model.fit(windows, steps=steps, kept=kept)
    losses.append(model.loss(kept))
    n = len(windows)
    if total - len(kept) > n:
        weights, n = _went_on(chunks, bound, model)
        model.load(weights)
    scale, last = model.settle(kept)
    model.report = {"windows": n, "first": len(windows), "kept": len(kept), "losses": [*losses, last], "scale": scale}
    log.info("attention model: %s", model.report)
    return model


def _mixed(model: Model, x: Chunk, base: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a chunk; ``base`` is that of each of its distinct words by frequency."""
    stream, sizes = x.stream()
    n_words = x.sub_len[x.words]
    spelled = np.add.reduceat(model.each(stream, sizes).astype(np.float64), np.cumsum(n_words) - n_words) if len(stream) else np.zeros(0)
    plain = base[x.words] * math.log(10)
    text = np.repeat(np.arange(len(x.lengths)), x.lengths)
    sums = {0.0: np.bincount(text, weights=plain, minlength=len(x.lengths)), 1.0: np.bincount(text, weights=spelled, minlength=len(x.lengths))}
    odds = np.exp(np.minimum(spelled - plain, 700.0))
    over = np.maximum(spelled - plain - 700.0, 0.0)  # beyond what an exponential holds
    sums |= {part: sums[0.0] + np.bincount(text, weights=np.log((1 - part) + part * odds) + over, minlength=len(x.lengths)) for part in MIXES if 0 < part < 1}
    ways = [sums[part] for part in MIXES]
    return (np.logaddexp.reduce(ways, axis=0) - math.log(len(MIXES))) / math.log(10)


def score(docs: DataFrame, encoder: Encoder | None = None, *, id_column: str = "doc_id", text_column: str = "text", fit_windows: int = FIT_WINDOWS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Words are runs of anything but ASCII white space with A-Z lower-cased, then one end. ``base_score`` is the add-0.1
    unigram log10 probability by the counts of the texts that are not held out; ``score`` is that of the attention
    model over the words' subwords and the end, mixed with the words' frequencies. A null text counts as empty; repeated rows and ids keep a row each
    (and count as often); extra columns are ignored; with no training texts every count is 0.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    folder = f"{ensure_checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"
    _chunks(source, encoder or public_encoder()).write.option("compression", "zstd").parquet(folder)
    chunks = spark.read.parquet(folder)
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("hashes", "ns")).alias("i", "x")).select("chunk", "i", F.col("x.hashes").alias("h"), F.col("x.ns").alias("n"))
    asked.groupBy("h").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("k")).write.option("compression", "zstd").parquet(f"{folder}-counts")
    counts = spark.read.parquet(f"{folder}-counts")
    total = counts.agg(F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    train_docs = chunks.agg(F.sum("train_docs")).first()[0] or 0
    n_train, distinct = total["n"] + train_docs, total["v"] + (train_docs > 0)
    sent = spark.sparkContext.broadcast(fit_model(chunks, fit_windows=fit_windows))  # tables of a fixed size
    below = math.log10(n_train + 0.1 * (distinct + 1))
    # a word that one chunk has only is counted there
    known = asked.select("chunk", "i", "h").join(counts.filter("k > 1").drop("k"), "h").select(F.col("chunk").alias("of"), F.col("i").cast("int").alias("i"), "c")
    schema = T.StructType([T.StructField("doc_id", source.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def finish(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in mine.itertuples(index=False):
            x = Chunk(*(getattr(r, f) for f in Chunk.FIELDS))
            c = np.bincount(x.words[np.repeat(~x.held, x.lengths)], minlength=len(x.sub_len))
            c[0] = train_docs
            c[found["i"].to_numpy() + 1] = found["c"].to_numpy()
            text = np.repeat(np.arange(len(x.lengths)), x.lengths)
            each = np.log10(c + 0.1) - below
            base = np.bincount(text, weights=each[x.words], minlength=len(x.lengths))
            n_known = np.bincount(text, weights=(c > 0)[x.words], minlength=len(x.lengths)).astype(np.int64)
            s = _mixed(sent.value, x, each)
            out.append(pd.DataFrame({"doc_id": pd.Series(list(r.doc_ids), dtype=object), "held_out": x.held, "n_tokens": x.lengths.astype(np.int64), "n_known": n_known, "train_tokens": n_train, "base_score": base, "score": s}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in schema.names})

    # a task has some chunks, however many there are in all
    n_chunks = chunks.count()
    left = chunks.select("chunk", "doc_ids", *Chunk.FIELDS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_chunks // 2))
    left, known = left.repartition(parts, "chunk"), known.repartition(parts, "of")
    return left.groupBy("chunk").cogroup(known.groupBy("of")).applyInPandas(finish, schema)
