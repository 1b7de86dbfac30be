"""Sequence packing by power-of-two decomposition of documents.

Every document (its token ids, then an end id) is cut into full pieces of ``max_length`` and the
binary parts of what is left, largest first: 2048, ..., 512, 64, 8, 1. Each piece is a sequence by itself, so no
sequence crosses documents and none is padded. Sequences of equal length form a bucket, and each bucket is dealt
into batches of one shape, ready to be stacked.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandloom.llm.common import slices, texts

#: Fixed values of the public byte-level vocabulary.
SPECIAL = "<|endoftext|>"
END_ID = 1
#: White space as the vocabulary's pattern means it.
SPACE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MAX_LENGTH = 2048
#: Tokens of a batch of sequences of one length.
BATCH_TOKENS = 1 << 16


@lru_cache(maxsize=2)
def _engines(json_path: str, ranks_path: str | None, pattern: str | None):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(json_path)
    if not (ranks_path and pattern):
        return full, None
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return full, tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of a text, equal to ``tokenizers`` with ``add_special_tokens=False``.

    The same vocabulary in its rank form is encoded by a faster library, whose matcher steps back through a run of white
    space; texts with a long run of any white space, or with the special string, go to ``tokenizers`` itself.
    """

    LONG_RUN = 4096
    _BLANKS = re.compile(f"[{SPACE}]{{64,}}")

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        self.args = (json_path, ranks_path, pattern)

    def _long_run(self, text: str) -> bool:
        return len(text) >= self.LONG_RUN and any(m.end() - m.start() >= self.LONG_RUN for m in self._BLANKS.finditer(text))

    def __call__(self, text: str) -> np.ndarray:
        full, fast = _engines(*self.args)
        if fast is None or SPECIAL in text or self._long_run(text):
            return np.asarray(full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(fast.encode_ordinary(text), dtype=np.uint32)

    def vocabulary(self) -> dict[str, int]:
        return _engines(*self.args)[0].get_vocab()


def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of one of the public byte-level vocabularies installed on every machine."""
    import public_tokenizers as P

    return Encoder(P.path(f"{name}.json"), P.path(f"{name}.tiktoken"), P.PATTERN)


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens; ``max_length`` is a power of two."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(max_length.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, encoder: Encoder | None = None, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, max_length: int = MAX_LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id`` (and ``ids``).

    ``bucket`` is the sequence's length, and sequences of one ``batch_id`` have it in common: at most ``BATCH_TOKENS`` tokens of a
    partition's bucket, the last batch of each possibly fewer. ``sequence_id`` and ``batch_id`` are unique in the
    result (partition number in the high bits). A null text counts as empty and gives one piece, the end
    id. Repeated rows are packed once each; a null ``doc_id`` stays null; other columns are ignored; an
    empty table gives no rows. Nothing is shuffled and memory holds some MB of text at a time.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    encode = encoder or public_encoder()
    kind = docs.schema[id_column].dataType
    fields = [T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch_id"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)

    def run(batches):
        seq = fresh = TaskContext.get().partitionId() << 33
        open_batches: dict[int, tuple[int, int]] = {}  # of each length: batch, sequences it still takes
        for whole in batches:
            for batch in slices(whole, "text"):
                names, out, kept = batch.column("id"), [[] for _ in range(8)], []
                rows = []
                for i, text in enumerate(texts(batch, "text")):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    raw, at = ids.tobytes(), 0
                    for length in piece_lengths(len(ids), max_length):
                        rows.append(i)
                        b, room = open_batches.get(length, (0, 0))
                        if not room:
                            b, room, fresh = fresh, max(1, BATCH_TOKENS // length), fresh + 1
                        open_batches[length] = b, room - 1
                        for c, v in zip(out, (at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), len(ids), seq, 0, length, b), strict=True):
                            c.append(v)
                        if with_ids:
                            kept.append(ids[at : at + length].astype(np.int64).tolist())
                        at += length
                        seq += 1
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in out), *([pa.array(kept, pa.list_(pa.int64()))] if with_ids else [])], names=schema.names)

    return docs.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text").mapInArrow(run, schema)
