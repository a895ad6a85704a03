"""Operator 3: byte-level BPE encoding and decoding by a global distinct-word shuffle.

Every text is split by the vocabulary's pattern.  The pre-tokens go through
``wordexchange``: each distinct pre-token of the corpus is merged once, its ids
are joined back to all buckets that hold it, and the documents are reassembled
by position.  Decoding joins the ids with the table of token bytes.

Null texts count as empty: no ids, no bytes.  Rows that repeat, null ids and
further columns do no harm; the result has one row for each input row, none for
an empty table.  A very long text is one bucket of its own.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.llm import wordexchange as wx
from ledgerlink.llm.batches import slices

VOCABULARY = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits text before the merges."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@lru_cache(2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


class _Merger(dict):
    """Ids of a pre-token, merged at its first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, word: bytes) -> np.ndarray:
        ids = self[word] = np.array(self.core.encode_single_piece(word), np.uint32)
        return ids


_MERGERS: dict = {}


def _merger(ranks, pattern: str) -> _Merger:
    """One for each worker process; emptied between groups, as words don't recur there."""
    if pattern not in _MERGERS or _MERGERS[pattern][1] != ranks.id:
        _MERGERS[pattern] = (_Merger(ranks.value, pattern), ranks.id)
    return _MERGERS[pattern][0]


class _Shared:
    """A broadcast with an identity that survives pickling."""

    def __init__(self, spark, value):
        self.cast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.cast.value


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, bucket_chars: int = wx.BUCKET_CHARS) -> DataFrame:
    """``id_col``, n_tokens and ids_le32, the ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    path, usual = (vocabulary, pattern) if vocabulary and pattern else default_vocabulary()
    path, pattern = vocabulary or path, pattern or usual
    ranks = _Shared(spark, read_ranks(path))  # the vocabulary's size is fixed
    buckets = wx.make_buckets(docs, id_col, text_col, lambda text: _splitter(pattern)(text), bucket_chars=bucket_chars)
    parts = wx.parts_of(buckets, "n_words", parts)

    def merge(table: pa.Table) -> pa.Table:
        merger = _merger(ranks, pattern)
        merger.clear()
        out = []
        for row in table.to_pylist():
            ids = list(map(merger.__getitem__, wx.unpack_words(row["word_lens"], row["word_bytes"])))
            lens = np.fromiter(map(len, ids), np.uint32, len(ids))
            out.append((row["part"], row["bucket"], wx.squeeze(lens), wx.squeeze(np.concatenate(ids) if ids else np.zeros(0, np.uint32))))
        merger.clear()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "bucket", "lens", "ids"])

    merged = wx.deal(buckets, parts).groupBy("part").applyInArrow(merge, "part int, bucket long, lens binary, ids binary")
    id_type = buckets.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_le32", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        words = wx.unpack_words(row["word_lens"], row["word_bytes"])
        order, _ = wx.order_of(wx.word_hashes(words), parts)
        answers = sorted(right.to_pylist(), key=lambda x: x["part"])
        lens = np.concatenate([wx.expand(x["lens"], np.uint32) for x in answers]) if answers else np.zeros(0, np.uint32)
        flat = np.concatenate([wx.expand(x["ids"], np.uint32) for x in answers]) if answers else np.zeros(0, np.uint32)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lens, dtype=np.int64) - lens
        length = np.zeros(len(words), np.int64)
        length[order] = lens
        places, sizes = wx.expand(row["places"], np.uint32), row["sizes"]
        blobs, counts, at = [], [], 0
        for size in sizes:
            own = places[at : at + size]
            at += size
            ids = flat[wx.ragged(starts[own], length[own])]
            counts.append(len(ids))
            blobs.append(ids.astype("<u4").tobytes())
        return pa.table([pa.array(row["ids"], arrow[0].type), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], schema=arrow)

    return buckets.groupBy("bucket").cogroup(merged.groupBy("bucket")).applyInArrow(reassemble, schema)


def decode(encoded: DataFrame, vocabulary: str | None = None, ids_col: str = "ids_le32", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; null ids give null.

    An id that the vocabulary lacks ends the job with an error.
    """
    ranks = read_ranks(vocabulary or default_vocabulary()[0])
    table = encoded.sparkSession.sparkContext.broadcast({i: token for token, i in ranks.items()})
    schema = T.StructType([f for f in encoded.schema if f.name != out_col] + [T.StructField(out_col, T.BinaryType())])

    def run(batches):
        of = table.value.__getitem__
        for batch in slices(batches):
            blobs = batch.column(ids_col).to_pylist()
            done = [None if b is None else b"".join(map(of, np.frombuffer(b, "<u4").tolist())) for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) if f.name != out_col else pa.array(done, pa.binary()) for f in schema], names=schema.names)

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes decoded from them."""
    done = decode(encode(docs, vocabulary, **options), vocabulary)
    first = done.columns[0]
    return done.select(first, "n_tokens", F.sha2("ids_le32", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
