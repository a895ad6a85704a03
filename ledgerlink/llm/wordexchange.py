"""Global exchange of distinct words.

Documents are gathered into buckets of bounded size, which hold their distinct
words once and, for each document, the positions as indices into these words.
Only the distinct words of a bucket travel: they are dealt out by hash, so that
every bucket's copy of a word meets in one group, where the word is worked on
once for the whole corpus; the answers travel back and are put in place by
position.  A word that stands in a third of all places costs one entry a
bucket.  Buckets and groups are packed binary rows, so both shuffles carry a
few bytes a distinct word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.llm.batches import slices, small_batches
from ledgerlink.staging import new_path

#: Characters of text after which a bucket is closed; a longer text has its own.
BUCKET_CHARS = 4_000_000
#: Entries (distinct words or pairs of a bucket) that meet in one group on average, and groups at least.
GROUP, LEAST_GROUPS = 1_000_000, 64


def squeeze(a: np.ndarray, level: int = 3) -> bytes:
    """Byte planes of an array of integers, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def expand(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return squeeze(lens), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(lens: bytes, flat: bytes) -> list[bytes]:
    ends = np.cumsum(expand(lens, np.uint32), dtype=np.int64).tolist()
    data, out, at = zstandard.ZstdDecompressor().decompress(flat), [], 0
    for end in ends:
        out.append(data[at:end])
        at = end
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    lens = lens.astype(np.int64)
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts.astype(np.int64) - (ends - lens), lens) + np.arange(ends[-1])


def bucket_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("bucket", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("flags", T.ArrayType(T.BooleanType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("word_lens", T.BinaryType()),
            T.StructField("word_bytes", T.BinaryType()),
            T.StructField("places", T.BinaryType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )


def _bucket(batches, tokenise, bucket_chars, schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 32, count()
    ids: list = []
    flags: list = []
    sizes: list = []
    places: list = []
    chars, words = 0, defaultdict(count().__next__)

    def close():
        lens, flat = pack_words([w if isinstance(w, bytes) else w.encode() for w in words])
        stream = np.concatenate(places) if places else np.zeros(0, np.uint32)
        row = [first + next(made), ids, flags, sizes, lens, flat, squeeze(stream), len(words), len(stream)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in slices(batches):
        for i, flag, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            tokens = tokenise(text or "")
            ids.append(i)
            flags.append(flag)
            sizes.append(len(tokens))
            places.append(np.fromiter(map(words.__getitem__, tokens), np.uint32, len(tokens)))
            chars += len(text or "")
            if chars >= bucket_chars:
                yield close()
                ids, flags, sizes, places = [], [], [], []
                chars, words = 0, defaultdict(count().__next__)
    if ids:
        yield close()


def make_buckets(
    docs: DataFrame, id_col: str, text_col: str, tokenise: Callable[[str], list], flag: Column | None = None, bucket_chars: int = BUCKET_CHARS
) -> DataFrame:
    """A table in the shared folder with a row for each bucket; null texts count as empty.

    It is written as a bucketed table, so that the answers come to where the
    buckets are and the buckets themselves are never shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    flag = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    plain = docs.select(F.col(id_col).alias("id"), flag.alias("flag"), F.col(text_col).cast("string").alias("text"))
    schema = bucket_schema(plain.schema["id"].dataType)
    arrow = to_arrow_schema(schema)
    made = plain.mapInArrow(lambda batches: _bucket(batches, tokenise, bucket_chars, arrow), schema)
    spark = docs.sparkSession
    path = new_path(spark, "buckets")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    with small_batches(spark):
        made.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").option("path", path).saveAsTable(name)
    return spark.table(name)


def parts_of(buckets: DataFrame, column: str, parts: int | None = None) -> int:
    """Groups to deal a column's sum of entries to: at most about ``GROUP`` entries meet in one, however large the corpus."""
    if parts:
        return parts
    total = buckets.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]
    return max(LEAST_GROUPS, -(-total // GROUP))


def order_of(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a bucket's words are dealt, and each one's group in that order."""
    part = (hashes % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, part[order]


DEALT = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("bucket", T.LongType())]
    + [T.StructField(c, T.BinaryType()) for c in ("word_lens", "word_bytes")]
)
_DEALT_ARROW = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), ("word_lens", pa.binary()), ("word_bytes", pa.binary())])


def cut(part: np.ndarray) -> list[tuple[int, int, int]]:
    """Of group numbers in ascending order: each group with its stretch."""
    if not len(part):
        return []
    at = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return [(int(part[a]), a, b) for a, b in zip(at, [*at[1:], len(part)], strict=True)]


def deal(buckets: DataFrame, parts: int) -> DataFrame:
    """A row for each bucket and group: the words."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack_words(row["word_lens"], row["word_bytes"])
                order, part = order_of(word_hashes(words), parts)
                cuts = cut(part)
                packed = [pack_words([words[i] for i in order[a:b].tolist()]) for _, a, b in cuts]
                columns = [[k for k, _, _ in cuts], [row["bucket"]] * len(cuts), *([x[j] for x in packed] for j in range(2))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DEALT_ARROW, strict=True)], schema=_DEALT_ARROW)

    return buckets.select("bucket", "word_lens", "word_bytes").mapInArrow(run, DEALT)
