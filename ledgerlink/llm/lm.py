"""Operator 10: language-model scores from a log-frequency Bloom filter.

Training documents give word counts and word-pair counts, through
``wordexchange``.  A pair seen c times has the level 1 + floor(log2 c); for each
level from 1 up to its own the pair is put into a Bloom filter, so its quantised
count q, 2 to the level less one, is read back by probing level after level until
a probe fails.  A pair seen once has level 1, an unseen one none.  The filter is
blocked: a key sets ``BITS`` bits in each of ``PROBES`` 64-bit words.  It has a
segment for each hash group of pairs, sized by that group's keys and built by the
task that counted them; the number of groups follows the corpus, so a segment has
a bounded size.

A filter of at most ``broadcast_bytes`` in all is broadcast to the workers, which
probe it bucket by bucket.  A larger one is never broadcast and never reaches the
driver: the buckets' distinct pairs are dealt to the segments instead, are probed
there, and their levels come back.  Both ways probe the same segments with the
same keys and give the same scores.

A word w after h has probability

    (max(q(h, w) - d, 0) + d * D(h) * U(w)) / (S(h) + (1 - d) * V * e)

with U(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), S(h) the sum of the quantised
counts of the words seen after h, D(h) their number, d = ``DISCOUNT`` and e the
share of unseen pairs that the filter holds by mistake, known from its fill.  So
the probabilities of all words after h sum to 1 at most, on average over the
filter's mistakes.  Where h is unknown it is U(w).  The first word follows the end
token.  score is the sum of log10 over all tokens, the end included.

Null and empty texts are a single end token.  A null id is never held out.
Repeated rows count as often as they stand there.  With no training document
N and V are 0, and every token has the unseen word's probability, 1.  An empty
table gives no rows.  A very long text is one bucket of its own.  Columns other
than the id and the text, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.llm import wordexchange as wx
from ledgerlink.staging import stage

END = b"\n"  # no word holds white space
BITS_PER_KEY = 32
PROBES, BITS = 3, 5
BROADCAST_BYTES = 32_000_000
LEVELS = 64
CHUNK = 1 << 16  # keys that are worked on at once
DISCOUNT = 0.75
KEY_BITS = 48
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: multipliers of a public 64-bit finaliser
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _STEP + word) >> np.uint64(64 - KEY_BITS)


def tokenise(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space, an end token behind."""
    return [*text.encode("utf-8", "replace").lower().split(), END]


def _probe(keys: np.ndarray, level: int, probe: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word that a probe of each key looks at, of n words, and its bits there."""
    a = mix(keys * _STEP + np.array([level * PROBES + probe], np.uint64) * _M2)
    bits = np.zeros(len(keys), np.uint64)
    for k in range(BITS):
        bits |= np.uint64(1) << ((a >> np.uint64(6 * k)) & np.uint64(63))
    return ((a >> np.uint64(32)) * n) >> np.uint64(32), bits


def quantise(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c); 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1]


def segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Bloom filter of one group's distinct pairs."""
    levels = quantise(counts)
    total = int(levels.sum())
    if not total:
        return b""
    words = np.zeros(-(-total * BITS_PER_KEY // 64), np.uint64)
    n = np.array([len(words)], np.uint64)
    for level in range(1, int(levels.max()) + 1):
        own = keys[levels >= level]
        for begin in range(0, len(own), CHUNK):
            for probe in range(PROBES):
                at, bits = _probe(own[begin : begin + CHUNK], level, probe, n)
                np.bitwise_or.at(words, at.astype(np.int64), bits)
    return words.tobytes()


def mistakes(bloom: bytes) -> float:
    """The share of keys not put in that a segment holds all the same."""
    words = np.frombuffer(bloom, np.uint64)
    return float(((np.bitwise_count(words) / 64.0) ** BITS).mean() ** PROBES) if len(words) else 0.0


class Filter:
    """Segments by group, one behind the other."""

    def __init__(self, segments: dict[int, bytes], parts: int):
        self.parts = parts
        self.words, self.start = np.zeros(parts, np.uint64), np.zeros(parts, np.int64)
        at = 0
        for p in sorted(segments):
            self.start[p], self.words[p] = at, len(segments[p]) // 8
            at += len(segments[p]) // 8
        self.data = np.frombuffer(b"".join(segments[p] for p in sorted(segments)), np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each pair; 0 for unseen ones."""
        out = np.zeros(len(keys), np.uint8)
        for a in range(0, len(keys), CHUNK):
            self._levels(keys[a : a + CHUNK], out[a : a + CHUNK])
        return out

    def _levels(self, keys: np.ndarray, out: np.ndarray) -> None:
        part = (keys % np.uint64(self.parts)).astype(np.int64)
        live = np.flatnonzero(self.words[part] > 0)
        for level in range(1, LEVELS + 1):
            for probe in range(PROBES):
                at, bits = _probe(keys[live], level, probe, self.words[part[live]])
                live = live[(self.data[self.start[part[live]] + at.astype(np.int64)] & bits) == bits]
            if not len(live):
                return
            out[live] = level


class _Pairs:
    """A bucket's distinct pairs h, w (numbers of words), of training documents or of all, in the order in which they are dealt."""

    def __init__(self, row: dict, parts: int, training: bool):
        self.words = wx.unpack_words(row["word_lens"], row["word_bytes"])
        self.hashes = wx.word_hashes(self.words)
        self.places, self.sizes = wx.expand(row["places"], np.uint32).astype(np.int64), np.array(row["sizes"], np.int64)
        before = np.empty_like(self.places)
        before[1:] = self.places[:-1]
        if len(before):
            before[np.cumsum(self.sizes) - self.sizes] = self.words.index(END)
        codes = before * len(self.words) + self.places
        self.use = np.repeat(~np.array(row["flags"], bool), self.sizes)
        if training:
            codes, self.counts = np.unique(codes[self.use], return_counts=True)
        else:
            codes, self.at = np.unique(codes, return_inverse=True)
        h, w = np.divmod(codes, max(1, len(self.words)))
        keys = pair_key(self.hashes[h], self.hashes[w])
        part = (keys % np.uint64(parts)).astype(np.int32)
        self.order = np.lexsort((keys, part))
        self.h, self.w, self.keys, self.part = h[self.order], w[self.order], keys[self.order], part[self.order]

    def packed(self, a: int, b: int) -> bytes:
        return wx.squeeze(np.diff(self.keys[a:b], prepend=np.uint64(0)), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(wx.expand(blob, np.uint64), dtype=np.uint64)


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ASK = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _asked(parts: int, training: bool):
    """For each bucket and group: keys of its pairs, and counts in training documents if asked for."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pairs = _Pairs(row, parts, training)
                cuts = wx.cut(pairs.part)
                counts = pairs.counts[pairs.order].astype(np.uint32) if training else None
                yield _rows([[p for p, _, _ in cuts], [row["bucket"]] * len(cuts), [pairs.packed(a, b) for _, a, b in cuts], [wx.squeeze(counts[a:b], 1) if training else None for _, a, b in cuts]], _ASK)

    return run


def _build(table: pa.Table) -> pa.Table:
    """A group's segment (bucket null), and for each bucket the levels of the pairs that are counted as its own: each pair once."""
    rows = sorted(table.select(["bucket", "keys", "counts"]).to_pylist(), key=lambda r: r["bucket"])
    blobs = [_unpacked(r["keys"]) for r in rows]
    keys, sizes = np.concatenate(blobs), [len(x) for x in blobs]
    counts = np.concatenate([wx.expand(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    first = np.flatnonzero(fresh)
    total = np.add.reduceat(counts[order], first)
    own = np.zeros(len(keys), np.uint8)
    own[order[first]] = quantise(total)
    bloom = segment(keys[order[first]], total)
    ends = np.cumsum([0, *sizes]).tolist()
    levels = [wx.squeeze(own[a:b], 1) for a, b in zip(ends, ends[1:], strict=False)]
    n = len(rows)
    return pa.table(
        {"part": pa.array(table["part"].to_pylist()[:1] * (n + 1), pa.int32()), "bucket": pa.array([None, *(r["bucket"] for r in rows)], pa.int64()), "blob": pa.array([bloom, *levels], pa.binary()),
         "size": pa.array([len(bloom)] + [0] * n, pa.int64()), "wrong": pa.array([mistakes(bloom)] + [None] * n, pa.float64())}
    )


_COUNTED = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), *((c, pa.binary()) for c in ("word_lens", "word_bytes", "counts", "sums", "kinds"))])


def _deal_words(parts: int, pair_parts: int):
    """Of a bucket and its own pairs' levels: its words by group with their counts, and what follows them: sums of quantised counts, and kinds of words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        pairs = _Pairs(row, pair_parts, True)
        n = len(pairs.words)
        got = sorted(right.select(["part", "blob"]).to_pylist(), key=lambda x: x["part"])
        levels = np.concatenate([wx.expand(x["blob"], np.uint8) for x in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        own = levels > 0
        h = pairs.h[own]
        counts = np.bincount(pairs.places[pairs.use], minlength=n)
        sums, kinds = np.bincount(h, weights=np.ldexp(1.0, levels[own] - 1), minlength=n), np.bincount(h, minlength=n)
        order, part = wx.order_of(pairs.hashes, parts)
        cuts = wx.cut(part)
        packed = [wx.pack_words([pairs.words[i] for i in order[a:b].tolist()]) for _, a, b in cuts]
        numbers = [[wx.squeeze(x[order[a:b]].astype(np.uint64), 1) for _, a, b in cuts] for x in (counts, sums, kinds)]
        return pa.Table.from_batches([_rows([[p for p, _, _ in cuts], [row["bucket"]] * len(cuts), [x[0] for x in packed], [x[1] for x in packed], *numbers], _COUNTED)])

    return run


_TOTALS = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), *((c, pa.binary()) for c in ("counts", "sums", "kinds")), ("known", pa.int64()), ("seen", pa.int64())])


def _count_words(table: pa.Table) -> pa.Table:
    """A group's words, summed over buckets: the sums for each bucket's words; known words and tokens seen, with the first row."""
    rows = table.to_pylist()
    number: dict[bytes, int] = {}
    at = []
    for r in rows:
        words = wx.unpack_words(r["word_lens"], r["word_bytes"])
        at.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    totals = [np.zeros(len(number), np.uint64) for _ in range(3)]
    for r, k in zip(rows, at, strict=True):
        for total, c in zip(totals, ("counts", "sums", "kinds"), strict=True):
            total[k] += wx.expand(r[c], np.uint64)  # a bucket's words are distinct
    known, seen = int((totals[0] > 0).sum()), int(totals[0].sum())
    rest = [0] * (len(rows) - 1)
    blobs = [[wx.squeeze(total[k], 1) for k in at] for total in totals]
    return pa.Table.from_batches([_rows([[r["part"] for r in rows], [r["bucket"] for r in rows], *blobs, [known, *rest], [seen, *rest]], _TOTALS)])


def _answer(parts: int):
    """Levels of the pairs that each bucket asks a group's segment for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.select(["part", "bucket", "keys"]).to_pylist()
        bloom = Filter({r["part"]: r["blob"] for r in left.select(["part", "blob"]).to_pylist()}, parts)
        levels = [wx.squeeze(bloom.levels(_unpacked(r["keys"])), 1) for r in rows]
        return pa.table({"part": pa.array([r["part"] for r in rows], pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int64()), "levels": pa.array(levels, pa.binary())})

    return run


def chances(level: np.ndarray, words: np.ndarray, sums: np.ndarray, kinds: np.ndarray, wrong: float) -> np.ndarray:
    """Probabilities of pairs: their levels, their words' plain probabilities, and sum and number of what follows their first words."""
    q = np.where(level > 0, np.ldexp(1.0, level.astype(np.int64) - 1), 0.0)
    with_first = (np.maximum(q - DISCOUNT, 0) + DISCOUNT * kinds * words) / np.maximum(sums + (1 - DISCOUNT) * wrong, 1e-300)
    return np.where(sums > 0, with_first, words)


def score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, bucket_chars: int = wx.BUCKET_CHARS
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    buckets = wx.make_buckets(docs, id_col, text_col, tokenise, held_out, bucket_chars)
    parts, pair_parts = wx.parts_of(buckets, "n_words", parts), wx.parts_of(buckets, "n_tokens", parts)
    need = buckets.select("bucket", "flags", "sizes", "word_lens", "word_bytes", "places")
    ask = "part int, bucket long, keys binary, counts binary"

    # pair counts, and from them the filter's segments
    built = need.mapInArrow(_asked(pair_parts, True), ask).groupBy("part").applyInArrow(_build, "part int, bucket long, blob binary, size long, wrong double")
    built = stage(built, "segments")
    segments, own = built.filter("bucket IS NULL").select("part", "blob"), built.filter("bucket IS NOT NULL").select("part", "bucket", "blob")
    size, wrong = built.filter("bucket IS NULL").agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.avg("wrong"), F.lit(0.0))).first()

    # word counts, with what follows each word
    dealt = need.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(_deal_words(parts, pair_parts), "part int, bucket long, word_lens binary, word_bytes binary, counts binary, sums binary, kinds binary")
    totals = stage(dealt.groupBy("part").applyInArrow(_count_words, "part int, bucket long, counts binary, sums binary, kinds binary, known long, seen long"), "counts")
    n_train, n_known = totals.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    answers = totals.select("part", "bucket", "counts", "sums", "kinds", F.lit(None).cast("binary").alias("levels"))

    cast = None
    if size <= broadcast_bytes:
        cast = spark.sparkContext.broadcast(Filter({r.part: bytes(r.blob) for r in segments.collect()}, pair_parts))  # at most broadcast_bytes
    else:
        probed = segments.groupBy("part").cogroup(need.mapInArrow(_asked(pair_parts, False), ask).groupBy("part")).applyInArrow(_answer(pair_parts), "part int, bucket long, levels binary")
        answers = answers.unionByName(stage(probed, "levels"), allowMissingColumns=True)

    id_type = buckets.schema["ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField(id_col, id_type), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )
    arrow = to_arrow_schema(schema)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        pairs = _Pairs(row, pair_parts, False)
        got = sorted(right.to_pylist(), key=lambda x: x["part"])
        of_words, of_pairs = [x for x in got if x["counts"] is not None], [x for x in got if x["levels"] is not None]
        order, _ = wx.order_of(pairs.hashes, parts)

        def told(name: str) -> np.ndarray:
            out = np.empty(len(pairs.words), np.float64)
            out[order] = np.concatenate([wx.expand(x[name], np.uint64) for x in of_words])
            return out

        counts, sums, kinds = told("counts"), told("sums"), told("kinds")
        level = cast.value.levels(pairs.keys) if cast else np.concatenate([wx.expand(x["levels"], np.uint8) for x in of_pairs])
        plain = (counts + 0.5) / (n_train + 0.5 * (n_known + 1))
        logs = np.empty(len(level))
        logs[pairs.order] = np.log10(chances(level, plain[pairs.w], sums[pairs.h], kinds[pairs.h], n_known * wrong))
        n = len(pairs.sizes)
        doc = np.repeat(np.arange(n), pairs.sizes)
        total = lambda x: np.bincount(doc, weights=x, minlength=n)
        known = np.rint(total((counts[pairs.places] > 0).astype(float))).astype(np.int64)
        columns = [row["ids"], row["flags"], pairs.sizes, known, [n_train] * n, total(np.log10(plain)[pairs.places]), total(logs[pairs.at])]
        return pa.Table.from_batches([_rows(columns, arrow)])

    return buckets.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(scored, schema)
