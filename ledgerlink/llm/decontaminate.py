"""Operator 7: benchmark decontamination by BM25 with block-max WAND.

The terms are pairs of neighbouring words, as single words of one language are
too common to tell passages apart.  Test items, in pieces of at most ``PIECE``
words, make an inverted index whose posting weights are BM25 contributions divided by the piece's score for itself,
so that one threshold serves pieces of any length.  Every training text is cut
into overlapping passages; each is a query that retrieves all pieces at or over
the threshold.  WAND's first test is done for all passages of a text together: a
passage is skipped if the greatest weights of its terms don't make the
threshold in sum.  The others walk the postings with block maxima.  A hit counts as a
leak if the text around it holds enough of the item's question and of its
answer, the item's last third, as word n-grams.  A part of fewer than ``GRAM``
words must stand there word for word; one of fewer than twice as many has so few
n-grams that its words in order count too.

The index is broadcast in shards of at most ``INDEX_BYTES`` of item text each;
a larger benchmark takes several passes over the texts, never a larger
broadcast (an item that is larger by itself is a shard of its own).  Document
frequencies, the number of pieces and their mean length are counted over the
whole benchmark, so a score does not depend on how items are dealt to shards.

Null and empty texts, and items of fewer than two words, match nothing.  Items with the same words are
all reported.  Repeated rows are reported each.  An empty table of either kind
gives no rows.  Long texts are read whole, passage by passage.  Other columns of
either table, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.llm.batches import slices
from ledgerlink.staging import stage

PIECE, PASSAGE, STRIDE = 48, 64, 32
THRESHOLD = 0.4
GRAM = 5
QUESTION_SHARE = ANSWER_SHARE = 0.5
K1, B = 1.2, 0.75
BLOCK = 16
INDEX_BYTES = 8_000_000
MEMORY = 400_000
_EDGES = string.punctuation + "«»“”„’‘…¿¡–—"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    """Word n-grams; of fewer words, the one gram they make."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def in_order(part: list[str], around: list[str]) -> float:
    """The greatest share of a part's words that stand in order within a stretch of two words more than it has."""
    masks: dict[str, int] = {}
    for k, w in enumerate(part):
        masks[w] = masks.get(w, 0) | 1 << k
    hits = [masks.get(w, 0) for w in around]
    full, best = (1 << len(part)) - 1, 0
    for i, hit in enumerate(hits):
        if hit:
            v = full  # a zero for each word of the longest common subsequence
            for m in hits[i : i + len(part) + 2]:
                v = ((v + (v & m)) | (v & ~m)) & full
            best = max(best, len(part) - v.bit_count())
    return best / len(part)


def share(part: list[str], around: list[str], around_grams: set[tuple[str, ...]]) -> float:
    """How much of a part ``around`` holds, as n-grams of GRAM words, or of all a shorter part's words; a part with few grams also as words in order."""
    n = min(GRAM, len(part))
    own = grams(part, n)
    found = len(own & (around_grams if n == GRAM else grams(around, n))) / len(own)
    return max(found, in_order(part, around)) if GRAM <= len(part) < 2 * GRAM and found < 1 else found


def pieces_of(words: list[str]) -> list[list[str]]:
    """Stretches of at most ``PIECE`` words that hold every word; a last one of less than half of that is a whole one that overlaps."""
    begins = list(range(0, len(words), PIECE))
    if len(begins) > 1 and len(words) - begins[-1] < PIECE // 2:
        begins[-1] = len(words) - PIECE
    return [words[a : a + PIECE] for a in begins]


def pairs_of(words: list[str]) -> list[str]:
    """The terms: neighbouring words, joined by the blank that no word holds."""
    return [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)]


class Statistics:
    """What BM25 needs of the whole benchmark: pieces that hold a term, the number of pieces and their terms on average."""

    def __init__(self, df: dict[str, int], pieces: int, mean: float):
        self.df, self.pieces, self.mean = df, pieces, mean

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        terms = [pairs_of(p) for t in texts for p in pieces_of(words_of(t))]
        return cls(Counter(t for x in terms for t in set(x)), len(terms), sum(map(len, terms)) / max(1, len(terms)))


class Index:
    """Postings of some items, weighted by the statistics of all: arrays behind each other, a stretch for each term."""

    def __init__(self, items: list[tuple[object, str]], statistics: Statistics | None = None):
        known = statistics or Statistics.of([t or "" for _, t in items])
        self.items = [(i, words_of(t or "")) for i, t in items]
        self.number = {t: k for k, t in enumerate(dict.fromkeys(t for _, w in self.items for t in w))}  # of words
        self.base = len(self.number) + 1
        self.owner: list[int] = []
        code, piece, weight = [], [], []
        for n, (_, words) in enumerate(self.items):
            for part in pieces_of(words):
                counts = Counter(pairs_of(part))
                norm = K1 * (1 - B + B * (len(part) - 1) / known.mean) if known.mean else K1
                own = [math.log(1 + (known.pieces - known.df[t] + 0.5) / (known.df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in counts.items()]
                code.append(np.array([self.number[x] * self.base + self.number[y] for x, y in (t.split(" ") for t in counts)], np.int64))
                piece.append(np.full(len(counts), len(self.owner), np.int32))
                weight.append(np.array(own) / sum(own) if own else np.zeros(0))
                self.owner.append(n)
        flat = np.concatenate(code) if code else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.pieces = np.concatenate(piece)[order] if code else np.zeros(0, np.int32)
        self.weights = np.concatenate(weight)[order] if code else np.zeros(0)
        self.codes, starts = np.unique(flat[order], return_index=True)  # of terms
        self.starts = np.append(starts, len(flat))
        self.most = np.zeros(len(self.codes) + 1)  # the last entry is for terms that no item holds
        if len(self.codes):
            self.most[:-1] = np.maximum.reduceat(self.weights, starts)
        self.lists: dict[int, tuple[list[int], list[float], list[float]]] = {}
        self.parts = []
        for _, w in self.items:
            cut = len(w) - max(3, len(w) // 3)
            self.parts.append((w[: max(cut, 0)] or w, w[max(cut, 0) :]))

    def postings(self, term: int) -> tuple[list[int], list[float], list[float]]:
        """A term's pieces, weights and greatest weights of blocks; lists of the terms met so far are kept."""
        if term not in self.lists:
            if len(self.lists) > MEMORY:
                self.lists.clear()
            a, b = self.starts[term], self.starts[term + 1]
            own = self.weights[a:b].tolist()
            self.lists[term] = self.pieces[a:b].tolist(), own, [max(own[i : i + BLOCK]) for i in range(0, len(own), BLOCK)]
        return self.lists[term]

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of neighbouring words' numbers; the number of terms where no item holds the pair."""
        codes = words[:-1] * self.base + words[1:]
        if not len(self.codes):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, len(self.codes))

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All pieces whose score reaches the threshold, by block-max WAND."""
        slack = threshold - 1e-9
        lists = [(t, *self.postings(t)) for t in terms]
        at = [0] * len(lists)
        out = []
        while True:
            live = sorted((i for i in range(len(lists)) if at[i] < len(lists[i][1])), key=lambda i: lists[i][1][at[i]])
            total, pivot = 0.0, -1
            for k, i in enumerate(live):
                total += self.most[lists[i][0]]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return out
            piece = lists[live[pivot]][1][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][1][at[live[pivot + 1]]] == piece:
                pivot += 1
            front = live[: pivot + 1]
            bound, skip_to = 0.0, math.inf
            for i in front:
                docs, tops = lists[i][1], lists[i][3]
                block = at[i] // BLOCK
                while block < len(tops) and docs[min((block + 1) * BLOCK, len(docs)) - 1] < piece:
                    block += 1
                if block < len(tops):
                    bound += tops[block]
                    skip_to = min(skip_to, docs[min((block + 1) * BLOCK, len(docs)) - 1] + 1)
            if bound < slack:  # no piece in these blocks can reach it
                if pivot + 1 < len(live):
                    skip_to = min(skip_to, lists[live[pivot + 1]][1][at[live[pivot + 1]]])
                target = max(skip_to, piece + 1)
                score = None
            else:
                target, score = piece, 0.0
            for i in front:
                docs = lists[i][1]
                while at[i] < len(docs) and docs[at[i]] < target:
                    at[i] += 1
                if score is not None and at[i] < len(docs) and docs[at[i]] == piece:
                    score += lists[i][2][at[i]]
                    at[i] += 1
            if score is not None and score >= slack:
                out.append((piece, score))


class _Numbers(dict):
    """The index's number of a raw word; -1 for one without letters or digits."""

    def __init__(self, number: dict[str, int]):
        self.number, self.none = number, len(number)

    def __missing__(self, raw: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        word = raw.strip(_EDGES)
        n = self[raw] = self.number.get(word, self.none) if word else -1
        return n


def leaks(text: str, index: Index, numbers: _Numbers) -> list[tuple[object, int, float, float, float]]:
    """For each item that the text gives away: its id, the passage's first word, the score, the question's and the answer's share."""
    raw = text.lower().split()
    if not raw or not index.owner:
        return []
    numbered = np.fromiter(map(numbers.__getitem__, raw), np.int64, len(raw))
    place = np.flatnonzero(numbered >= 0)
    terms = index.terms(numbered[place])
    sums = np.concatenate([[0.0], np.cumsum(index.most[terms])])
    begins = np.arange(0, max(1, len(terms) - PASSAGE + STRIDE), STRIDE)
    ends = np.minimum(begins + PASSAGE, len(terms))
    live = sums[ends] - sums[begins] >= THRESHOLD - 1e-9
    found: dict[int, tuple] = {}
    for a, b in zip(begins[live].tolist(), ends[live].tolist(), strict=True):
        first, last = int(place[a]), int(place[b]) + 1
        for piece, score in index.search([t for t in set(terms[a:b].tolist()) if t != len(index.codes)]):
            n = index.owner[piece]
            item, words = index.items[n]
            room = len(words) + PASSAGE
            around = words_of(" ".join(raw[max(0, first - room) : last + room]))
            held = grams(around)
            shares = [share(p, around, held) for p in index.parts[n]]
            if shares[0] >= QUESTION_SHARE and shares[1] >= ANSWER_SHARE and (n not in found or score > found[n][2]):
                found[n] = (item, first, score, *shares)
    return list(found.values())


def _shards(items: DataFrame, index_bytes: int) -> int:
    """How many shards keep each one's text within ``index_bytes``, as far as single items allow."""
    n = 1
    while True:
        dealt = items.groupBy(_shard(n).alias("shard")).agg(F.sum(F.octet_length("__text") + 16).alias("bytes"), F.count_distinct("__item", "__text").alias("n"))
        if dealt.filter((F.col("bytes") > index_bytes) & (F.col("n") > 1)).limit(1).count() == 0:
            return n
        n *= 2


def _shard(n: int):
    return F.pmod(F.xxhash64("__item", "__text"), F.lit(n)).cast("int")


def _piece_terms(batches):
    """Of rows item, text, shard: a row for each piece with its shard, distinct terms and number of terms."""
    for batch in slices(batches):
        found = [(k, pairs_of(p)) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for p in pieces_of(words_of(t))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([sorted(set(t)) for _, t in found], pa.list_(pa.string())), pa.array([len(t) for _, t in found], pa.int32())], names=["shard", "terms", "n"])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Pairs ``id_col``, ``item_col`` of texts and items that leak, with place, score and overlaps."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("__item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("__text"))
    shards = _shards(items, index_bytes)
    items = items.withColumn("__shard", _shard(shards))
    pieces = stage(items.mapInArrow(_piece_terms, "shard int, terms array<string>, n int"), "pieces")
    n_pieces, n_terms = pieces.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = pieces.select("shard", F.explode("terms").alias("term"))
    frequency = stage(each.groupBy("term").agg(F.count("*").alias("df")), "terms")
    plain = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    d = T.DoubleType()
    schema = T.StructType([plain.schema[0], T.StructField(item_col, items.schema["__item"].dataType), T.StructField("first_word", T.IntegerType()), T.StructField("score", d), T.StructField("question_share", d), T.StructField("answer_share", d)])
    arrow = to_arrow_schema(schema)

    def search(shard: int) -> DataFrame:
        own = items.filter(F.col("__shard") == shard).select("__item", "__text").orderBy("__item", "__text").collect()  # index_bytes of text, checked above
        df = frequency.join(each.filter(F.col("shard") == shard).select("term").distinct(), "term", "left_semi").collect()  # the terms of that text
        cast = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in own], Statistics(dict(map(tuple, df)), n_pieces, n_terms / max(1, n_pieces))))

        def run(batches):
            index = cast.value
            numbers = _Numbers(index.number)
            for batch in slices(batches):
                rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in leaks(t or "", index, numbers)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        return plain.mapInArrow(run, schema)

    out = search(0)
    for shard in range(1, shards):
        out = out.unionByName(search(shard))
    return out
