"""Operator 2: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of its words and of their four-letter beginnings; the document's is
the noisy-or of its sentences, 1 - prod(1 - p).  Only documents are labelled;
the gradient of the document's likelihood shares the blame among its sentences,
so the same model then points at the offending ones.

The model is fitted on a bounded sample of labelled documents: per class the
``SAMPLE`` rows whose ids hash least.  All documents are scored, whole.

Null and empty texts have no sentence and the score 0.  Labels that are null
are left out; of a document labelled twice the larger label is used, once.
With no labelled row of both classes the score of every text is 0.  Texts that
do not fit ``SAMPLE_BYTES`` are skipped; if that leaves a class without any, it
is an error.  Repeated rows are scored each, and copies of a labelled text are
learnt from once.  An empty table gives no rows.  Long texts are scored whole.
Other columns, whatever their names, are not looked at.

A document at or over one half names at least one sentence: where many doubtful
sentences make it up and none reaches ``CUT``, the one that scores most.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.llm.batches import slices

#: Labelled documents of each class that the model is fitted on, at most, and bytes of their texts.
SAMPLE = 3000
SAMPLE_BYTES = 48_000_000
CELLS = 1 << 22  # of hashed document counts
MIN_DOCS = 4  # labelled documents that a word must stand in
PREFIX = 4
ROUNDS = 300
RATE = 0.5
FIRST_BIAS = -4.0
LEAK = 0.02  # chance that a document is marked for no sentence's sake; in training only
LASSO = 0.5  # documents' worth of slope below which a word's weight stays 0
CUT = 0.5
#: Words remembered by a worker before it starts afresh.
MEMORY = 400_000

_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that hold a word."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(m[0])]


def _keys(word: str) -> tuple[str, ...]:
    return (word, word[:PREFIX] + "*") if len(word) > PREFIX else (word,)


def _cell(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "replace")) % CELLS


class Model:
    """weight: by word and by beginning; the bias of a sentence."""

    def __init__(self, weight: dict[str, float], bias: float):
        self.weight, self.bias = weight, bias


def fit(texts: list[str], labels: list[int]) -> Model:
    labels = np.array(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model({}, -np.inf)
    # words that stand in enough documents, by hashed counts, so that the many rare words are never held
    seen = np.zeros(CELLS, np.uint16)
    for text in texts:
        keys = {k for w in set(_WORD.findall(text.lower())) for k in _keys(w)}
        cells = np.unique(np.fromiter(map(_cell, keys), np.int64, len(keys)))
        seen[cells] += 1
    number: dict[str, int] = defaultdict(count().__next__)
    cols, sizes = [], []
    for text in texts:
        lower = text.lower()
        spans = sentences(lower)
        for begin, end in spans:
            keys = {k for w in set(_WORD.findall(lower, begin, end)) for k in _keys(w) if seen[_cell(k)] >= MIN_DOCS}
            cols.append(np.fromiter(map(number.__getitem__, keys), np.int32, len(keys)))
        sizes.append(len(spans))
    lens = np.fromiter(map(len, cols), np.int64, len(cols))
    col = np.concatenate(cols) if cols else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(cols)), lens)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    w, bias = np.zeros(len(number)), FIRST_BIAS
    seen_w, seen_b = np.full(len(number), 1e-6), 1e-6
    for _ in range(ROUNDS):
        z = np.clip(bias + np.bincount(row, weights=w[col], minlength=len(cols)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = (1 - LEAK) * np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(sizes)))
        slope = np.where(labels > 0, -none / (1 - none), 1.0)
        g = slope[doc] * p
        gw = np.bincount(col, weights=g[row], minlength=len(number)) / len(sizes)
        gb = g.sum() / len(sizes)
        seen_w += gw * gw
        seen_b += gb * gb
        step = RATE / np.sqrt(seen_w)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * LASSO / len(sizes), 0)
        bias -= RATE * gb / np.sqrt(seen_b)
    return Model({k: float(w[i]) for k, i in number.items() if abs(w[i]) > 1e-3}, float(bias))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """use: a condition on ``id_col`` for the label rows that may be learnt from."""
    rows = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("__label")).filter(F.col(id_col).isNotNull() & F.col("__label").isin(0, 1))
    if use is not None:
        rows = rows.filter(use)
    rows = rows.select(F.col(id_col).alias("__id"), "__label").groupBy("__id").agg(F.max("__label").alias("__label"))
    sample = None
    for label in (0, 1):
        part = rows.filter(F.col("__label") == label).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).join(F.broadcast(sample), "__id")  # 2 * SAMPLE rows at most
    # copies of a text say nothing more
    order = F.xxhash64("__id", "__text")
    kept = both.groupBy("__text", "__label").agg(F.min("__id").alias("__id")).select("__text", "__label", order.alias("__order"))
    return fit(*_fill(((r["__text"], r["__label"]) for r in kept.orderBy("__order").toLocalIterator()), SAMPLE_BYTES))


def _fill(rows: Iterable[tuple[str, int]], room: int) -> tuple[list[str], list[int]]:
    """Texts and labels that fit ``room`` bytes: each class has half, and what it leaves is the other's."""
    own, seen, taken, spare, held = {0: room // 2, 1: room // 2}, set(), [], [], 0
    for text, label in rows:
        size = len(text.encode())
        seen.add(label)
        if size <= own[label]:
            own[label] -= size
            taken.append((text, label))
            continue
        if held + size > room:
            spare = [x for x in spare if x[2] <= sum(own.values())]
            held = sum(x[2] for x in spare)
        if held + size <= room:
            held += size
            spare.append((text, label, size))
    left = sum(own.values())
    for text, label, size in spare:
        if size <= left:
            left -= size
            taken.append((text, label))
    if len(seen) > len({label for _, label in taken}):
        raise ValueError(f"no labelled text of each class fits the sample's {room} bytes")
    return [text for text, _ in taken], [label for _, label in taken]


class _Values(dict):
    """What a word adds to its sentence."""

    def __init__(self, weight: dict[str, float]):
        self.weight = weight

    def __missing__(self, word: str) -> float:
        if len(self) > MEMORY:
            self.clear()
        value = self[word] = sum(self.weight.get(k, 0.0) for k in _keys(word))
        return value


def _scores(text: str, values: _Values, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score, and the spans and scores of sentences at or over ``CUT``, or of the highest one."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters change length; spans must stay those of the text
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = sentences(lower)
    if not spans or bias == -np.inf:
        return 0.0, []
    z = np.array([sum(map(values.__getitem__, set(_WORD.findall(lower, a, b)))) for a, b in spans]) + bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    total = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
    marked = np.flatnonzero(p >= CUT).tolist() or ([int(p.argmax())] if total >= 0.5 else [])
    return total, [(*spans[i], float(p[i])) for i in marked]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score, predicted and offending: spans, with scores, of the sentences at or over ``CUT``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    cast = docs.sparkSession.sparkContext.broadcast(model)  # the sample bounds the words it knows
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    plain = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([plain.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T.ArrayType(span))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        values = _Values(cast.value.weight)
        for batch in slices(batches):
            done = [_scores(t or "", values, cast.value.bias) for t in batch.column(1).to_pylist()]
            found = [[{"start": a, "end": b, "score": s} for a, b, s in spans] for _, spans in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow[0].type), pa.array([s for s, _ in done], pa.float64()), pa.array([int(s >= 0.5) for s, _ in done], pa.int32()), pa.array(found, arrow[3].type)], schema=arrow
            )

    return plain.mapInArrow(run, schema)
