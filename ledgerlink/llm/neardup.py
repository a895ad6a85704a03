"""Operator 4: n-gram Jaccard join by chosen paths.

A text is the set of its hashed five-word shingles (of fewer words: the one
shingle they make).  Texts with equal sets are one class; a class joins once,
however many copies it has.

Candidates.  In every run a set picks each of its tokens with a chance of
``FIRST / (similarity * size)``, by a hash that all sets share, so that similar
sets pick common tokens; sets that picked a token meet in its bucket.  Small
buckets are compared by brute force.  The members of large ones are compared
with a pivot: close ones are linked to it and leave, as whatever is similar to
them is linked to it as well; the others are split again by freshly picked
tokens, level after level.  What is still large at the last level is compared
in blocks, so that no bucket is left out.  Comparisons use bottom-k sketches
with a margin.  Runs repeat until the target recall is reached, for a pair at
the threshold.

Verification.  Candidates in one component are compared exactly, block by
block, on their whole shingle sets.  Only links at or over the threshold count.
No pairs leave a task: a task gives each member its number of links and its
root, and roots are joined across tasks.

Texts without words are never linked, and are classes of their own; so are
rows with a null id (class null).  Rows that repeat an id and a text are copies
of each other; rows with one id and several texts are judged each.  An empty
table gives no rows; texts of any length are taken whole; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.batches import slices
from ledgerlink.llm.components import attach, components
from ledgerlink.staging import stage, unstage

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
FIRST, DEEPER = 3.0, 1.0  # expected picks of a token set's like, at the first level and below
LEVELS = 5
SMALL = 64
SKETCH = 64
NEAR = 0.6  # of sketches, for a candidate at similarity 0.8
PIVOT_LINK, PIVOT_LEAVE = 0.3, 0.65
BLOCK = 128
MEMORY = 100_000  # words whose hashes a worker remembers before it starts afresh
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: multipliers of a public 64-bit finaliser
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of the lower-cased text."""
    words = text.lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(own))
    total = np.zeros(len(own) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total * _STEP + own[k : k + len(total)])
    return np.unique(total)


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the threshold has met with this chance, at the first level."""
    shared = 2 / (1 + similarity)  # common tokens over a set's size, times similarity
    once = 1 - math.exp(-FIRST * shared * 0.75)  # a quarter of the common tokens may be too frequent
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _picks(tokens: np.ndarray, run: int, level: int, similarity: float) -> np.ndarray:
    """The set's tokens that this run and level pick."""
    rate = (FIRST if level == 0 else DEEPER) / (similarity * max(1, len(tokens)))
    drawn = mix(tokens + np.array([run * LEVELS + level + 1], np.uint64) * _M2)
    return drawn[drawn < np.uint64(min(rate, 1.0) * (2**64 - 2**12))] if rate < 1 else drawn


def sketched(docs: DataFrame, runs: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """id, node (digest of the shingle set; null without words or id), size, sketch, picks: staged."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes = _Hashes()
        for batch in slices(batches):
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = shingles(text or "", hashes)
                if i is None or not len(tokens):
                    out.append((None, 0, None, None))
                    continue
                picks = [_picks(tokens, r, level, similarity).view(np.int64).tolist() for r in range(runs) for level in range(LEVELS)]
                out.append((xxhash.xxh3_128_digest(tokens.tobytes()), len(tokens), (tokens[:SKETCH] >> np.uint64(16)).tobytes(), picks))
            node, size, sketch, picks = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(sketch, pa.binary()), pa.array(picks, pa.list_(pa.list_(pa.int64())))], names=["id", "node", "size", "sketch", "picks"]
            )

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = plain.mapInArrow(run, f"id {id_type}, node binary, size int, sketch binary, picks array<array<bigint>>")
    return stage(made.withColumn("row", F.monotonically_increasing_id()), "sets")


def alike(a: frozenset, b: frozenset) -> float:
    """Similarity of two sets by their bottom-k sketches."""
    low = sorted(a | b)[:SKETCH]
    return sum(1 for x in low if x in a and x in b) / len(low)


def _read(sketch: bytes) -> frozenset:
    return frozenset(np.frombuffer(sketch, np.uint64).tolist())


def groups(batches, key: int = 0) -> Iterator[list[tuple]]:
    """Runs of rows with one key, from batches sorted by it."""
    kept: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kept and kept[0][key] != row[key]:
                yield kept
                kept = []
            kept.append(row)
    if kept:
        yield kept


class _Roots(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = x = self.setdefault(self[x], self[x])
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])


def _compare_small(similarity: float):
    """Rows key, node, size, sketch: a spanning set of links for each bucket."""

    def run(batches):
        edges: list[tuple[int, int]] = []
        for rows in groups(batches):
            roots, members = _Roots(), [(n, size, _read(s)) for _, n, size, s in dict.fromkeys(rows)]
            for i, (n, size, s) in enumerate(members):
                for m, other, t in members[:i]:
                    if min(size, other) >= similarity * max(size, other) and roots.find(n) != roots.find(m) and alike(s, t) >= NEAR:
                        roots.join(n, m)
            # stars, as they are the same from all buckets that hold the same sets
            edges += [(n, roots.find(n)) for n, _, _ in members if roots.find(n) != n]
            if len(edges) >= 10_000:
                yield _edge_batch(edges)
                edges = []
        if edges:
            yield _edge_batch(edges)

    return run


def _compare_pivot(batches):
    """Rows key, run, node, sketch, pivot, its sketch: adds the similarity."""
    for batch in batches:
        s, p = (batch.column(c).to_pylist() for c in (3, 5))
        seen: dict[bytes, frozenset] = {}
        near = [alike(_read(x), seen.get(y) or seen.setdefault(y, _read(y))) for x, y in zip(s, p, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(near, pa.float64())], names=["key", "run", "node", "pivot", "near"])


def _buckets(picked: DataFrame, label: str) -> DataFrame:
    """Rows key, run, node of buckets with two members or more, with the bucket's n: staged."""
    picked = picked.select("key", "run", "node")
    counts = stage(picked.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    return stage(picked.join(counts.hint("merge"), "key"), label)


def _blocks(rows: DataFrame, by: str, n: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks that it belongs to: columns group, own, lo, hi."""
    number = F.ceil(F.col(n) / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), number).cast("int")
    both = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), number - 1)))
    both = both.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return both.withColumn("group", F.xxhash64(by, "lo", "hi"))


def candidates(reps: DataFrame, runs: int, similarity: float) -> DataFrame:
    """Staged edges a, b between sets that may be similar; reps: node (long), size, sketch, picks."""
    spark = reps.sparkSession
    sketch = reps.select("node", "size", "sketch")
    firsts = F.array(*(F.struct(F.lit(r).alias("run"), F.get("picks", r * LEVELS).alias("tokens")) for r in range(runs)))
    level0 = reps.select("node", F.explode(firsts).alias("p")).select("node", "p.run", F.explode("p.tokens").alias("token"))
    members = _buckets(level0.withColumn("key", F.xxhash64("run", "token")), "members")
    edges = None

    def add(more: DataFrame):
        nonlocal edges
        more = stage(more.select("a", "b"), "edges")
        edges = more if edges is None else edges.unionByName(more)

    def brute(rows: DataFrame, key: str):
        with_sets = rows.select(F.col(key).alias("key"), "node").distinct().join(sketch.hint("merge"), "node").select("key", "node", "size", "sketch")
        add(with_sets.repartition("key").sortWithinPartitions("key").mapInArrow(_compare_small(similarity), "a long, b long"))

    for level in range(1, LEVELS + 1):
        brute(members.filter(F.col("n") <= SMALL), "key")
        large = members.filter(F.col("n") > SMALL)
        if large.limit(1).count() == 0:
            return edges
        # every bucket's member with the least hash is its pivot; buckets that share members often share it, and its edges
        pivots = stage(large.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("pivot")), "pivots")
        pivots = stage(pivots.join(sketch.select(F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot"), "pivots")
        placed = stage(large.join(sketch, "node").select("key", "run", "node", "sketch"), "placed")
        near = placed.join(pivots, "key").select("key", "run", "node", "sketch", "pivot", "pivot_sketch").mapInArrow(_compare_pivot, "key long, run int, node long, pivot long, near double")
        near = stage(near, "near")
        unstage(placed)
        add(near.filter((F.col("near") >= PIVOT_LINK) & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
        rest = near.filter(F.col("near") < PIVOT_LEAVE).select("key", "run", "node")
        if level == LEVELS:
            left = rest.join(stage(rest.groupBy("key").agg(F.count("*").alias("n")), "counts"), "key")
            brute(_blocks(left, "key", "n", SMALL // 2).select("group", "node"), "group")
            return edges
        picks = rest.join(reps.select("node", "picks"), "node")
        deeper = F.get("picks", F.col("run") * LEVELS + level)
        split = picks.select("run", "node", "key", F.explode(deeper).alias("token")).withColumn("key", F.xxhash64("key", "token"))
        members = _buckets(split, "members")
    return spark.createDataFrame([], "a long, b long")


def _verify(similarity: float):
    """Rows group, lo, hi, own, node, tokens: each member's links across this pair of blocks, and a root."""

    def run(batches):
        for rows in groups(batches):
            rows = list({(r[4], r[3]): r for r in rows}.values())
            crossing = rows[0][1] != rows[0][2]
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            sizes = np.array([len(s) for s in sets])
            tokens, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(rows)), sizes)
            use = times[at] > 1  # tokens of a single set add nothing
            cols = np.cumsum(times > 1)[at[use]] - 1
            order = np.argsort(cols, kind="stable")
            cols, row = cols[order], row[use][order]
            common = np.zeros((len(rows), len(rows)), np.float32)
            step = 16_384
            for begin in range(0, int(cols[-1]) + 1 if len(cols) else 0, step):
                a, b = np.searchsorted(cols, [begin, begin + step])
                part = np.zeros((len(rows), step), np.float32)
                part[row[a:b], cols[a:b] - begin] = 1
                common += part @ part.T
            union = sizes[:, None] + sizes[None, :] - common
            linked = common >= similarity * union - 1e-6
            np.fill_diagonal(linked, False)
            own = np.array([r[3] for r in rows])
            if crossing:
                linked &= own[:, None] != own[None, :]
            roots = _Roots()
            for a, b in zip(*np.nonzero(np.triu(linked)), strict=True):
                roots.join(rows[a][4], rows[b][4])
            counts = linked.sum(axis=1)
            some = np.flatnonzero(counts)
            if len(some):
                nodes = [rows[k][4] for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([roots.find(n) for n in nodes], pa.int64()), pa.array(counts[some], pa.int64())], names=["node", "root", "links"])

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row for each row of ``docs``: ``id_col``, class_id, exact_id, n_copies and n_links.

    class_id: least id among all texts connected by links; exact_id: least id
    with the same shingle set; n_copies: rows of that set; n_links: other sets at
    or over the similarity.
    """
    runs = runs_for(recall, similarity)
    sets = sketched(docs, runs, similarity, id_col, text_col)
    held = sets.filter(F.col("node").isNotNull())
    # the set's first row stands for all its copies
    nodes = stage(held.groupBy("node").agg(F.min("row").alias("rep"), F.min("id").alias("exact_id"), F.count("*").alias("n_copies")), "nodes")
    reps = stage(held.join(nodes.select(F.col("rep").alias("row")).hint("merge"), "row").select(F.col("row").alias("node"), "id", F.col("node").alias("digest"), "size", "sketch", "picks"), "reps")
    found = components(candidates(reps, runs, similarity))  # joins of tables that grow are merge joins at every size

    # the candidates' whole sets, from their texts
    wanted = stage(found.join(reps.select("node", "id", "digest"), "node").select("id", "node", "digest", "label"), "wanted")

    def whole(batches):
        hashes = _Hashes()
        for batch in slices(batches):
            node, digest, label, text = (batch.column(c).to_pylist() for c in range(4))
            sets = [shingles(t or "", hashes).tobytes() for t in text]
            same = [k for k, s in enumerate(sets) if xxhash.xxh3_128_digest(s) == digest[k]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in same], t) for x, t in ((node, pa.int64()), (label, pa.int64()), (sets, pa.binary()))], names=["node", "label", "tokens"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted.hint("merge"), "id").select("node", "digest", "label", "text")
    full = stage(texts.mapInArrow(whole, "node long, label long, tokens binary"), "full")
    sizes = stage(found.groupBy("label").agg(F.count("*").alias("n")), "sizes")
    dealt = _blocks(attach(full, sizes, "label"), "label", "n", BLOCK).select("group", "lo", "hi", "own", "node", "tokens")
    checked = stage(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_verify(similarity), "node long, root long, links long"), "checked")
    unstage(full)
    linked = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))

    # classes by their least id
    named = linked.join(nodes.select(F.col("rep").alias("node"), "exact_id"), "node")
    least = named.groupBy("label").agg(F.min("exact_id").alias("class_id"))
    of = stage(attach(named.select("node", "label"), least, "label").join(links, "node").select(F.col("node").alias("rep"), "class_id", "n_links"), "classes")
    known = stage(nodes.join(of, "rep", "left").select("node", F.coalesce("class_id", "exact_id").alias("class_id"), "exact_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "known")
    out = sets.select("id", "node").join(known.hint("merge"), "node", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("exact_id", "id").alias("exact_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents whose class has a lesser id; rows with a null id stay."""
    others = classes.filter(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(others, docs[id_col] == F.col("__id"), "left_anti")
