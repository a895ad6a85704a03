import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlink.llm import bpe, decontaminate, lm, neardup, quality, token_counts, toxicity

SF = "/root/testdata/sf0.001"


def _rows(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def _tiktoken():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_library(docs):
    enc = _tiktoken()
    want = []
    for i, t in _rows(docs):
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(docs, bucket_chars=2000, parts=5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_empty(no_docs):
    assert bpe.digests(no_docs).collect() == []


def test_token_counts(docs, no_docs):
    enc = _tiktoken()
    lens = sorted(len(enc.encode_ordinary(t)) for _, t in _rows(docs))
    got = {r.n_tokens: r for r in token_counts.suffix_sums(token_counts.histogram(docs)).collect()}
    assert set(got) == set(lens)
    for n, r in got.items():
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == (lens.count(n), sum(x > n for x in lens), sum(x for x in lens if x > n))
        assert (r.truncated_total, r.tokens_total) == (sum(min(x, n) for x in lens), sum(lens))
    told = token_counts.answers(token_counts.histogram(docs), [4, 100], [0.5, 1.0])
    assert told["truncated"] == {4: sum(min(x, 4) for x in lens), 100: sum(min(x, 100) for x in lens)} and told["quantiles"][1.0] == lens[-1]
    assert token_counts.suffix_sums(token_counts.histogram(no_docs)).collect() == []
    assert token_counts.answers(token_counts.histogram(no_docs), [4], [0.5])["tokens"] == 0


def _tokens(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] + ["\n"]


def _plain_model(rows, out):
    """The model's counts and its probability of a word after another, in plain Python; the filter is taken to make no mistakes."""
    train = [_tokens(t) for i, t in rows if not out(i)]
    c, pairs = Counter(w for t in train for w in t), Counter(x for t in train for x in zip(["\n", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    q = {x: 2 ** math.floor(math.log2(k)) for x, k in pairs.items()}
    total, kinds = Counter(), Counter()
    for (h, _), k in q.items():
        total[h] += k
        kinds[h] += 1

    def chance(h, w):
        plain = (c[w] + 0.5) / (n + 0.5 * (v + 1))
        return (max(q.get((h, w), 0) - lm.DISCOUNT, 0) + lm.DISCOUNT * kinds[h] * plain) / total[h] if total[h] else plain

    return c, n, v, chance


def test_lm_equals_plain_python(docs, no_docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = _rows(docs)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, n, v, chance = _plain_model(rows, out)

    def whole(t):
        w = _tokens(t)
        return sum(math.log10(chance(h, x)) for h, x in zip(["\n", *w], w, strict=False))

    want = sorted(((i, out(i), len(_tokens(t)), sum(w in c for w in _tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in _tokens(t)), 4), round(whole(t), 1)) for i, t in rows), key=str)
    got = lm.score(docs, held, bucket_chars=3000, parts=7).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 1)) for r in got), key=str) == want
    dealt = lm.score(docs, held, bucket_chars=3000, parts=7, broadcast_bytes=0).collect()
    assert sorted(got, key=str) == sorted(dealt, key=str)
    other = lm.score(docs, held).collect()
    assert np.allclose(sorted(r.base_score for r in got), sorted(r.base_score for r in other)) and np.allclose(sorted(r.score for r in got), sorted(r.score for r in other), rtol=1e-3)
    assert lm.score(no_docs, held).collect() == []
    assert {(r.score, r.train_tokens) for r in lm.score(docs.filter("doc_id = 4"), F.lit(True)).collect()} == {(0.0, 0)}


def test_lm_filter_reads_back_counts():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**48, 8000).astype(np.uint64))
    put, absent = keys[::2], keys[1::2]
    counts = np.where(np.arange(len(put)) % 4 == 0, rng.integers(2, 200, len(put)), 1)
    blob = lm.segment(put, counts)
    got = lm.Filter({0: blob}, 1).levels(put)
    want = 1 + np.floor(np.log2(counts))
    assert (got >= want).all() and (got == want).mean() > 0.999
    assert (lm.Filter({0: blob}, 1).levels(absent) > 0).mean() < 0.002 and 0 < lm.mistakes(blob) < 1e-4
    halves = [put[put % np.uint64(2) == k] for k in range(2)]
    both = lm.Filter({k: lm.segment(h, np.full(len(h), 5)) for k, h in enumerate(halves)}, 2)
    assert (both.levels(put) == 3).mean() > 0.999 and len(lm.segment(put[:0], counts[:0])) == 0


def test_lm_chances_of_all_words_sum_to_one_at_most():
    rng = np.random.default_rng(3)
    words, seen, n, v = 3000, 40, 50_000, 3000
    counts = rng.multinomial(n, rng.dirichlet(np.ones(words)))
    plain = (counts + 0.5) / (n + 0.5 * (v + 1))
    hashes = rng.integers(0, 2**63, words).astype(np.uint64)
    sums = []
    for h in range(seen):
        after = rng.choice(words, 1 + h, replace=False)
        times = rng.integers(1, 20, len(after))
        keys = lm.pair_key(np.full(words, hashes[h]), hashes)
        blob = lm.segment(keys[after], times)
        level = lm.Filter({0: blob}, 1).levels(keys)
        q = np.ldexp(1.0, lm.quantise(times) - 1)
        p = lm.chances(level, plain, np.full(words, q.sum()), np.full(words, len(after)), v * lm.mistakes(blob))
        assert (p > 0).all()
        sums.append(p.sum())
    assert np.mean(sums) <= 1 + 1e-3 and max(sums) < 1.05 and min(sums) > 0.9


def test_lm_tells_a_pair_seen_once_from_an_unseen_one(spark):
    words = [f"w{k}" for k in range(400)]
    train = [(k, " ".join(words[k : k + 20])) for k in range(0, 400, 20)] + [(1000 + k, w) for k, w in enumerate(words)]
    held = [(2000, " ".join(words[40:60])), (2001, " ".join(words[40:60][::-1]))]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(train + held, "doc_id long, text string"), F.col("doc_id") >= 2000, parts=3).collect()}
    assert abs(got[2000].base_score - got[2001].base_score) < 1e-9 and got[2000].score > got[2001].score + 1


def test_lm_beats_words_on_held_out_text(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = lm.score(d, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def _brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    three = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(three)
    cover = {k + j for k, x in enumerate(three) if n[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_base_counts(spark, docs, no_docs):
    trusted = spark.createDataFrame([(3,), (5,), (5,), (None,)], "doc_id long")
    model = quality.weights(docs, trusted)
    got = quality.judge(docs, model).collect()
    brute = {(i, t): _brute_quality(t) for i, t in _rows(docs)}
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == sorted(str((i, *brute[i, t])) for i, t in _rows(docs))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.kept or not r.base_failed) for r in got)
    none = quality.weights(no_docs, trusted)
    assert quality.judge(no_docs, none).collect() == []
    assert {r.llr for r in quality.judge(docs, none).collect()} == {0.0}
    assert quality.judge(docs, model).filter("NOT kept").count() == sum(not r.kept for r in got)


def test_quality_ratio_equals_plain_python(spark, docs):
    import xxhash

    trusted = spark.createDataFrame([(3,), (5,), (7,)], "doc_id long")
    of = lambda *words: _chained(xxhash.xxh64_intdigest, words) % quality.CELLS
    rows = _rows(docs)
    grams = {t: [of(w) for w in t.encode().split()] + [of(*x) for x in zip(t.encode().split(), t.encode().split()[1:], strict=False)] for _, t in rows if "\x00" not in t and "İ" not in t}
    use = [(i, t) for i, t in rows if t in grams]
    raw, good = Counter(c for _, t in use for c in grams[t]), Counter(c for i, t in use if i in (3, 5, 7) for c in grams[t])
    n, m = sum(raw.values()), sum(good.values())
    ratio = lambda c: math.log((good[c] + 1) / (m + quality.CELLS)) - math.log((raw[c] + 1) / (n + quality.CELLS))
    own = docs.filter(~F.coalesce(F.col("text"), F.lit("")).contains("\x00"))
    for r in quality.judge(own, quality.weights(own, trusted)).join(own.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        cells = grams[r.text or ""]
        assert abs(r.llr - sum(map(ratio, cells)) / max(1, len(cells))) < 1e-5
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def _chained(digest, words):
    h = 42
    for w in words:
        h = digest(w, h)
    return h


def test_quality_keeps_clean_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(d, quality.weights(d, labels.filter("quality = 1"))).filter("NOT base_failed").join(labels, "doc_id")
    share = {r.quality: r[1] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert share[1] > 0.98 and share[0] < 0.1


def test_toxicity(spark, docs, no_docs):
    text = [f"Item {k} about {'a moron' if k % 4 == 0 else 'the garden'} here. Nice day number {k}. All is well." for k in range(400)]
    train = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(train, labels, F.col("doc_id") % 5 != 0)
    extra = spark.createDataFrame([(1, "All is well. What a moron you are. Nice day."), (2, "Nice day."), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(extra, model).collect()}
    assert [got[k].predicted for k in (1, 2, 3, 4)] == [1, 0, 0, 0] and got[3].score == got[4].score == 0
    span = got[1].offending[0]
    assert "moron" in "All is well. What a moron you are. Nice day."[span.start : span.end] and len(got[1].offending) == 1
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(no_docs, model).collect() == []
    blank = toxicity.train(no_docs, labels)
    assert {r.score for r in toxicity.score(extra, blank).collect()} == {0.0}


def test_toxicity_is_a_noisy_or_of_sentences(spark, docs):
    weight = {"moron": 6.0, "hello": 2.5, "hell*": 1.0, "größe": 3.0, "grö*": 9.0, "größ*": 0.5, "x": -1.0, "a": 0.25}
    model = toxicity.Model(weight, -4.0)

    def sentence(s):
        words = set(re.findall(r"\w+", s))
        z = -4.0 + sum(weight.get(w, 0) + (weight.get(w[:4] + "*", 0) if len(w) > 4 else 0) for w in words)
        return 1 / (1 + math.exp(-z))

    extra = spark.createDataFrame([(50, "Hello. Hello! hello? What a moron\nhello"), (51, "hello. " * 30), (52, "... !!! ???"), (52, "a moron. a moron."), (None, "moron")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    want = []
    for i, t in _rows(every):
        parts = [sentence(p) for p in re.split(r"[.!?\n]", t.lower()) if re.search(r"\w", p)]
        want.append((i, round(1 - math.prod(1 - p for p in parts), 6)))
    got = toxicity.score(every, model).collect()
    assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.predicted == (r.score >= 0.5) and (len(r.offending) > 0 or r.score < 0.5) for r in got)
    doubtful = next(r for r in got if r.doc_id == 51)
    assert doubtful.predicted == 1 and len(doubtful.offending) == 1 and doubtful.offending[0].score < toxicity.CUT


def test_toxicity_fit_climbs_the_likelihood():
    texts = [f"Item {k} of {'rotten' if k % 3 == 0 else 'green'} fruit. A day like others {k % 5}." for k in range(300)]
    labels = [int(k % 3 == 0) for k in range(300)]
    model = toxicity.fit(texts, labels)
    values = toxicity._Values(model.weight)
    loss = lambda w, b: -sum(math.log(max(1e-12, p if y else 1 - p)) for t, y in zip(texts, labels, strict=True) for p in [toxicity._scores(t, w, b)[0]])
    assert loss(values, model.bias) < 0.2 * loss(toxicity._Values({}), toxicity.FIRST_BIAS)
    assert model.weight["rotten"] > 0 and all(v <= model.weight["rotten"] for v in model.weight.values())


def test_toxicity_skips_texts_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40_000)
    text = [f"Item {k} about {'a moron' if k % 4 == 0 else 'the garden'} here. Nice day number {k}. All is well." for k in range(400)]
    long = " ".join(f"long{k}" for k in range(10_000))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(400 + k, 0) for k in range(40)], "doc_id long, toxic int")
    train = spark.createDataFrame([*enumerate(text), *((400 + k, f"{long} {k}") for k in range(40))], "doc_id long, text string")
    model = toxicity.train(train, labels)
    extra = spark.createDataFrame([(1, "All is well. What a moron you are."), (2, "Nice day.")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(extra, model).collect()} == {1: 1, 2: 0}
    with pytest.raises(ValueError):
        toxicity.train(train, labels.filter("doc_id >= 400 OR toxic = 1"))


def _sets(rows):
    h = neardup._Hashes()
    return {i: frozenset(neardup.shingles(t, h).tolist()) for i, t in rows if i is not None}


def _brute_classes(sets, least=0.8):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    firsts = {}
    for i in sorted(sets):
        if sets[i]:
            firsts.setdefault(sets[i], i)
    for i in sets:
        if sets[i]:
            a, b = find(i), find(firsts[sets[i]])
            root[max(a, b)] = min(a, b)
    reps = list(firsts.values())
    for k, i in enumerate(reps):
        for j in reps[:k]:
            same = len(sets[i] & sets[j])
            if same >= least * (len(sets[i]) + len(sets[j]) - same) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: links[firsts[sets[i]]] if sets[i] else 0 for i in sets}


def test_components_of_stars_and_chains(spark):
    import random

    from ledgerlink.llm import components

    rng = random.Random(5)
    edges = [(500, k) for k in range(5000) if k != 500] + [(9000, 6000 + k) for k in range(2000)] + [(10_000 + k, 10_001 + k) for k in range(200)] + [(4999, 6000), (7, 7), (20_001, 20_000), (20_000, 20_001), (None, 3)]
    edges += [(30_000 + rng.randrange(3000), 30_000 + rng.randrange(3000)) for _ in range(1500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in components.components(table).collect()} == {x: find(x) for x in root}
    assert components.components(table.limit(0)).collect() == []
    thin = components.without_hubs(table.filter("a = 500"), "a", "b")
    most = thin.unionByName(thin.selectExpr("b AS a", "a AS b")).filter("a <> b").groupBy("a").count().agg(F.max("count")).first()[0]
    assert most <= 3 * components.ROOTS


def test_jaccard_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [[f"w{rng.randrange(800)}" for _ in range(rng.randrange(20, 90))] for _ in range(40)]
    shared = [f"s{k}" for k in range(30)]
    rows = []
    for k in range(260):
        words = list(base[0] if k % 3 == 0 else rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
        rows.append((k, " ".join(words + (shared if k % 2 else []))))
    rows += [(900 + k, rows[0][1]) for k in range(150)]
    got = {r.doc_id: r for r in neardup.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    classes, links = _brute_classes(_sets(rows))
    assert {i: r.class_id for i, r in got.items()} == classes
    assert {i: r.n_links for i, r in got.items()} == links


def test_jaccard_recall_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in neardup.join(d).collect()}
    classes, links = _brute_classes(_sets(_rows(d)))
    assert {i: r.class_id for i, r in got.items()} == classes and {i: r.n_links for i, r in got.items()} == links


def test_jaccard_odd_rows(docs, no_docs):
    got = neardup.join(docs).collect()
    assert len(got) == docs.count()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add((r.class_id, r.exact_id, r.n_copies, r.n_links))
    assert of[6] == of[5] == {(5, 5, 3, 0)} and of[7] == {(7, 7, 2, 1)} and of[8] == {(7, 8, 1, 1)}
    assert of[0] == {(0, 0, 1, 0)} and of[None] == {(None, None, 1, 0)}
    kept = neardup.keep_one(docs, neardup.join(docs)).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in _rows(docs) if i not in (6, 8))
    assert neardup.join(no_docs).collect() == []


def test_decontamination(spark, docs, no_docs):
    item = "what is the boiling point of the strange green liquid in the seventh tank of hall nine it is ninety four degrees"
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "one"), (6, "some other words that stand nowhere else in all of these texts at all")], "item_id long, text string")
    noise = " ".join(f"filler{k}" for k in range(3000))
    texts = spark.createDataFrame([(1, f"{noise} {item.upper()}! {noise}"), (2, noise), (3, None), (4, item.replace("strange", "odd")), (5, " ".join(item.split()[:9]))], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find(texts, bench).collect())
    assert got == [(1, 1), (1, 2), (4, 1), (4, 2)]
    scores = lambda found: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in found.collect())
    assert scores(decontaminate.find(texts, bench, index_bytes=60)) == scores(decontaminate.find(texts, bench))
    assert decontaminate.find(docs, bench).collect() == [] and decontaminate.find(no_docs, bench).collect() == [] and decontaminate.find(texts, bench.limit(0)).collect() == []


def test_decontamination_of_short_items(spark):
    words = "name the tall grey bird that nests under seven old bridges near winter harbours twice".split()
    bench = spark.createDataFrame([(n, " ".join(f"{w}{n}" for w in words[:n])) for n in range(2, 16)] + [(1, "lone")], "item_id long, text string")
    noise = [f"filler{k}" for k in range(300)]
    texts = spark.createDataFrame([(n, " ".join([*noise[: 20 * n], *(f"{w}{n}" for w in words[:n]), *noise])) for n in range(2, 16)] + [(0, " ".join(noise)), (1, "lone")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(texts, bench).collect()) == [(n, n) for n in range(2, 16)]


def test_decontamination_of_near_copies(spark):
    item = "which small town in the northern valley keeps its old clock tower painted bright yellow today".split()
    assert len(item) == 16
    copies = [item[:k] + ["changed"] + item[k + 1 :] for k in range(11, 16)]
    other = item[:11] + "has a new railway station".split()
    noise = [f"filler{k}" for k in range(200)]
    rows = [(k, " ".join([*noise, *c, *noise])) for k, c in enumerate([*copies, other])]
    found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 2, 3, 4]


def test_decontamination_of_an_items_tail(spark):
    words = [f"piece{k}word" for k in range(70)]
    assert sorted({w for p in decontaminate.pieces_of(words) for w in p}) == sorted(words)
    assert [len(p) for p in decontaminate.pieces_of(words[:49])] == [48, 48] and decontaminate.pieces_of(words[:48]) == [words[:48]]
    noise = [f"filler{k}" for k in range(200)]
    tail, whole = [*noise, *words[20:], *noise], [*noise, *words, *noise]
    rows = spark.createDataFrame([(1, " ".join(tail)), (2, " ".join(whole)), (3, " ".join([*noise, *words[:46], *noise]))], "doc_id long, text string")
    found = decontaminate.find(rows, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == [1, 2]


def _plain_leaks(text, items):
    """Every item against every place of the text: the shares of its question and answer near a passage that scores enough."""
    index = decontaminate.Index(items)
    numbers = decontaminate._Numbers(index.number)
    raw = [w for w in text.lower().split()]
    numbered = [(k, numbers[w]) for k, w in enumerate(raw) if numbers[w] >= 0]
    terms = index.terms(np.array([n for _, n in numbered], np.int64)).tolist() if numbered else []
    out = set()
    for begin in range(0, max(1, len(terms) - decontaminate.PASSAGE + decontaminate.STRIDE), decontaminate.STRIDE):
        window = set(terms[begin : begin + decontaminate.PASSAGE])
        for piece, n in enumerate(index.owner):
            score = sum(w for t in window if t < len(index.codes) for p, w in zip(*index.postings(t)[:2], strict=True) if p == piece)
            if score >= decontaminate.THRESHOLD:
                item, words = index.items[n]
                first, last = numbered[begin][0], numbered[min(begin + decontaminate.PASSAGE, len(terms))][0] + 1
                around = decontaminate.words_of(" ".join(raw[max(0, first - len(words) - decontaminate.PASSAGE) : last + len(words) + decontaminate.PASSAGE]))
                if all(decontaminate.share(p, around, decontaminate.grams(around)) >= 0.5 for p in index.parts[n]):
                    out.add(item)
    return out


def test_decontamination_equals_plain_search(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    rows = [(i, t) for i, t in _rows(docs) if len(t) < 20_000]
    want = {(i, item) for i, t in rows for item in _plain_leaks(t, items)}
    assert want and {x for x in got if x[0] in {i for i, _ in rows}} == want


def test_wand_equals_full_scan(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    index = decontaminate.Index(items)
    numbers = decontaminate._Numbers(index.number)
    for _, text in _rows(spark.read.parquet(f"{SF}/documents.parquet"))[:60]:
        words = np.array([numbers[w] for w in text.lower().split()])
        terms = [t for t in set(index.terms(words[words >= 0]).tolist()) if t != len(index.codes)]
        full = Counter()
        for t in terms:
            for p, x in zip(*index.postings(t)[:2], strict=True):
                full[p] += x
        for least in (0.01, 0.05, 0.4):
            assert {p for p, _ in index.search(terms, least)} == {p for p, x in full.items() if x >= least - 1e-9}


@pytest.mark.parametrize("name", ["toxicity", "quality", "near_duplicates", "decontamination"])
def test_pipeline_stages_return_documents(spark, name):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, d, SF)
    assert out.columns == d.columns and 0 < out.count() <= d.count()
