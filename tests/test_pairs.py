"""Assembled pair features, candidate generation and the command lines."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlink.__main__ import main
from ledgerlink.functions import normalize, similarity
from ledgerlink.operators import blocking, decision, evaluate, extension, features, models, pairs, sampling
from ledgerlink.plans import catalogue
from ledgerlink.sources import records as io

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "pair_feature_table", "group_text_features", "joint_pass_features", "sibling_features", "class_rule_select", "name_only_features", "unclaimed_best", "neighbour_frame_features", "entity_support", "generate_candidates",
    "generate_reverse_candidates", "extension_pairs_second", "record_tokens", "threshold_curve", "simulate_expected_f", "percentile_profile", "score_frame_build",
])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("part", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(catalogue.ORACLES[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, DATA).select(*columns).collect()]
    close = lambda r: tuple(round(float(x), 4) if isinstance(x, (float, Decimal)) else x for x in r)
    order = lambda rows: sorted(map(close, rows), key=lambda r: tuple((x is not None, x) for x in r))
    assert len(got) == len(want) > 0 and order(got) == order(want)


def test_group_features_of_the_reference_case(spark):
    # Input and expected features.
    part = spark.createDataFrame([(1, 10, 2, 0.95), (1, 11, 3, 0.40), (1, 12, 2, 0.05)], "s1 long, m long, src int, p1 double")
    rows = [(10, 2, "acme tools", "acme tools", "akm tls", "12 main st", "12"), (11, 3, "acme tools", "acme tools", "akm tls", "", ""), (12, 2, "zeta foods", "foods zeta", "jt fds", "99 oak rd", "99")]
    recs = spark.createDataFrame(rows, "m long, src int, name_core string, name_key string, name_skel string, addr_norm string, addr_house_no string")
    got = {r.m: r for r in pairs.group_features(part, recs).collect()}
    assert got[11].g_anchor1_p > 0.9 and got[11].g_name_tset == 100 and got[11].g_name_key_eq == 1
    assert got[12].g_name_tset < 50 and got[12].g_name_key_eq == 0
    assert got[10].g_anchor1_p == 0.40 and got[10].g_p_rank == 1
    assert [got[m].g_n_conf for m in (10, 11, 12)] == [0, 1, 1]
    assert pairs.group_features(part.limit(0), recs).collect() == []


def test_context_counts_all_sources_and_bears_zero_scores(spark):
    rows = spark.createDataFrame([(1, 5, 2, 0.0), (1, 6, 3, 0.5), (2, 5, 2, 0.9), (2, 7, 2, 0.4)], "s1 long, m long, src int, p double")
    got = {(r.s1, r.m): r for r in features.within_context(rows).collect()}
    assert got[1, 5].ctx_score_rel is None and got[1, 5].ctx_n_cands == 2 and got[2, 7].ctx_score_gap == -0.5
    assert [r.g_p_gap for r in features.anchors(rows.filter("s1 = 2")).orderBy("m").collect()] == [-0.5, 0.5]


def test_reverse_keeps_a_zero_for_the_lone_candidate(spark):
    rows = spark.createDataFrame([(1, 5, 2, 0.7, 0.1, 0.6), (1, 6, 2, 0.9, 0.2, 0.7), (2, 6, 2, 0.8, 0.5, 0.3)], "s1 long, m long, src int, score double, name_score double, addr_score double")
    got = {(r.s1, r.m): r for r in blocking.reverse_top_k(rows, ["m", "src"], 1, 1, F.lit(False), "s1", 1, 0).collect()}
    assert got[1, 5].r_best2 == 0.0 and set(got) == {(1, 5), (1, 6), (2, 6)} and got[2, 6].r_name_best == 0.5


def test_pair_class_ladder(spark):
    rows = [("empty_addr", True, 3, 0, False, 0, 1, 0), ("sib_shift", False, 10, 0, False, 0, 1, 0), ("house_conflict", False, -10, 0, False, 0, 1, 0), ("house_conflict", False, None, 0, False, 0, 1, 0), ("acr_domain", False, 0, 1, True, 1, 1, 1),
            ("all_new_name", False, None, None, False, 2, 2, 1), ("word_swap", False, None, None, False, 1, 2, 1), ("add_word", False, None, None, False, 0, 2, 1), ("drop_word", False, None, None, False, 1, 2, 0), ("same_words", False, 0, 1, False, 0, 2, 0)]
    df = spark.createDataFrame(rows, "want string, e boolean, d int, q int, o boolean, miss int, n int, extra int")
    for r in df.withColumn("got", features.pair_class(*(F.col(c) for c in ("e", "d", "q", "o", "miss", "n", "extra")))).collect():
        assert r.got == r.want


def test_partial_takes_either_side_of_equal_length():
    assert similarity.partial("abcd", "xabc") == similarity.partial("xabc", "abcd") and similarity.partial("", "a") == 0.0
    assert similarity.partial("bolt", "cold bolt ltd") == 100.0


def test_extension_codes_and_bigrams(spark):
    rows = [(1, 2, "US", "acme tools", "acme tools", "12 green ray apartments high", "green ray", "high", "state 1", "B-46, D-2/201 Green", "12")]
    df = spark.createDataFrame(rows, "rid long, src int, country string, name_core string, name_key string, addr_norm string, addr_street string, addr_localities string, addr_state string, business_address string, house_v2 string")
    row = extension.prepare(df).first()
    assert row.cw == ["b46", "d2201"] and row.sw == ["green", "ray"] and row.sk == ["grn"]
    assert row.bw == ["green ray"]  # the pattern takes the blank behind, so every other pair
    keys = {r.key for r in extension.keys(extension.prepare(df), ["rid"], extension.SECOND).collect()}
    assert {"US|A|12|green", "US|I|b46|state 1", "US|J|d2201|high", "US|N|acme tools|state 1", "US|K|grn|high", "US|L|12|grn", "US|H|12|high"} <= keys


def test_learn_maps(spark):
    native, state = "ரெட் குளோபல்", "தமிழ்நாடு"
    rows = [("Red Global", "1 Main St, Chennai, Tamil Nadu", native, f"1 Main St, {state}")] * 3 + [("Blue", "x", "ரெட்", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "business_name_1 string, business_address_1 string, business_name_2 string, business_address_2 string")
    words, states = normalize.learn_maps(df)
    assert normalize.as_map(words.select("native", "latin")) == {"ret": "red", "kulopl": "global"}
    assert normalize.as_map(states.select("native", "state")) == {"tmilnatu": "tamil nadu"}
    with pytest.raises(ValueError):
        normalize.as_map(words.select("native", "latin"), 1)


def test_models(spark, tmp_path):
    rows = [(k, k % 40, k % 7, (k * 37) % 100 / 100.0, None if k % 9 == 0 else (k % 13) / 13, 1.0 if ((k * 37) % 100 > 60) != (k % 6 == 0) else 0.0) for k in range(1200)]
    df = spark.createDataFrame(rows, "m long, s1 long, src long, a double, b double, label double").withColumn("country", F.when(F.col("s1") % 2 == 0, "X").otherwise("Y"))
    keys = ["s1", "m", "src"]
    ready, columns = models.with_missing_flags(df.withColumn("check", F.col("m") % 5 == 0), ["a", "b"])
    early = models.fit(ready, columns, "label", boosted=True, validation="check", maxIter=60)
    assert early.stages[-1].getNumTrees < 60 and models.importance(early, columns)[0][0] == "__a"
    models.save(early, f"file://{tmp_path}/m", columns, 0.5, rounds=60)
    again, meta = models.load(spark, f"file://{tmp_path}/m")
    assert meta["threshold"] == 0.5 and meta["features"] == columns
    both = [{r.m: r.p for r in models.score(m, df, ["a", "b"], keys, 0.02).collect()} for m in (early, again)]
    assert both[0] == both[1] and len(both[0]) >= 400
    oof, mean = models.out_of_fold(df, ["a", "b"], "label", "s1", keys, 2, extra=df.limit(100), other=df.filter("s1 < 3"))
    assert oof.count() == 1200 and mean.count() == df.filter("s1 < 3").count()
    assert evaluate.auc(oof).first().auc > 0.75
    assert models.half_and_half(df, ["a"], "label", "s1", keys).count() < 1200 and models.leave_one_out(df, ["a"], "label", "country", keys).count() == 1200
    best = models.probe(df, ["a", "b"], "label", "s1", keys, {"deep": {"maxDepth": 4, "maxIter": 5}, "flat": {"maxDepth": 1, "maxIter": 1}}, 2).first()
    assert best.settings in ("deep", "flat") and best.auc > 0.7
    frame = df.select(*keys, F.col("a").alias("p"))
    blended = models.blend(df.filter("a < 0.9").select(*keys, F.col("a").alias("p"), "b", "label"), ["b"], "label", frame, folds=2)
    assert blended.count() == 1200 and blended.filter("p >= 0.9 AND pf <> p").count() == 0 and blended.filter("pf <> p").count() > 0
    thinned = models.sampled_negatives(df, "label", F.col("m"), 0.25)
    assert thinned.filter("label = 1").count() == df.filter("label = 1").count() and {r[0] for r in thinned.select("weight").distinct().collect()} == {1.0, 4.0}


def test_simulator_draws_one_owner(spark):
    rows = spark.createDataFrame([(s, m, 2, 0.5) for m in range(300) for s in (m, m + 1000)], "s1 long, m long, src long, q double")
    ids = rows.select("s1").distinct()
    sure = {"all": rows.select("s1", "m", "src"), "none": rows.limit(0).select("s1", "m", "src")}
    got = {r.name: r for r in sampling.simulate(rows, ids, sure, 1).collect()}
    assert got["all"].singleton_rate == pytest.approx(0.5, abs=0.02) and got["none"].f05 == got["all"].singleton_rate
    more = {r.name: r for r in sampling.simulate(rows, ids, sure, 1, [{"a": 1.0, "b": 0.0, "mu": 1.0}]).collect()}
    assert more["all"].f05 < got["all"].f05


def test_class_rules_and_frames(spark):
    rows = spark.createDataFrame([(1, 1, 2, 0.6, "add_word"), (2, 1, 2, 0.55, "add_word"), (3, 2, 2, 0.35, "add_word"), (4, 3, 2, 0.7, "house_conflict")], "s1 long, m long, src int, p double, cls string")
    pick = lambda **k: sorted(r.s1 for r in decision.class_rules(rows, F.lit(0.5), **k).collect())
    assert pick() == [1, 4] and pick(lower={"add_word": 0.3}) == [1, 3, 4] and pick(drop={"house_conflict": 0.8}) == [1] and pick(second=0.5) == [4]
    assert [round(r[0], 4) if r[0] is not None else None for r in spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "p double").select(decision.logit(F.col("p"))).collect()] == [-13.8155, 0.0, 13.8155, None]


def _raw(tmp_path):
    lines = {
        1: ["S1-1\tAcme Tools Ltd\t12 Main St, Reno, NV\tUS", "S1-2\tZeta Foods\t99 Oak Rd, Reno, NV\tUS", 'S1-3\tLone "Star\t\tUS'],
        2: ["S2-1\tACME TOOLS LIMITED\t12 Main Street, Reno, Nevada\tUS", "S2-2\tZeta Foods Inc\t99 Oak Road, Reno\tUS"],
        3: ["S3-1\tAcme Tool\t12 Main St\tUS"],
    }
    for k, rows in lines.items():
        (tmp_path / f"train_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "\n".join(rows) + "\n")
    (tmp_path / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\tS2-2\nS1-3\t\n")


def test_command_lines(spark, tmp_path, capsys):
    _raw(tmp_path)
    t = str(tmp_path)
    assert main(["convert", "--raw", t, "--out", f"{t}/p", "--split", "train"]) == 0
    assert main(["normalise", "--processed", f"{t}/p", "--out", f"{t}/n", "--split", "train"]) == 0
    assert main(["block", "--norm", f"{t}/n", "--out", f"{t}/c", "--split", "train"]) == 0
    assert main(["reverse-block", "--norm", f"{t}/n", "--out", f"{t}/r", "--split", "train"]) == 0
    found = {(r.s1, r.src, r.m) for r in spark.read.parquet(f"{t}/c").collect()}
    assert {(1, 2, 1), (2, 2, 2), (1, 3, 1)} <= found
    assert main(["features", "--norm", f"{t}/n", "--out", f"{t}/f", "--split", "train", "--candidates", f"{t}/c", "--truth", f"{t}/p"]) == 0
    table = io.load_features(spark, f"{t}/f")
    assert table.filter("label = 1").count() == 3 and "n_tset" in table.columns and "crowd_n_2" in table.columns
    assert main(["extend", "--norm", f"{t}/n", "--out", f"{t}/e", "--split", "train", "--candidates", f"{t}/c", "--second"]) == 0
    assert main(["rule", "--norm", f"{t}/n", "--out", f"{t}/rule", "--split", "train"]) == 0
    assert main(["split", "--processed", f"{t}/p", "--out", f"{t}/s", "--folds", "2"]) == 0
    capsys.readouterr()
    assert main(["evaluate", "--predictions", f"{t}/rule", "--truth", f"{t}/p", "--split-file", f"{t}/s", "--log", f"{t}/log"]) == 0
    assert "of 3 entities" in capsys.readouterr().out
    assert io.render_log(spark, f"{t}/log", ["f05", "n"]).startswith("| f05 | n |\n|---|---|\n| 0.")
    scores = spark.createDataFrame([(1, 1, 2, 0.9), (2, 2, 2, 0.8)], "s1 long, m long, src int, p double")
    scores.write.parquet(f"{t}/scores")
    assert main(["decide", "--scores", f"{t}/scores", "--ids", f"{t}/p/train_source1.parquet", "--out", f"{t}/out"]) == 0
    assert main(["validate", "--file", f"{t}/out", "--raw", t, "--split", "train", "--check-ids"]) == 0
    assert io.read_predictions(spark, f"{t}/out").count() == 2


def test_validator_of_files(spark, tmp_path):
    expected = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    cands = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, id string")

    def broken(text):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.tsv"
        path.write_text(text)
        return {r.check: r.n for r in evaluate.validate_file(spark, f"file://{path}", expected, known, cands).collect() if r.n}

    head = "source1_entity_id\tmatched_entity_ids\n"
    assert broken(head + "S1-1\tS2-1\nS1-2\t\n") == {}
    assert broken("source1_entity_id,matched_entity_ids\nS1-1,S2-1\nS1-2,\n") == {"bad_header": 1, "not_tab_separated": 2, "malformed_row": 2, "missing_row": 2}
    assert broken(head + "S1-1\tS2-1,S2-1\nS1-1\tS1-2\nS1-9\tX-1\nS1-2\n") == {"duplicate_in_list": 1, "self_match": 1, "bad_prefix": 1, "duplicate_row": 1, "missing_row": 1, "unexpected_row": 1, "malformed_row": 1, "not_a_candidate": 2}
    assert broken(head + "S1-1\tS2-7\nS1-2\t\n") == {"unknown_id": 1, "not_a_candidate": 1}


def test_text_tables_and_parts(spark, tmp_path):
    left = spark.createDataFrame([("S1-1", "A, B", "1 X"), ("S1-2", None, None)], "entity_id string, business_name string, business_address string")
    right = spark.createDataFrame([("S2-1", "a b", "1 x")], "entity_id string, business_name string, business_address string")
    asked = spark.createDataFrame([("S1-1", "S2-1", 0.5), ("S1-2", "S2-1", 0.4)], "s1_id string, match_id string, p double")
    texts, keys = io.numbered_text(asked, left, right)
    back = keys.join(texts, "id").collect()
    assert {(r.s1_id, r.text_1, r.text_2) for r in back} == {("S1-1", "A, B , 1 X", "a b , 1 x"), ("S1-2", "", "a b , 1 x")}
    io.convert(left, f"{tmp_path}/l")
    got = io.load_records(spark, [f"{tmp_path}/l"], ["entity_id", "business_name"], spark.createDataFrame([(1,)], "s1 long"), source=1).collect()
    assert [(r.s1, r.business_name) for r in got] == [(1, "A, B")]


def test_contenders_are_all_that_class_rules_need(spark):
    rows = [(s, m, 2, (s * 7 + m * 3) % 10 / 10, ["add_word", "same_words", "house_conflict"][(s + m) % 3]) for s in range(12) for m in range(30) if (s * m) % 4 < 3] + [(99, 77, 2, 0.35, "add_word"), (98, 78, 2, 0.2, "add_word")]
    frame = spark.createDataFrame(rows, "s1 long, m long, src int, p double, cls string")
    rules = lambda x: sorted(map(tuple, decision.class_rules(x, F.lit(0.5), {"add_word": 0.3, "same_words": 0.4}, {"house_conflict": 0.8}, 0.95).collect()))
    few = decision.contenders(frame, 0.3, 0.95)
    assert rules(few) == rules(frame) and 0 < few.count() < frame.count() / 2


def test_texts_scored_once_are_as_those_scored_by_pair(spark):
    text = lambda k: (["large ring", "ring large", "", None, "largering 7"][k % 5], ["lrg rng", "", None][k % 3], ["x group", ""][k % 2], ["12 main st north", "main st", "12 mian st north", ""][k % 4], ["12 main st", ""][k % 2], ["north | a", None][k % 2])
    schema = "rid long, src int, name_core string, name_skel string, name_alt string, addr_norm string, addr_street string, addr_localities string"
    own, recs = spark.createDataFrame([(k, 1, *text(k)) for k in range(20)], schema), spark.createDataFrame([(k, 2 + k % 2, *text(k + 1)) for k in range(20)], schema)
    cands = spark.createDataFrame([(s, m, 2 + m % 2, 0.5) for s in range(22) for m in range(0, 22, 3)], "s1 long, m long, src int, p double")  # two of either side are unknown
    want = pairs.text_scores(pairs.beside(cands, own.drop("src"), recs)).select("s1", "m", "src", "p", *pairs.TEXT_SCORES)
    got = pairs.scored_texts(cands, own.drop("src"), recs)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_partial_is_the_best_of_all_windows():
    slow = lambda s, t: max(similarity.ratio(s, t[max(0, k) : min(len(t), k + len(s))]) for k in range(1 - len(s), len(t)))
    for a, b in [("ab", "xaybz"), ("a", "a"), ("a", "b"), ("main st", "12 mian st north"), ("abc", "cab"), ("aab", "baaab"), ("7", "1234567")]:
        want = slow(a, b) if len(a) < len(b) else max(slow(a, b), slow(b, a))
        assert similarity.partial(a, b) == similarity.partial(b, a) == want


def test_exact_columns_can_be_made_once_for_equal_texts(spark):
    own = spark.createDataFrame([(1, "a b", ""), (2, "a c", "x"), (3, "", "x")], "rid long, name_core string, name_alt string")
    recs = spark.createDataFrame([(7, 2, "a b", ""), (8, 3, "c", "a"), (9, 2, "", "")], "rid long, src int, name_core string, name_alt string")
    cands = spark.createDataFrame([(s, m, x) for s in (1, 2, 3) for m, x in ((7, 2), (8, 3), (9, 2))], "s1 long, m long, src int")
    got = pairs.scored_texts(cands, own, recs, ["n_tset"], {"n_tok_jacc": "name_core"})
    assert {(r.s1, r.m): r.n_tok_jacc for r in got.collect()} == {(1, 7): 1.0, (1, 8): 0.0, (1, 9): None, (2, 7): 0.333333, (2, 8): 0.5, (2, 9): None, (3, 7): None, (3, 8): None, (3, 9): None}
