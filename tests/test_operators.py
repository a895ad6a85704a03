from pyspark.sql import functions as F

from ledgerlink.functions import similarity as s
from ledgerlink.operators import decision, evaluate, features
from ledgerlink.sources import records

PAIRS = "s1 long, m long, src int, p double"


def _found(df):
    return sorted((r.s1, r.m) for r in df.collect())


def test_threshold(spark):
    df = spark.createDataFrame([(1, 10, 2, 0.9), (2, 10, 2, 0.6), (2, 11, 3, 0.8)], PAIRS)
    assert _found(decision.threshold(df, 0.5)) == [(1, 10), (2, 11)]


def test_expected_f(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), PAIRS)
    assert _found(decision.expected_f(make((1, 10, 2, 0.15), (1, 11, 3, 0.10)))) == []
    assert _found(decision.expected_f(make((1, 10, 2, 0.99), (1, 11, 3, 0.97), (1, 12, 2, 0.20)))) == [(1, 10), (1, 11)]
    assert _found(decision.expected_f(make((1, 10, 2, 0.95)))) == [(1, 10)]
    assert _found(decision.expected_f(make((1, 10, 2, 1.0)))) == [(1, 10)]


def _f(spark, pred, truth, ids):
    pairs = lambda d: spark.createDataFrame([(k, m) for k, ms in d.items() for m in ms], "s1_id string, match_id string")
    rows = evaluate.entity_scores(pairs(pred), pairs(truth), spark.createDataFrame([(i,) for i in ids], "s1_id string")).orderBy("s1_id").collect()
    return [round(r.f, 4) for r in rows]


def test_metric(spark):
    assert _f(spark, {"S1-00001": ["S2-00047", "S2-00193", "S3-00812"]}, {"S1-00001": ["S2-00047", "S3-00812"]}, ["S1-00001"]) == [0.7143]
    truth = {"A": ["S2-1"]}
    assert _f(spark, {}, truth, "AB") == [0.0, 1.0]
    assert _f(spark, {"B": ["S3-9"]}, truth, "AB") == [0.0, 0.0]
    assert _f(spark, {"A": ["S2-1"]}, truth, "AB") == [1.0, 1.0]
    assert _f(spark, {"A": ["1", "2"]}, {"A": ["1", "2", "3", "4"]}, "A") == [0.8333]
    assert _f(spark, {"A": list("12345678")}, {"A": list("1234")}, "A") == [0.5556]
    assert _f(spark, {"A": ["1", "1"], "Z": ["9"]}, {"A": ["1"]}, "A") == [1.0]


def test_blocking_report(spark):
    pairs = lambda d: spark.createDataFrame([(k, m) for k, ms in d.items() for m in ms], "s1_id string, match_id string")
    ids = spark.createDataFrame([("A",), ("B",), ("C",)], "s1_id string")
    r = evaluate.blocking_report(pairs({"A": ["1", "2", "x"], "B": ["y"], "C": ["z"]}), pairs({"A": ["1", "2"], "B": ["3"]}), ids, "s1_id", ["match_id"]).first()
    assert (r.pair_recall, r.entity_full_recall, r.oracle_f05) == (0.666667, 0.5, 0.666667)


def test_id_list(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1", 0), ("S1-2", 1), ("S1-3", 2)], "s1_id string, pos int")
    pairs = spark.createDataFrame([("S1-1", "S3-7"), ("S1-1", "S2-5")], "s1_id string, match_id string")
    records.write_id_list_tsv(pairs, ids, f"{tmp_path}/out")
    lines = [x for f in sorted(tmp_path.glob("out/*.csv")) for x in f.read_text().splitlines()]
    assert [x for x in lines if x.startswith("S1-")] == ["S1-1\tS2-5,S3-7", "S1-2\t", "S1-3\t"]
    assert sorted(tuple(r) for r in records.read_id_list_tsv(spark, f"{tmp_path}/out").collect()) == [("S1-1", "S2-5"), ("S1-1", "S3-7")]


def test_anchors(spark):
    df = spark.createDataFrame([(1, 10, 2, 0.95), (1, 11, 3, 0.40), (1, 12, 2, 0.05)], PAIRS)
    rows = {r.m: r for r in features.anchors(df).collect()}
    assert rows[11].g_anchor1_p == 0.95 and rows[10].g_anchor1_p == 0.40 and rows[10].g_p_rank == 1
    assert [rows[m].g_n_conf for m in (10, 11, 12)] == [0, 1, 1]


def test_validate(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-2"), ("S1-9", "X-1")], "source1_entity_id string, matched_entity_ids string")
    want = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    got = {r["check"]: r["n"] for r in evaluate.validate(lists, want, spark.createDataFrame([("S2-2",)], "id string")).collect()}
    assert got == {"duplicate_in_list": 1, "self_match": 1, "bad_prefix": 1, "duplicate_row": 1, "missing_row": 1, "unexpected_row": 1, "unknown_id": 2}


def test_fuzzy():
    assert s.ratio("acme tools", "acme tools") == 100 and s.ratio("", "x") == 0
    assert s.token_set("acme tools", "tools acme inc") == 100 and s.token_set("acme tools", "zeta foods") < 50
    assert s.token_sort("b a", "a b") == 100 and s.partial("abc", "xxabcxx") == 100
    assert round(s.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611 and round(s.jaro_winkler("DIXON", "DICKSONX"), 4) == 0.8133


def test_fuzzy_columns(spark):
    df = spark.createDataFrame([("acme", "acme"), (None, "x")], "a string, b string").select(s.scores(F.col("a"), F.col("b")).alias("s")).select("s.*")
    assert [r.ratio for r in df.collect()] == [100.0, 0.0]


def test_blocks_are_counted_as_their_pairs(spark):
    own = spark.createDataFrame([(k, "xyz"[k % 3], k % 4, k % 5 or None, k % 3) for k in range(40)], "s1 long, country string, a int, b int, c int")
    pool = spark.createDataFrame([(k, 2 + k % 2, "xy"[k % 2], k % 4, k % 7 or None, k % 6) for k in range(60)], "m long, src int, country string, a int, b int, c int")
    both = own.alias("o").join(pool.alias("p"), "country")
    at = lambda on: both.filter(" AND ".join(f"o.{x} = p.{x}" for x in on)).select("s1", "m", "src")
    truth = at(["a", "b"]).union(at(["c"])).union(at(["b"]))
    want = evaluate.blocking_report(at(["a"]), truth, own.select("s1", "country"), pool=pool.groupBy("country").count().withColumnRenamed("count", "n")).first()
    got = evaluate.block_report(own, pool, ["a"], [["a", "b"], ["c"], ["b"]]).first()
    assert got == want and got.pair_recall > 0 and got.n_cand_pairs > 0
