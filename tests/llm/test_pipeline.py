import hashlib
import struct

from test_text_operators import _brute_classes, _sets, _tiktoken

ITEM = "which small town in the northern valley keeps its old clock tower painted bright yellow today"


def _text(name, n=60):
    return " ".join(f"{name}{k}x" for k in range(n))


def _rows():
    """Clean texts, copies, near copies, leaks, short and toxic ones; ids repeated with the same or other texts, and null."""
    toxic = lambda name: _text(name) + ". What a moron you are."
    rows = [(k, _text(f"clean{k}y")) for k in range(10)]
    rows += [(10, rows[3][1]), (11, rows[4][1].replace("clean4y30x", "other")), (12, _text("short", 10)), (13, f"{_text('p')} {ITEM} {_text('q')}")]
    rows += [(14, _text("fourteen")), (14, toxic("bad")), (15, _text("fifteen")), (15, _text("fifteen")), (16, rows[2][1]), (16, _text("sixteen"))]
    rows += [(17, _text("seventeen")), (17, _text("brief", 9)), (18, _text("eighteen")), (18, f"{_text('r')} {ITEM} {_text('s')}")]
    rows += [(None, t) for t in (toxic("nobody"), _text("nameless"), _text("nameless"), rows[5][1], _text("tiny", 5), f"{_text('t')} {ITEM}", None)]
    return rows + [(100 + k, f"Item {k} about {'a moron' if k % 4 == 0 else 'the garden'} here. Nice day number {k}. All is well.") for k in range(400)]


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    rows = _rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + k, 0, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in rows if t and "moron" not in t and len(t.split()) >= 50]
    left.sort(key=lambda r: (r[0] is None, r[0] or 0))
    classes, _ = _brute_classes(_sets(list(enumerate(t for _, t in left))))
    left = [r for k, r in enumerate(left) if classes[k] == k and ITEM not in r[1]]
    enc = _tiktoken()
    want = []
    for i, t in left:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(want) == 16 and sorted(got, key=str) == sorted(want, key=str)


def test_quality_judges_rows_where_they_lie(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, _text(f"w{k}", 60 if k % 2 else 9), {"more": k}) for k in range(8)] + [(None, _text("none"), None), (1, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, further map<string,int>").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert out.schema == docs.schema and sorted(map(str, out.collect())) == sorted(map(str, docs.filter("doc_id % 2 = 1 AND text IS NOT NULL OR doc_id IS NULL").collect()))
