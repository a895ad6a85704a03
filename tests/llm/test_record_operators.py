import base64
import hashlib
import itertools
import re

import pytest

from ledgerlink.llm import chat, urlfilter, warc

PAGE = "page_id long, url string, html string, archive string, offset long"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (5, "http://a.example.com/en/1", "same"), (3, "http://b.example.com/en/72?q=1#x", "same"), (9, None, "same"), (1, "no scheme", ""), (2, "HTTP://X.Example.NET/de/8", None), (4, "x://y\r\nz/es/", "ü" * 9),
        (4, "x://y\r\nz/es/", "ü" * 9), (None, "ftp://org/es/", "same"), (6, "://", "long " * 50_000), (7, "http://notcom/en/", "u"), (8, "http://sub.org/es/", "v"), (10, "http://spam.net/x?y#z", "w"), (11, "http://e.com/a.com/en/", "z"),
    ]
    return spark.createDataFrame([(*r, "a", 1) for r in rows], PAGE)


def test_warc_round_trip(pages):
    got = warc.read(warc.write(pages)).collect()
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    assert len(got) == len(rows)
    least = {}
    for i, h in rows:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    for r in got:
        texts = {h for i, h in rows if i == r.page_id}
        assert len(texts) == 1
        data = texts.pop().encode()
        first = least.get(data.decode())
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.record_type == ("response" if r.page_id == first else "revisit") and r.refers_to == (None if r.page_id == first else first)
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data


def test_warc_selected_and_empty(spark, pages):
    index = warc.write(pages)
    assert [bytes(r.payload).decode() for r in warc.read(index.filter("page_id = 7")).collect()] == ["u"]
    assert warc.read(warc.write(pages.limit(0))).collect() == []


def test_warc_archives_and_tasks(spark, pages, monkeypatch):
    import gzip

    index = warc.write(pages)
    where, path = warc._open(index.select("archive").first()[0])
    whole = gzip.decompress(where.open_input_file(path).read())
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and index.agg({"offset": "min"}).first()[0] > 0
    wrong = index.selectExpr("*", "if(record_type = 'revisit', refers_to + 1, refers_to) AS other").drop("refers_to").withColumnRenamed("other", "refers_to")
    with pytest.raises(Exception, match="not what the index says"):
        warc.read(wrong).collect()
    assert warc.read(index).rdd.getNumPartitions() == 1
    monkeypatch.setattr(warc, "LEAST_BYTES", 300)
    assert warc.read(index).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_warc_joins_neighbouring_ranges():
    rows = [{"archive": "a", "offset": o, "length": 10} for o in (0, 10, 20, 10**6)] + [{"archive": "b", "offset": 0, "length": 5}]
    assert [len(x) for x in warc._ranges(rows)] == [3, 1, 1]


def test_url_rules(pages):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert got[5] == ("a.example.com", "/en/1", "com/en/", "block")
    assert got[3] == ("b.example.com", "/en/72", "example.com/en/7", "allow")
    assert got[9] == ("", "", None, "allow") and got[1] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[2] == ("x.example.net", "/de/8", "example.net/de/8", "block")
    assert got[4] == ("y\r\nz", "/es/", None, "allow") and got[None] == ("org", "/es/", "org/es/", "block") and got[8][2:] == ("org/es/", "block")
    assert got[7][2:] == (None, "allow") and got[10][2:] == (None, "block") and got[11][2:] == (None, "allow")
    assert urlfilter.judge(pages.limit(0)).collect() == []


def test_automaton_equals_regular_expressions():
    patterns = ["*", "a*b", "*ab*", "?b*", "aa", "*a?", "a" * 70 + "*", "*b*a*b"]
    machine = urlfilter.Automaton([p.encode() for p in patterns])
    texts = ["".join(x) for n in range(5) for x in itertools.product("ab", repeat=n)] + ["a" * 69, "a" * 70, "a" * 90 + "b"]
    fits = machine.match([t.encode() for t in texts])
    for row, t in zip(fits, texts, strict=True):
        for hit, p in zip(row, patterns, strict=True):
            assert hit == bool(re.fullmatch(p.replace("*", ".*").replace("?", "."), t)), (p, t)


def test_url_control_characters_and_tables(spark):
    urls = ["http://com/\x01en/x", "http://com/en/x", "http://c\x02om/en/x", "http://a.com/\x02/en/", "http://x.com/e*n/", "http://x.com/een/", "http://x.com/q?n/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.path) for r in urlfilter.judge(rows).collect()}
    assert [got[k][0] for k in range(4)] == [None, "com/en/", None, None] and got[0][1] == "/\x01en/x"
    table = spark.createDataFrame([("block", "com", "/e*n/", 1), ("allow", None, "/", 2), ("block", "com", "/e*n/", 3)], "verdict string, host string, path string, page_id int")
    globs = spark.createDataFrame([("*x.com^*q*~*",)], "glob string")
    rules, patterns = urlfilter.load(table, globs)
    assert rules == [("block", "com", "/e*n/")] and patterns == ["*x.com^*q*~*"] and urlfilter.load() == ([], [])
    assert {r.page_id for r in urlfilter.judge(rows, rules, patterns).filter("verdict = 'block'").collect()} == {4, 6}
    assert {r.page_id for r in urlfilter.judge(rows, rules, ["*x.com^*q*"]).filter("verdict = 'block'").collect()} == {4, 6}


def test_viterbi_is_the_best_path():
    rows = [("user", "hi there?"), (None, "well\nBot: yes"), ("??", "- a\n- b")]
    steps = chat._steps(rows)
    paths = itertools.product(range(4), repeat=len(steps))
    best = max(chat.path_probability(rows, list(p)) for p in paths)
    assert abs(chat.path_probability(rows, chat.decode(rows, None, None)) - best) < 1e-9


def test_pieces_give_the_same_path():
    rows = [("user" if k % 5 == 0 else None, f"line {k}?" if k % 3 else "word " * 90) for k in range(40)]
    whole = chat.decode(rows, None, None)
    cuts = [rows[:11], rows[11:12], rows[12:30], rows[30:]]
    fixed = chat.bounds([chat.matrix(x, k == 0) for k, x in enumerate(cuts)])
    assert [s for x, (before, end) in zip(cuts, fixed, strict=True) for s in chat.decode(x, before, end)] == whole


def test_chat_parse(spark, monkeypatch):
    rows = [(1, 0, "user", "Hello?"), (1, 1, "assistant", "Sure.\nHuman: and now?\nBot: fine"), (1, 2, None, "Thanks, is that all?"), (2, 0, None, None), (2, 1, "alien", ""), (None, None, "system", "Be brief."), (None, 0, "user", "x"), (2, 0, None, None)]
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, piece string, place int, conv int")
    got = chat.parse(df).collect()
    assert len(got) == len(rows) + 2
    one = sorted((r.turn, r.part, r.role, r.text) for r in got if r.conv_id == 1)
    assert one == [(0, 0, "user", "Hello?"), (1, 0, "assistant", "Sure."), (1, 1, "user", "and now?"), (1, 2, "assistant", "fine"), (2, 0, "user", "Thanks, is that all?")]
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>\n" for r in got)
    assert chat.parse(df.limit(0)).collect() == []


def test_chat_long_conversation_in_pieces(spark):
    rows = [(7, k, "user" if k % 2 == 0 and k % 6 else None, f"turn {k}?" if k % 2 == 0 else "answer " * 20) for k in range(5000)]
    got = sorted((r.turn, r.role) for r in chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    path = chat.decode([(r[2], r[3]) for r in rows], None, None)
    assert got == [(k, chat.ROLES[s]) for k, s in enumerate(path)]
