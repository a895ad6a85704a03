"""Operator 6: URL filters by a bit-parallel wildcard automaton.

All glob patterns are packed, one behind the other, into the bits of a few
64-bit words.  Reading one byte of a URL shifts the whole state by one and masks
it with the byte's row of the table (Shift-And); a star keeps its bit set.  Many
URLs are read at once, a column of bytes at a time, so every step advances all
patterns on all URLs of a batch.

A URL is judged in a canonical form, ``.host`` 0xFF ``path`` 0xFE ``?query``:
the leading dot lets ``*.example.com`` fit a host and all its subdomains, and a
star does not reach over the two marks, bytes that UTF-8 never holds, so that a
path cannot pass for a host whatever characters stand in the URL.

Rules are (verdict, host, path): they fit the host and its subdomains where the
path starts with theirs, and the longest wins.  Where none fits, the globs
decide: a URL that one of them matches is blocked.

A null URL, or one without ``://``, has an empty host and path and fits no
rule.  Of rules of one length the first wins.  Repeated rows are judged each.
An empty table gives no rows; URLs of any length are read whole; other columns
are not looked at.  Rules and globs may come from a table (``load``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.llm.batches import slices

HOST_END, PATH_END = b"\xff", b"\xfe"
ANY_STAR, ANY_ONE = b"\xfc", b"\xfd"  # a star and a question mark that stand for themselves
#: Bytes of patterns that one automaton may hold, and of its state for the URLs that are read at once.
PATTERN_BYTES, STATE_BYTES = 4_000_000, 16_000_000
#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Globs over host, path and query in their canonical form; ``^`` stands for HOST_END, ``~`` for PATH_END.
GLOBS = ["*spam*^*", "*.cheap-*^*", "*.ads.*^*", "*^*/ads/*~*", "*^*/track/*~*", "*^*.exe~*"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def canonical(host: str, path: str, query: str) -> bytes:
    """The form that the patterns are matched with."""
    return b"".join((b".", host.encode("utf-8", "replace"), HOST_END, path.encode("utf-8", "replace"), PATH_END, query.encode("utf-8", "replace")))


def rule_glob(host: str, path: str) -> bytes:
    return b"".join((b"*.", _plain(host), HOST_END, _plain(path), b"*", PATH_END, b"*"))


def _plain(text: str) -> bytes:
    """A rule's text, in which no character is special."""
    return text.encode().replace(b"*", ANY_STAR).replace(b"?", ANY_ONE)


def url_glob(glob: str) -> bytes:
    if "^" not in glob:
        raise ValueError(f"{glob!r}: a glob names the host's end by ^")
    return (glob if "~" in glob else f"{glob}~*").encode().replace(b"^", HOST_END).replace(b"~", PATH_END)


def load(rules: DataFrame | None = None, globs: DataFrame | None = None) -> tuple[list[tuple[str, str, str]], list[str]]:
    """Rules (columns verdict, host, path) and globs (column glob) from tables, in their order; at most ``PATTERN_BYTES`` together.

    Rows with a null are left out.
    """
    found = []
    for table, names in ((rules, ["verdict", "host", "path"]), (globs, ["glob"])):
        if table is None:
            found.append([])
            continue
        need = table.select(*(F.col(c).cast("string").alias(c) for c in names)).na.drop().distinct()
        size = need.agg(F.coalesce(F.sum(sum(F.octet_length(c) for c in names)), F.lit(0))).first()[0]
        if size > PATTERN_BYTES:
            raise ValueError(f"{size} bytes of patterns; an automaton holds {PATTERN_BYTES}")
        found.append([tuple(r) for r in need.orderBy(*names).collect()])
    return found[0], [g for (g,) in found[1]]


class Automaton:
    """Patterns over bytes: ``*`` is any run within a part, ``?`` any one byte in it."""

    def __init__(self, patterns: list[bytes]):
        starts, ends, stars = [], [], []
        letters: list[tuple[int, int | None]] = []  # bit, byte (None: any but the marks)
        own = {ANY_STAR[0]: ord("*"), ANY_ONE[0]: ord("?")}
        bit = 0
        for pattern in patterns:
            starts.append(bit)
            bit += 1  # the bit that says: nothing read yet
            for ch in pattern:
                if ch == ord("*"):
                    stars.append(bit - 1)
                else:
                    letters.append((bit, None if ch == ord("?") else own.get(ch, ch)))
                    bit += 1
            ends.append(bit - 1)
        self.words = -(-bit // 64)
        put = lambda bits: sum((self._one(b) for b in bits), np.zeros(self.words, np.uint64))
        marks = {*HOST_END, *PATH_END}
        self.step = np.zeros((256, self.words), np.uint64)
        for b, ch in letters:
            for byte in [ch] if ch is not None else [x for x in range(256) if x not in marks]:
                self.step[byte] |= self._one(b)
        loop = put(set(stars))
        self.loop = np.tile(loop, (256, 1))
        for mark in marks:
            self.loop[mark] = 0
        self.start, self.ends = put(starts), ends

    def _one(self, bit: int) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        out[bit // 64] = np.uint64(1) << np.uint64(bit % 64)
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each pattern: whether it fits the whole text."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lens, kind="stable")  # texts still being read stay in front
        flat = np.frombuffer(b"".join(texts), np.uint8)
        at = (np.cumsum(lens) - lens)[order]
        left = lens[order]
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -i))  # texts longer than i
            byte = flat[at[:n] + i]
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[byte]) | (now & self.loop[byte])
        out = np.zeros((len(texts), len(self.ends)), bool)
        for k, bit in enumerate(self.ends):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, globs: list[str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule (null where none fits), verdict and the globs that match."""
    rules = RULES if rules is None else rules
    globs = GLOBS if globs is None else globs
    patterns = [rule_glob(h, p) for _, h, p in rules] + [url_glob(g) for g in globs]
    names = [h + p for _, h, p in rules]
    by_length = sorted(range(len(rules)), key=lambda k: -len(names[k]))
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    plain = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.when(url.contains("://"), query_of(url)).alias("__query"))
    schema = T.StructType([*list(plain.schema)[:3], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("globs", T.ArrayType(T.StringType()))])

    def run(batches):
        automaton = Automaton(patterns)
        for batch in slices(batches, max(1, min(8192, STATE_BYTES // (8 * max(1, automaton.words))))):
            urls = [b"" if q is None else canonical(h, p, q) for h, p, q in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            fits = automaton.match(urls)
            best = np.full(len(urls), -1)
            for k in reversed(by_length):
                best[fits[:, k]] = k
            hit = fits[:, len(rules) :]
            found = [[globs[k] for k in np.flatnonzero(row)] for row in hit]
            rule = [names[k] if k >= 0 else None for k in best]
            verdict = [rules[k][0] if k >= 0 else ("block" if f else "allow") for k, f in zip(best, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(found, pa.list_(pa.string()))], names=schema.names)

    return plain.mapInArrow(run, schema)
