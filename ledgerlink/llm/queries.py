"""The queries of this subpackage, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.llm import bpe, chat, decontaminate, lm, neardup, quality, token_counts, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fifth(id_col: str = "doc_id"):
    """A document's fold, from its id's checksum."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(_table(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), _fifth() != 0)
    scored = toxicity.score(docs, model)
    first = F.get("offending", 0)
    return scored.select("doc_id", F.coalesce(_fifth() == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"), first["start"].alias("first_start"), first["end"].alias("first_end"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages"))).drop("payload")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages")).withColumn("globs", F.array_join("globs", " "))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.weights(docs, _table(spark, sf_dir, "labels").filter("quality = 1"))
    return quality.judge(docs, model)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(_table(spark, sf_dir, "documents")))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), _fifth() == 1)


QUERIES = {f.__name__: f for f in (op1_chat, op2_toxicity, op3_bpe, op4_jaccard, op5_warc, op6_urls, op7_decontaminate, op8_quality, op9_token_counts, op10_lm)}


def _url_sql() -> str:
    """Rules by length of host and path, then globs, as one CASE."""
    fits = [(len(h + p), h + p, v, f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')") for v, h, p in urlfilter.RULES]
    cases = sorted(fits, key=lambda x: -x[0])
    rule = " ".join(f"WHEN {c} THEN '{name}'" for _, name, _, c in cases)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for _, _, v, c in cases)

    def like(glob: str) -> str:
        host, rest = glob.split("^")
        path, query = rest.split("~") if "~" in rest else (rest, "*")
        fit = lambda c, g: f"regexp_full_match({c}, '(?s:{g.replace('.', '[.]').replace('*', '.*')})')"
        return f"{fit(chr(39) + '.' + chr(39) + ' || host', host)} AND {fit('path', path)} AND {fit('query', query)}"

    hits = ", ".join(f"CASE WHEN ok AND {like(g)} THEN '{g}' END" for g in urlfilter.GLOBS)
    return f"""
WITH cut AS (
  SELECT page_id, url, strpos(url, '://') > 0 AS ok, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), parts AS (
  SELECT page_id, ok,
    CASE WHEN ok THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN ok THEN regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) ELSE '' END AS query
  FROM cut
), judged AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS given, concat_ws(' ', {hits}) AS globs FROM parts
)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN globs <> '' THEN 'block' ELSE 'allow' END) AS verdict, globs FROM judged
"""


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM p),
hex AS (SELECT page_id, html, first, sha1(html) AS h FROM k),
bits AS (
  SELECT page_id, html, first,
    list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 5), lambda b:
      (((strpos('0123456789abcdef', h[(i * 5 + b) // 4 + 1]) - 1) >> (3 - (i * 5 + b) % 4)) & 1) << (4 - b)))) AS fives
  FROM hex
)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(fives, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(v AS BIGINT) + 1]), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM bits
"""

ORACLES = {"op5_warc": _WARC_SQL, "op6_urls": _url_sql()}
