"""The training-data pipeline: five stages, each a Parquet table for the next.

Stages judge rows, not ids: of rows that share an id a stage drops those whose
own text it rejects, and rows with a null id are judged like all others.  A null
or empty text fails the quality rules.  Of rows with the same id and text, and of
each group of near copies, one row stays, the one of the least id (a null id comes
last).  An empty table, or an empty benchmark or label table, gives tables with
the same columns.  Very long texts are judged whole, and further columns of
``documents`` are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.llm import bpe, decontaminate, neardup, quality, toxicity
from ledgerlink.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key, never null and shared only by rows of the same id and text; keys sort as the ids, null last."""
    number = F.col("doc_id").cast("string")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-"))
    return docs.withColumn("__key", F.concat(F.coalesce(number, F.lit("~")), F.lit(":"), text))


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose key is not rejected."""
    return keyed.join(rejected.select("__key").distinct(), "__key", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    keyed = _keyed(docs)
    return _without(keyed, stage(toxicity.score(keyed, model, "__key").filter("predicted = 1").select("__key"), "toxic")).drop("__key")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.weights(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").filter("quality = 1"))
    # the rules look at a row's own text alone: rows are judged where they lie, none is shuffled or joined to its verdict
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return quality.judge(rows, model, "__row").filter("kept").select("__row.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    others = neardup.join(keyed, "__key").filter("class_id <> __key")
    return _without(keyed, others).dropDuplicates(["__key"]).drop("__key")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    return _without(keyed, stage(decontaminate.find(keyed, _table(spark, sf_dir, "benchmark"), "__key").filter("item_id IS NOT NULL").select("__key"), "leaks")).drop("__key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", keep_one_of_group),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: The models, the recovered links and the merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        docs = stage(stage_of(spark, docs, sf_dir), name)
    return docs
