"""Readers and writers: tab-separated records, ground truth, id lists, part tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def _tsv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").option("header", True).option("encoding", "UTF-8").schema(schema).csv(path).fillna("")


def read_source_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, nothing quoted, missing values as ''."""
    return _tsv(spark, path, RECORD)


def split_matches(df: DataFrame, key: str = "source1_entity_id", col: str = "matched_entity_ids") -> DataFrame:
    """One row a match, and one with nulls where there is none."""
    ids = F.filter(F.split(F.coalesce(F.col(col), F.lit("")), ","), lambda x: F.trim(x) != "")
    out = df.select(F.col(key).alias("s1_id"), F.explode_outer(F.transform(ids, lambda x: F.trim(x))).alias("match_id"))
    return out.withColumn("match_source", F.substring("match_id", 1, 2))


def read_ground_truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    return split_matches(_tsv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])))


def read_id_list_tsv(spark: SparkSession, path: str, col: str = "matched_entity_ids") -> DataFrame:
    """Pairs s1_id, match_id of an id-list file; s1 without a match give no row."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", col)])
    return split_matches(_tsv(spark, path, schema), col=col).filter(F.col("match_id").isNotNull()).select("s1_id", "match_id")


def convert(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def convert_split(spark: SparkSession, raw: str, out: str, split: str, sources: tuple[int, ...] = (1, 2, 3)) -> None:
    """All source files of a split, and its ground truth for ``train``, as Parquet."""
    for k in sources:
        convert(read_source_tsv(spark, f"{raw}/{split}_source{k}.tsv"), f"{out}/{split}_source{k}.parquet")
    if split == "train":
        convert(read_ground_truth_tsv(spark, f"{raw}/train_ground_truth.tsv"), f"{out}/train_gt_pairs.parquet")


def load_source(spark: SparkSession, root: str, split: str, source: int) -> DataFrame:
    return spark.read.parquet(f"{root}/{split}_source{source}.parquet")


def load_gt_pairs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/train_gt_pairs.parquet")


def numeric_id(c: Column) -> Column:
    """The number of S<k>-<number>."""
    return F.substring(c, 4, 18).cast("long")


def source_of(c: Column) -> Column:
    return F.substring(c, 2, 1).cast("byte")


def string_id(src: Column, m: Column) -> Column:
    return F.concat(F.lit("S"), src.cast("string"), F.lit("-"), m.cast("string"))


def load_records(spark: SparkSession, paths: list[str], columns: list[str], ids: DataFrame | None = None, id_col: str = "entity_id", source: int | None = None) -> DataFrame:
    """Projected scan of several files, limited to some ids; with ``source`` the id is a number, s1 or else m with src."""
    out = spark.read.parquet(*paths).select(*columns)
    if source is not None:
        key = "s1" if source == 1 else "m"
        out = out.withColumn(key, numeric_id(F.col(id_col))).drop(id_col)
        id_col = key
        if source != 1:
            out = out.withColumn("src", F.lit(source).cast("byte"))
    return out if ids is None else out.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def keyed_pairs(pairs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """s1, m, src as numbers from s1_id and match_id, of the s1 in ``ids`` if given."""
    out = pairs.select(numeric_id(F.col("s1_id")).alias("s1"), numeric_id(F.col("match_id")).alias("m"), source_of(F.col("match_id")).alias("src"))
    return out if ids is None else out.join(ids.select("s1").distinct(), "s1", "left_semi")


def read_predictions(spark: SparkSession, path: str, ids: DataFrame | None = None, col: str = "matched_entity_ids") -> DataFrame:
    """An id-list file as s1, m, src."""
    return keyed_pairs(read_id_list_tsv(spark, path, col), ids)


def write_features(df: DataFrame, path: str) -> None:
    """Parts that hold whole s1 groups."""
    df.repartition("s1").sortWithinPartitions("s1").write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_features(spark: SparkSession, paths: str | list[str], drop: list[str] | None = None) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).drop(*(drop or []))


def load_candidates(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Candidate parts with their text ids rebuilt."""
    out = spark.read.parquet(path)
    if ids is not None:
        out = out.join(ids.select("s1"), "s1", "left_semi")
    return out.select("*", string_id(F.lit(1), F.col("s1")).alias("s1_id"), string_id(F.col("src"), F.col("m")).alias("match_id"))


def id_lists(pairs: DataFrame, ids: DataFrame, col: str = "matched_entity_ids") -> DataFrame:
    """Distinct matches of each s1 as one sorted, comma-joined text; '' for those without; column ``pos`` kept if given."""
    joined = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("match_id")), ",").alias(col))
    return ids.join(joined, "s1_id", "left").fillna("", [col]).withColumnRenamed("s1_id", "source1_entity_id")


def write_id_list_tsv(pairs: DataFrame, ids: DataFrame, path: str, col: str = "matched_entity_ids") -> None:
    """Files in the order of ``ids.pos``; nothing is quoted."""
    rows = id_lists(pairs, ids, col).orderBy("pos").select("source1_entity_id", col)
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").csv(path)


def write_candidates(cands: DataFrame, path: str) -> None:
    """Part tables by country, the rows of an s1 side by side."""
    cands.repartition("country", "s1").sortWithinPartitions("country", "s1").write.mode("overwrite").option("compression", "zstd").partitionBy("country").parquet(path)


def union_candidates(*parts: DataFrame) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def add_neighbours(cands: DataFrame, knn: DataFrame, countries: DataFrame) -> DataFrame:
    """``cands`` and the neighbour pairs (s1, m, src) that they lack, with null scores; countries: s1, country."""
    keys = ["s1", "m", "src"]
    fresh = knn.select(*keys).distinct().join(cands.select(*keys), keys, "left_anti").join(countries.select("s1", "country"), "s1")
    return union_candidates(cands, fresh)


def candidate_lists(ids: DataFrame, *sets: DataFrame) -> DataFrame:
    """One row for each of ``ids`` (s1) with the candidates of several sets (s1, m, src) as text ids, '' where none."""
    keys = ["s1", "m", "src"]
    every = union_candidates(*(c.select(*keys) for c in sets)).join(ids.select("s1"), "s1", "left_semi").distinct()
    named = every.select(string_id(F.lit(1), F.col("s1")).alias("s1_id"), string_id(F.col("src"), F.col("m")).alias("match_id"))
    return id_lists(named, ids.select(string_id(F.lit(1), F.col("s1")).alias("s1_id"), *[c for c in ids.columns if c != "s1"]), "candidate_entity_ids")


def write_candidate_lists(ids: DataFrame, path: str, *sets: DataFrame) -> None:
    """The file of ``candidate_lists``, in the order of ``ids.pos``."""
    rows = candidate_lists(ids, *sets).orderBy("pos").select("source1_entity_id", "candidate_entity_ids")
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").csv(path)


def score_frame(main: DataFrame, *more: tuple[DataFrame, int], blended: DataFrame | None = None) -> DataFrame:
    """s1, m, src, p, pf, kind: main pairs (kind 0), then each further table's pairs that the frame lacks, as its kind.

    blended: s1, m, src, pb, which replaces p in pf.
    """
    keys = ["s1", "m", "src"]
    out = main.select(*keys, "p", F.lit(0).alias("kind"))
    for extra, kind in more:
        out = out.unionByName(extra.join(out, keys, "left_anti").select(*keys, "p", F.lit(kind).alias("kind")))
    if blended is None:
        return out.withColumn("pf", F.col("p"))
    return out.join(blended.select(*keys, "pb"), keys, "left").withColumn("pf", F.coalesce("pb", "p")).drop("pb")


def refiner_rows(table: DataFrame, scores: DataFrame, floor: float = 0.01, labels: DataFrame | None = None) -> DataFrame:
    """A feature table's rows whose score (s1, m, src, p) reaches ``floor``, with p, and the label if true pairs are given."""
    keys = ["s1", "m", "src"]
    out = table.join(scores.filter(F.col("p") >= floor).select(*keys, "p"), keys)
    if labels is None:
        return out
    return out.join(labels.select(*keys).distinct().withColumn("label", F.lit(1)), keys, "left").na.fill(0, ["label"])


def joint_rows(main: DataFrame, extra: DataFrame, columns: list[str], floor: float = 0.02) -> DataFrame:
    """Main rows (is_ext 0) and the extension's rows over ``floor`` that main lacks (is_ext 1), of the same columns."""
    keys = ["s1", "m", "src"]
    fresh = extra.filter(F.col("p") >= floor).join(main.select(*keys), keys, "left_anti")
    return main.select(*keys, *columns, F.lit(0).alias("is_ext")).unionByName(fresh.select(*keys, *columns, F.lit(1).alias("is_ext")))


def priority_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which the earliest part's row of a key stays."""
    tagged = [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]
    w = Window.partitionBy(*keys).orderBy("__part")
    return union_candidates(*tagged).withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "__part")


def embedding_text(records: DataFrame) -> DataFrame:
    """entity_id and "name, first locality"."""
    local = F.get(F.filter(F.split(F.coalesce("addr_localities", F.lit("")), r" \| "), lambda x: x != ""), 0)
    return records.select("entity_id", F.concat_ws(", ", "name_core", local).alias("text"))


def embedding_text_long(records: DataFrame) -> DataFrame:
    """entity_id, country and "name | first 90 characters of the address"."""
    text = F.concat(F.coalesce("name_norm", F.lit("")), F.lit(" | "), F.substring(F.coalesce("addr_norm", F.lit("")), 1, 90))
    return records.select("entity_id", "country", text.alias("text"))


def numbered_text(pairs: DataFrame, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text_1, text_2) for a scorer, and the key file (id and the pairs' columns) that its scores are joined back by.

    The numbers are given once, in a staged table.
    """
    from ledgerlink.staging import stage

    rows = stage(pair_text(pairs, left, right).withColumn("id", F.monotonically_increasing_id()), "texts")
    return rows.select("id", "text_1", "text_2"), rows.select("id", *pairs.columns)


def pair_text(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Raw "name , address" of both sides of each pair; pairs keep their keys in place of a row number."""
    text = F.concat_ws(" , ", "business_name", "business_address")
    a = left.select(F.col("entity_id").alias("s1_id"), text.alias("text_1"))
    b = right.select(F.col("entity_id").alias("match_id"), text.alias("text_2"))
    return pairs.join(a, "s1_id", "left").join(b, "match_id", "left")


def append_log(spark: SparkSession, row: dict, path: str) -> None:
    import json

    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def render_log(spark: SparkSession, path: str, columns: list[str]) -> str:
    """A Markdown table of the log's rows; a log has a row for each run."""
    log = read_log(spark, path)
    have = [c for c in columns if c in log.columns]
    rows = log.select(*have).collect()
    lines = ["| " + " | ".join(have) + " |", "|" + "---|" * len(have)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]) + "\n"
