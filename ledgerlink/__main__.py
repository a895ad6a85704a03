"""Command lines: ``python -m ledgerlink COMMAND --help``.  All of them read and write Parquet tables or tab-separated files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.functions import house, normalize
from ledgerlink.operators import blocking, decision, evaluate, extension, pairs, sampling
from ledgerlink.sources import records as io


def _session() -> SparkSession:
    return SparkSession.builder.appName("ledgerlink").getOrCreate()


def _sides(spark: SparkSession, root: str, split: str, country: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalised records of a split: the reference list, and all others with src."""
    read = lambda k: spark.read.parquet(f"{root}/{split}_source{k}.parquet").withColumn("rid", io.numeric_id(F.col("entity_id")))
    left = read(1)
    right = io.union_candidates(*(read(k).withColumn("src", F.lit(k)) for k in (2, 3)))
    return (left, right) if country is None else (left.filter(F.col("country") == country), right.filter(F.col("country") == country))


def convert(a: argparse.Namespace) -> int:
    io.convert_split(_session(), a.raw, a.out, a.split)
    return 0


def normalise(a: argparse.Namespace) -> int:
    """Names, addresses and both kinds of house numbers of every source of a split."""
    spark = _session()
    for k in (1, 2, 3):
        raw = io.load_source(spark, a.processed, a.split, k)
        done = normalize.normalize_addresses(normalize.normalize_names(raw)).withColumn("house_v2", house.house_number(F.col("business_address"), F.col("country")))
        io.convert(done, f"{a.out}/{a.split}_source{k}.parquet")
    return 0


def block(a: argparse.Namespace) -> int:
    left, right = _sides(_session(), a.norm, a.split, a.country)
    io.write_candidates(blocking.generate(left, right, a.max_df, a.k, a.k_name, a.k_addr), a.out)
    return 0


def reverse(a: argparse.Namespace) -> int:
    left, right = _sides(_session(), a.norm, a.split, a.country)
    found = blocking.generate_reverse(left, right, max_df=a.max_df, k=a.k, k_name=a.k_name, k_addr=a.k_addr, k_empty=a.k_empty)
    io.write_candidates(found.join(left.select(F.col("rid").alias("s1"), "country"), "s1"), a.out)
    return 0


def extend(a: argparse.Namespace) -> int:
    """Pairs of rare keys that the candidates lack."""
    spark = _session()
    left, right = (extension.prepare(x) for x in _sides(spark, a.norm, a.split, a.country))
    types = extension.SECOND if a.second else extension.FIRST
    io.write_features(extension.pairs(left, right, spark.read.parquet(a.candidates), a.top, a.max_df, types, by_address=a.second), a.out)
    return 0


def featurise(a: argparse.Namespace) -> int:
    spark = _session()
    left, right = _sides(spark, a.norm, a.split)
    truth = io.keyed_pairs(io.load_gt_pairs(spark, a.truth).filter("match_id IS NOT NULL")) if a.truth else None
    io.write_features(pairs.build(spark.read.parquet(a.candidates), left, right, truth), a.out)
    return 0


def rule(a: argparse.Namespace) -> int:
    """The exact rule (name key and house number within the country, states not in conflict) as an id-list file."""
    left, right = _sides(_session(), a.norm, a.split)
    key = ["country", "name_key", "addr_house_no"]
    both = (lambda df, names, n: df.filter("name_key <> '' AND addr_house_no <> ''").select(*names, *key, F.col("addr_state").alias(f"state_{n}")))
    agree = (F.col("state_1") == F.col("state_2")) | (F.col("state_1") == "") | (F.col("state_2") == "")
    found = blocking.exact_rule(both(left, [F.col("rid").alias("s1")], 1), both(right, [F.col("rid").alias("m"), "src"], 2), key, agree)
    named = found.select(io.string_id(F.lit(1), F.col("s1")).alias("s1_id"), io.string_id(F.col("src"), F.col("m")).alias("match_id"))
    io.write_id_list_tsv(named, left.select(F.col("entity_id").alias("s1_id"), F.col("rid").alias("pos")), a.out)
    return 0


def split(a: argparse.Namespace) -> int:
    """Folds of the reference list, even within each country: fold 0 is for validation, a tenth of it for quick looks."""
    spark = _session()
    left = io.load_source(spark, a.processed, "train", 1).select(F.col("entity_id").alias("s1_id"), "country").withColumn("s1", io.numeric_id(F.col("s1_id")))
    folds = sampling.stratified_folds(left, "s1", ["country"], a.folds, a.seed)
    role = F.when(F.col("fold") == 0, "val").otherwise("fit")
    io.convert(folds.select("s1_id", "country", "fold", role.alias("role"), ((F.col("fold") == 0) & (sampling.draw(F.col("s1"), a.seed + 1) < 6554)).alias("is_dev")), a.out)
    return 0


def score(a: argparse.Namespace) -> int:
    """F0.5 of an id-list file against the ground truth, for all entities and by country."""
    spark = _session()
    ids = spark.read.parquet(a.split_file).select("s1_id", "country")
    found = evaluate.entity_scores(io.read_id_list_tsv(spark, a.predictions), io.load_gt_pairs(spark, a.truth).filter("match_id IS NOT NULL"), ids)
    print(evaluate.report_line("all", evaluate.summarize(found)))
    evaluate.summarize(found, ["country"]).orderBy("country").show(1000, False)
    if a.log:
        io.append_log(spark, evaluate.summarize(found).first().asDict() | {"file": a.predictions}, a.log)
    return 0


def decide(a: argparse.Namespace) -> int:
    """Owned pairs over a threshold, of scored pairs (s1, m, src, p), as an id-list file."""
    spark = _session()
    chosen = decision.threshold(spark.read.parquet(a.scores), a.threshold)
    ids = spark.read.parquet(a.ids).select(F.col("entity_id").alias("s1_id"), io.numeric_id(F.col("entity_id")).alias("pos"))
    io.write_id_list_tsv(chosen.select(io.string_id(F.lit(1), F.col("s1")).alias("s1_id"), io.string_id(F.col("src"), F.col("m")).alias("match_id")), ids, a.out)
    return 0


def check(a: argparse.Namespace) -> int:
    """The rules that a submission file breaks; ends with 1 if there is one (a match that is no candidate is a warning)."""
    spark = _session()
    ids = lambda k: io.read_source_tsv(spark, f"{a.raw}/{a.split}_source{k}.tsv").select("entity_id")
    known = ids(2).unionByName(ids(3)) if a.check_ids else None
    cands = io.read_id_list_tsv(spark, a.candidates, "candidate_entity_ids") if a.candidates else None
    found = evaluate.validate_file(spark, a.file, ids(1).withColumnRenamed("entity_id", "source1_entity_id"), known, cands).collect()  # a row for each rule
    for r in found:
        print(f"{r.check}: {r.n}")
    return int(any(r.n for r in found if r.check != "not_a_candidate"))


def main(args: list[str]) -> int:
    top = argparse.ArgumentParser(prog="ledgerlink")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *needed: str, **options):
        p = commands.add_parser(name, help=run.__doc__)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, v in options.items():
            flag = {"action": "store_true"} if isinstance(v, bool) else {"default": v, "type": type(v) if v is not None else str}
            p.add_argument(f"--{n.replace('_', '-')}", **flag)
        p.set_defaults(run=run)

    command("convert", convert, "raw", "out", "split")
    command("normalise", normalise, "processed", "out", "split")
    command("block", block, "norm", "out", "split", country=None, max_df=blocking.MAX_DF, k=20, k_name=10, k_addr=10)
    command("reverse-block", reverse, "norm", "out", "split", country=None, max_df=300, k=3, k_name=1, k_addr=1, k_empty=10)
    command("extend", extend, "norm", "out", "split", "candidates", country=None, top=10, max_df=50, second=False)
    command("features", featurise, "norm", "out", "split", "candidates", truth=None)
    command("rule", rule, "norm", "out", "split")
    command("split", split, "processed", "out", folds=5, seed=0)
    command("decide", decide, "scores", "ids", "out", threshold=0.75)
    command("evaluate", score, "predictions", "truth", "split-file", log=None)
    command("validate", check, "file", "raw", "split", candidates=None, check_ids=False)
    a = top.parse_args(args)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
