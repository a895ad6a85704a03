"""Boosted and linear pair models with out-of-fold scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.operators.sampling import hash_folds
from ledgerlink.staging import stage


def with_missing_flags(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Nulls as -1, and a flag beside each column."""
    out = df.select("*", *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"__{c}") for c in columns), *(F.col(c).isNull().cast("double").alias(f"__no_{c}") for c in columns))
    return out, [f"__{c}" for c in columns] + [f"__no_{c}" for c in columns]


def fit(df: DataFrame, columns: list[str], label: str, weight: str | None = None, boosted: bool = False, validation: str | None = None, **settings):
    """A pipeline of assembler and classifier on columns made by ``with_missing_flags``.

    validation: a boolean column; with it boosting stops when its rows gain nothing more.
    settings: of the classifier, over its defaults here.
    """
    if boosted:
        model = GBTClassifier(**{"maxIter": 20, "maxDepth": 4, "seed": 7, **settings})
        if validation:
            model = model.setValidationIndicatorCol(validation)
    else:
        model = LogisticRegression(**{"maxIter": 25, "regParam": 1e-4, **settings})
    model = model.setLabelCol(label).setFeaturesCol("__x")
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__x"), model]).fit(df)


def predict(model, df: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1])


def score(model, df: DataFrame, columns: list[str], keys: list[str], floor: float = 0.02, kept: list[str] | None = None) -> DataFrame:
    """keys, p and the ``kept`` columns of the rows that reach ``floor``: a feature table is scored and dropped in one pass."""
    ready, _ = with_missing_flags(df, columns)
    return predict(model, ready, "p").filter(F.col("p") >= floor).select(*keys, "p", *(kept or []))


def importance(model, columns: list[str]) -> list[tuple[str, float]]:
    """Columns by their share in the model: of gain if boosted, else of absolute weights."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(values.sum()) or 1.0
    return sorted(((c, float(v) / total) for c, v in zip(columns, values, strict=True)), key=lambda x: (-x[1], x[0]))


def save(model, path: str, columns: list[str], threshold: float, **meta) -> None:
    """The model, and beside it its columns, threshold and other facts as JSON."""
    import json

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"features": columns, "threshold": threshold, **meta}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    import json

    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def sampled_negatives(df: DataFrame, label: str, key: Column, keep: float, easy: Column | None = None) -> DataFrame:
    """All positives and hard negatives, a share of the easy ones (all negatives, if not given), with the inverse share as weight."""
    from ledgerlink.operators.sampling import draw

    negative = (F.col(label) == 0) & (F.lit(True) if easy is None else F.coalesce(easy, F.lit(False)))
    chosen = ~negative | (draw(key) < F.lit(int(keep * 65_537)))
    return df.filter(chosen).withColumn("weight", F.when(negative, F.lit(1 / keep)).otherwise(1.0))


def out_of_fold(
    df: DataFrame, columns: list[str], label: str, group: str, keys: list[str], folds: int = 5, boosted: bool = False, weight: str | None = None, extra: DataFrame | None = None, other: DataFrame | None = None, **settings
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """keys, label, fold and a score from the model that saw none of the group's fold.

    extra: rows that every fold is trained on as well and that are not scored.
    other: rows that all folds' models score, their mean in a second table (keys, score).
    """
    ready, inputs = with_missing_flags(hash_folds(df, group, folds), columns)
    ready = stage(ready, "folds")
    needed = [*inputs, label, *([weight] if weight else [])]
    more = stage(with_missing_flags(extra, columns)[0].select(*needed), "extra") if extra is not None else None
    asked = stage(with_missing_flags(other, columns)[0], "others") if other is not None else None
    out, means = None, None
    for k in range(folds):
        seen = ready.filter(F.col("fold") != k).select(*needed)
        model = fit(seen if more is None else seen.unionByName(more), inputs, label, weight, boosted, **settings)
        scored = predict(model, ready.filter(F.col("fold") == k)).select(*keys, label, "fold", F.round("score", 6).alias("score"))
        out = scored if out is None else out.unionByName(scored)
        if asked is not None:
            one = predict(model, asked).select(*keys, "score")
            means = one if means is None else means.unionByName(one)
    if asked is None:
        return out
    return out, means.groupBy(*keys).agg(F.round(F.avg("score"), 6).alias("score"))


def blend(band: DataFrame, columns: list[str], label: str, frame: DataFrame, other: DataFrame | None = None, p: str = "p", folds: int = 5, **settings):
    """A stacked model on an uncertain band: its out-of-fold score pb replaces ``p`` in the frame's pf.

    band: s1, m, src, p, the label and columns such as encoders' scores; the
    logit of p is a further input.  Returns the frame, and with ``other`` (a band
    without labels) its mean scores as pb.
    """
    from ledgerlink.operators.decision import logit

    keys = ["s1", "m", "src"]
    with_logit = lambda df: df.withColumn("lp", logit(F.col(p)))
    made = out_of_fold(with_logit(band), ["lp", *columns], label, "s1", keys, folds, other=None if other is None else with_logit(other), **settings)
    scores, asked = made if other is not None else (made, None)
    done = frame.join(scores.select(*keys, F.col("score").alias("pb")), keys, "left").withColumn("pf", F.coalesce("pb", p)).drop("pb")
    return done if asked is None else (done, asked.withColumnRenamed("score", "pb"))


def probe(df: DataFrame, columns: list[str], label: str, group: str, keys: list[str], settings: dict[str, dict], folds: int = 3, boosted: bool = True) -> DataFrame:
    """ROC area of out-of-fold scores for each named group of settings, best first."""
    from ledgerlink.operators.evaluate import auc

    out = None
    for name, values in settings.items():
        scored = out_of_fold(df, columns, label, group, keys, folds, boosted, **values)
        one = auc(stage(scored, "probe"), label).withColumn("settings", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("auc"), "settings")


def half_and_half(df: DataFrame, columns: list[str], label: str, group: str, keys: list[str], boosted: bool = False) -> DataFrame:
    """keys, label and score of one half of the groups, by a model of the other half."""
    ready, inputs = with_missing_flags(hash_folds(df, group, 2), columns)
    ready = stage(ready, "halves")
    model = fit(ready.filter("fold = 0"), inputs, label, boosted=boosted)
    return predict(model, ready.filter("fold = 1")).select(*keys, label, F.round("score", 6).alias("score"))


def leave_one_out(df: DataFrame, columns: list[str], label: str, country: str, keys: list[str], boosted: bool = False) -> DataFrame:
    """keys, label, country and a score from the model of all other countries."""
    ready, inputs = with_missing_flags(df, columns)
    ready = stage(ready, "countries")
    out = None
    for (name,) in ready.select(country).distinct().orderBy(country).collect():  # as many models as countries
        model = fit(ready.filter(F.col(country) != name), inputs, label, boosted=boosted)
        one = predict(model, ready.filter(F.col(country) == name)).select(*keys, label, country, F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out
