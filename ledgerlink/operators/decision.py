"""From scored pairs (s1, m, src, p) to match sets.  A record is (m, src)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = ["m", "src"]


def one_owner(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Rows that reach their record's best score; ties keep all."""
    best = F.max(p).over(Window.partitionBy(*RECORD))
    return pairs.withColumn("__best", best).filter(F.col(p) >= F.col("__best")).drop("__best")


def threshold(pairs: DataFrame, least: float, p: str = "p") -> DataFrame:
    return one_owner(pairs, p).filter(F.col(p) >= least)


def expected_f(pairs: DataFrame, floor: float = 0.0, power: float = 1.0, beta: float = 0.5) -> DataFrame:
    """Per s1 the shortest prefix, best first, of greatest expected F; none if an empty set expects more.

    ``p`` of 1 makes an empty set's chance 0 (the logarithm of 0 is null here).
    Pairs under ``floor`` count for the choice and are left out of its result.
    """
    q = F.pow("p", F.lit(power))
    owned = one_owner(pairs).withColumn("q", q)
    ranked = Window.partitionBy("s1").orderBy(F.desc("q"), "src", "m")
    whole = Window.partitionBy("s1")
    b2 = beta * beta
    steps = owned.select(
        "*",
        F.row_number().over(ranked).alias("k"),
        F.sum("q").over(ranked.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.sum("q").over(whole).alias("n_hat"),
        F.when(F.max("q").over(whole) >= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.when(F.col("q") < 1, 1 - F.col("q")))).over(whole))).alias("p_empty"),
    ).withColumn("ef", (1 + b2) * F.col("cum") / (F.col("k") + b2 * F.col("n_hat")))
    top = steps.withColumn("ef_best", F.max("ef").over(whole))
    cut = top.withColumn("k_best", F.min(F.when(F.col("ef") >= F.col("ef_best"), F.col("k"))).over(whole))
    return cut.filter((F.col("ef_best") > F.col("p_empty")) & (F.col("k") <= F.col("k_best")) & (F.col("p") >= floor)).select(*pairs.columns)


def by_kind(kind: Column, limits: dict[int, float]) -> Column:
    """The kind's threshold; a kind without one ends the job."""
    found = F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in limits.items())), kind)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no threshold for kind "), kind.cast("string"))).cast("double"))


def select_by_kind(pairs: DataFrame, limits: dict[int, float], rescue: float = 0.5) -> DataFrame:
    """Owned pairs over their kind's threshold; s1 left empty get their best owned pair if it reaches ``rescue``."""
    owned = one_owner(pairs)
    ranked = Window.partitionBy("s1").orderBy(F.desc("p"), "src", "m")
    chosen = F.col("p") >= by_kind(F.col("kind"), limits)
    marked = owned.select("*", chosen.alias("__chosen"), F.row_number().over(ranked).alias("__k"))
    marked = marked.withColumn("__any", F.max(F.col("__chosen").cast("int")).over(Window.partitionBy("s1")))
    keep = F.col("__chosen") | ((F.col("__any") == 0) & (F.col("__k") == 1) & (F.col("p") >= rescue))
    return marked.filter(keep).withColumn("rescued", ~F.col("__chosen")).drop("__chosen", "__k", "__any")


def record_normalised(pairs: DataFrame, alpha: float = 0.5, p: str = "p") -> DataFrame:
    """pn = p / max(1, p + alpha * (the record's sum - p)), to nine places, as a sum's last bits hang on its order."""
    total = F.sum(p).over(Window.partitionBy(*RECORD))
    return pairs.withColumn("pn", F.round(F.col(p) / F.greatest(F.lit(1.0), F.col(p) + alpha * (total - F.col(p))), 9))


def select_normalised(pairs: DataFrame, least: float, alpha: float = 0.5) -> DataFrame:
    """Ownership by p, threshold on pn."""
    return one_owner(record_normalised(pairs, alpha)).filter(F.col("pn") >= least)


def drop_contested(pairs: DataFrame, least: float | dict[str, float], second: float, country: str = "country") -> DataFrame:
    """Owned pairs over ``least`` (one for all, or by country) whose record has no runner-up at ``second`` or more.

    Pairs of a country without a limit go.
    """
    ranked = Window.partitionBy(*RECORD).orderBy(F.desc("p"), "s1")
    full = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = pairs.select("*", F.row_number().over(ranked).alias("__k"), F.coalesce(F.nth_value("p", 2).over(full), F.lit(0.0)).alias("p2"))
    limit = F.lit(least) if not isinstance(least, dict) else F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in least.items())), F.col(country))
    return marked.filter((F.col("__k") == 1) & (F.col("p") >= limit) & (F.col("p2") < second)).drop("__k")


def drop_empty_ties(pairs: DataFrame, entities: DataFrame, records: DataFrame, least: int = 2) -> DataFrame:
    """``pairs`` without those of records that have no address and whose name key ``least`` or more s1 of the country share.

    entities: country, name_key; records: m, src, country, name_key, addr_empty.
    """
    shared = entities.groupBy("country", "name_key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    tied = records.filter("addr_empty").join(shared, ["country", "name_key"], "left_semi").select(*RECORD)
    return pairs.join(tied, RECORD, "left_anti")


def contest(pairs: DataFrame, confident: float = 0.3) -> DataFrame:
    """What the record's other pairs look like from each pair."""
    record = Window.partitionBy(*RECORD)
    own = (F.col("p") >= confident).cast("int")
    ranked = record.orderBy(F.desc("p"), "s1")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.max("p").over(record), F.coalesce(F.nth_value("p", 2).over(whole), F.lit(0.0))
    return pairs.select(
        *pairs.columns,
        F.round(F.sum("p").over(record) - F.col("p"), 6).alias("c_sum_other"),
        F.when(F.row_number().over(ranked) == 1, second).otherwise(first).alias("c_max_other"),
        (F.sum(own).over(record) - own).alias("c_n_other"),
        (F.col("p") >= first).cast("int").alias("c_is_max"),
    )


def tie_guard(pairs: DataFrame, tied: DataFrame, keys: list[str], blended: str = "p_blend", plain: str = "p") -> DataFrame:
    """The lesser of two scores where the keys are tied, else the blended one."""
    marks = tied.select(*keys).distinct().withColumn("__tied", F.lit(True))
    return pairs.join(marks, keys, "left").withColumn("p_guarded", F.when(F.col("__tied"), F.least(blended, plain)).otherwise(F.col(blended))).drop("__tied")


def safeguard(pairs: DataFrame, seen: DataFrame, conflict: Column, country: str = "country") -> DataFrame:
    """Drop conflicting pairs of countries that were not trained on."""
    known = seen.select(F.col(country)).distinct().withColumn("__seen", F.lit(True))
    return pairs.join(known, country, "left").filter(F.col("__seen").isNotNull() | ~F.coalesce(conflict, F.lit(False))).drop("__seen")


def overlay(frame: DataFrame, scores: DataFrame, keys: list[str], p: str = "p", new: str = "p_new") -> DataFrame:
    """p replaced where ``scores`` has one; pairs found only there are added (full outer join on the keys)."""
    both = frame.join(scores.select(*keys, new), keys, "full")
    return both.withColumn("pf", F.coalesce(new, p)).withColumn("added", F.col(p).isNull())


def in_band(pairs: DataFrame, low: float, high: float, p: str = "pf", sure: float = 0.999) -> DataFrame:
    """low <= pf < high, without kinds 0 and 1 whose model score is sure."""
    return pairs.filter((F.col(p) >= low) & (F.col(p) < high) & ~(F.col("kind").isin(0, 1) & (F.col("p") >= sure)))


def logit(p: Column, least: float = 1e-6) -> Column:
    """ln(p / (1 - p)), p kept ``least`` away from 0 and 1; null stays null."""
    q = F.when(p.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(1 - least), p)))
    return F.log(q / (1 - q))


def threshold_curve(pairs: DataFrame, truth: DataFrame, ids: DataFrame, grid: list[float]) -> DataFrame:
    """F0.5, precision and recall (means over ``ids``) of owned pairs at each threshold, in one pass over all of them.

    A pair is dealt to every threshold that it passes; the list of thresholds is a parameter.
    """
    steps = F.array(*map(F.lit, grid))
    owned = one_owner(pairs).select("s1", *RECORD, F.explode(F.filter(steps, lambda t: t <= F.col("p"))).alias("threshold"))
    hits = owned.join(truth.select("s1", *RECORD).distinct().withColumn("__t", F.lit(1)), ["s1", *RECORD], "left")
    found = hits.groupBy("threshold", "s1").agg(F.count("*").alias("n_pred"), F.count("__t").alias("tp"))
    true = truth.select("s1", *RECORD).distinct().groupBy("s1").agg(F.count("*").alias("n_true"))
    every = ids.select("s1").distinct().join(true, "s1", "left").select("s1", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.explode(steps).alias("threshold"))
    x = every.join(found, ["threshold", "s1"], "left").na.fill(0, ["n_pred", "tp"])
    f = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (F.col("n_pred") + 0.25 * F.col("n_true")))
    mean = lambda c: F.round(F.avg(c), 6)
    return x.groupBy("threshold").agg(mean(f).alias("f05"), mean(F.try_divide("tp", "n_pred")).alias("macro_p"), mean(F.try_divide("tp", "n_true")).alias("macro_r"))


def tune_threshold(curve: DataFrame) -> DataFrame:
    """The curve's row of greatest F0.5, of equal ones the least threshold."""
    return curve.orderBy(F.desc("f05"), "threshold").limit(1)


def contenders(pairs: DataFrame, least: float = 0.0, second: float | None = None) -> DataFrame:
    """A record's best pairs and the runners-up, with all ties: all that ``one_owner`` and ``class_rules`` look at.

    Records whose best is under ``least`` or whose runner-up reaches ``second`` go
    whole.  The rank limit is applied before rows travel, so that columns that
    cost more can be made for these pairs alone.
    """
    ranked = Window.partitionBy(*RECORD).orderBy(F.desc("p"))
    top = pairs.withColumn("__k", F.rank().over(ranked)).filter("__k <= 2")
    full = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = top.select("*", F.max("p").over(full).alias("__best"), F.nth_value("p", 2).over(full).alias("__next")).filter(F.col("__best") >= least)
    if second is not None:
        out = out.filter(F.coalesce("__next", F.lit(0.0)) < second)
    return out.drop("__k", "__best", "__next")


def class_rules(pairs: DataFrame, limit: Column, lower: dict[str, float] | None = None, drop: dict[str, float] | None = None, second: float | None = None) -> DataFrame:
    """Owned pairs (column cls: ``features.pair_class``) over ``limit``, with rules by class.

    lower: a class's own limit, where it is lower; drop: a class goes where p is
    under its value; second: records whose runner-up reaches this go.
    """
    value = lambda rules: F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in rules.items())), F.col("cls"))
    ranked = Window.partitionBy(*RECORD).orderBy(F.desc("p"), "s1")
    full = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.least(limit, value(lower)) if lower else limit
    marked = one_owner(pairs.select("*", own.alias("__limit"), F.coalesce(F.nth_value("p", 2).over(full), F.lit(0.0)).alias("__p2")))
    keep = F.col("p") >= F.col("__limit")
    if second is not None:
        keep &= F.col("__p2") < second
    if drop:
        keep &= F.col("p") >= F.coalesce(value(drop), F.lit(0.0))
    return marked.filter(keep).drop("__limit", "__p2")


def replace_rows(base: DataFrame, new: DataFrame, of: DataFrame, key: str = "s1") -> DataFrame:
    """``base`` (pairs) with the rows of the s1 in ``of`` taken from ``new`` instead."""
    return base.join(of.select(key).distinct(), key, "left_anti").unionByName(new.select(*base.columns).join(of.select(key).distinct(), key, "left_semi"))


def add_kind(frame: DataFrame, extra: DataFrame, kind: int) -> DataFrame:
    """``frame`` (s1, m, src, p, pf, kind) and the pairs of ``extra`` (s1, m, src, p) that it lacks, as ``kind``."""
    keys = ["s1", *RECORD]
    fresh = extra.select(*keys, "p").join(frame.select(*keys), keys, "left_anti")
    return frame.unionByName(fresh.select(*keys, "p", F.col("p").alias("pf"), F.lit(kind).cast(frame.schema["kind"].dataType).alias("kind")))


def probe_frame(frame: DataFrame, floor: float = 0.005) -> DataFrame:
    """Rows over ``floor`` with their record's sum and greatest pf, over all rows."""
    record = Window.partitionBy(*RECORD)
    return frame.select("*", F.round(F.sum("pf").over(record), 6).alias("rec_sum"), F.max("pf").over(record).alias("rec_max")).filter(F.col("pf") >= floor)


def open_records(records: DataFrame, scored: DataFrame, claimed: float) -> DataFrame:
    """Records without a pair scored ``claimed`` or more."""
    taken = scored.filter(F.col("p") >= claimed).select(*RECORD).distinct()
    return records.join(taken, RECORD, "left_anti")


def select_shifted(pairs: DataFrame, limits: dict[int, float], settings: dict[str, dict], country: str = "country") -> DataFrame:
    """Record-normalised selection with settings of each country.

    ``settings``: shift (added to the limits of kinds), alpha, rescue (least pn
    of the best owned pair of an s1 without any other) and drop (kinds never
    returned).  An unknown kind is an error; rows of other countries go.
    """
    each = lambda name: F.create_map(*(F.lit(x) for c, v in settings.items() for x in (c, v[name])))
    value = lambda name: F.try_element_at(each(name), F.col(country))
    record = Window.partitionBy(*RECORD)
    marked = pairs.select("*", F.sum("p").over(record).alias("__sum"), F.max("p").over(record).alias("__max")).filter(F.col(country).isin(*settings) & (F.col("p") >= F.col("__max")))
    pn = F.round(F.col("p") / F.greatest(F.lit(1.0), F.col("p") + value("alpha") * (F.col("__sum") - F.col("p"))), 9)
    owned = marked.withColumn("pn", pn).withColumn("__ok", F.col("pn") >= by_kind(F.col("kind"), limits) + value("shift"))
    entity = Window.partitionBy("s1")
    best = owned.select("*", F.max("__ok").over(entity).alias("__any"), F.row_number().over(entity.orderBy(F.desc("pn"), "src", "m")).alias("__k"))
    chosen = best.filter(F.col("__ok") | (~F.col("__any") & (F.col("__k") == 1) & (F.col("pn") >= value("rescue"))))
    for c, v in settings.items():
        if v.get("drop"):
            chosen = chosen.filter(~((F.col(country) == c) & F.col("kind").isin(*v["drop"])))
    return chosen.drop("__sum", "__max", "__ok", "__any", "__k")
