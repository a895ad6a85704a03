"""Operator 8: quality rules from a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of cells.  The cells'
counts make two smoothed multinomials: one of trusted documents, one of the
whole raw corpus.  A document's ratio is the sum over its n-grams of
ln(trusted / raw), divided by their number, and the document is kept if the
ratio reaches a fixed threshold and the base rules don't fail it.  No chance is
involved: the same document gets the same verdict wherever it stands.

Only DataFrame functions are used.  Texts never travel: the counts are summed
in each task first (at most ``CELLS`` rows a task), and the cells' weights come
back as one array of fixed size.

Null texts count as empty: no words, failed.  Repeated rows count each.  With
no trusted document the ratio is 0 for all, so that the base rules decide.  An
empty table gives no rows.  Texts of any length are read whole.  Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.staging import stage

CELLS = 1 << 16
#: Trusted documents used, the ones with the least hashed ids: a bounded sample, which may be broadcast.
TRUSTED = 20_000
SMOOTHING = 1.0
THRESHOLD = -0.16
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _cells(words: Column) -> Column:
    """Cell numbers of all words and of all pairs of neighbours."""
    cell = lambda *x: F.pmod(F.xxhash64(*x), F.lit(CELLS)).cast("int")
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.transform(rest, lambda w, i: cell(F.get(words, i), w))
    return F.concat(F.transform(words, lambda w: cell(w)), pairs)


def _window_keys(words: Column) -> tuple[Column, Column, Column]:
    """Sorted longs, of each three-word window its hash above its place; the places' bits and mask."""
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.size(words) + F.lit(1.0))).cast("int"))
    shifted = lambda x, by: F.call_function("shiftleft", x, by)
    mask = shifted(F.lit(1).cast("long"), bits) - F.lit(1)
    windows = F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0)))
    keys = F.sort_array(F.transform(windows, lambda w, i: shifted(F.xxhash64(F.get(words, i), F.get(words, i + 1), w), bits).bitwiseOR(i.cast("long"))))
    return keys, bits, mask


def _covered(words: Column, keys: Column, bits: Column, mask: Column) -> Column:
    """Places of the windows found twice or more: neighbours with equal hashes, compared word by word."""
    top = lambda x: F.call_function("shiftright", x, bits)
    at = lambda x: x.bitwiseAND(mask).cast("int")

    def same(x, y):
        alike = [F.get(words, at(x) + k) == F.get(words, at(y) + k) for k in range(3)]
        return F.coalesce((top(x) == top(y)) & alike[0] & alike[1] & alike[2], F.lit(False))

    found = F.filter(keys, lambda x, k: same(x, F.get(keys, k - 1)) | same(x, F.get(keys, k + 1)))
    return F.sort_array(F.transform(found, at))


def _run_lengths(places: Column) -> Column:
    steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, words and the base counts of every whole text."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    first = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).select("__id", text.alias("__text"), words_of(text).alias("__words"))
    words, lines = F.col("__words"), F.filter(F.split("__text", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    keys, bits, mask = _window_keys(words)
    second = first.select("*", lines.alias("__lines"), keys.alias("__keys"), bits.alias("__bits"), mask.alias("__mask"))
    third = second.select("*", _covered(words, F.col("__keys"), F.col("__bits"), F.col("__mask")).alias("__places"))
    n = lambda x: x.cast("long")
    return third.select(
        F.col("__id").alias(id_col),
        F.col("__words"),
        n(F.size(words)).alias("n_words"),
        n(F.char_length(F.array_join(words, ""))).alias("word_chars"),
        n(F.char_length("__text") - F.char_length(F.regexp_replace("__text", SYMBOLS, ""))).alias("n_symbols"),
        n(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _run_lengths(F.col("__places")).alias("n_repeat_words"),
    )


def weights(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One staged row: the array of ln(trusted / raw) by cell.

    trusted_ids: its column ``id_col`` names the trusted documents.
    """
    sample = trusted_ids.select(F.col(id_col).alias("__id")).filter(F.col("__id").isNotNull()).distinct()
    sample = sample.orderBy(F.xxhash64("__id"), "__id").limit(TRUSTED).withColumn("__trusted", F.lit(1))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cells = docs.select(F.col(id_col).alias("__id"), words_of(text).alias("__words")).join(F.broadcast(sample), "__id", "left")  # TRUSTED rows at most
    counts = cells.select("__trusted", F.explode(_cells(F.col("__words"))).alias("cell")).groupBy("cell").agg(F.count("__trusted").alias("t"), F.count("*").alias("r"))
    every = docs.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("cell", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r")))).alias("c"), F.coalesce(F.sum("t"), F.lit(0)).alias("nt"), F.coalesce(F.sum("r"), F.lit(0)).alias("nr"))
    share = lambda n, total: F.log((n + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING * CELLS)))
    ratio = F.transform("c", lambda x: F.when(F.col("nt") == 0, F.lit(0.0)).otherwise(share(x["t"], F.col("nt")) - share(x["r"], F.col("nr"))))
    return stage(row.select(ratio.alias("weights")), "weights")


def judge(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, the base counts, llr, base_failed and kept, a row for each row of ``docs``."""
    listed = model.select(F.array_join(F.transform("weights", lambda x: F.format_number(x, 6)), ";")).first()[0]
    of = F.split(F.lit(listed), ";").cast("array<double>")  # CELLS numbers, folded into one literal
    grams = _cells(F.col("__words"))
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(of, g))
    n_grams = F.greatest(F.lit(1), 2 * F.col("n_words") - 1)
    measured = base_features(docs, id_col, text_col).select("*", (total / n_grams).alias("llr")).drop("__words")
    # a generator keeps later filters from being rewritten into the array expressions, again and again
    out = measured.select(F.inline(F.array(F.struct(*measured.columns))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
