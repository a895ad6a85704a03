"""Operator 9: token counts through an exact length histogram.

Documents are aggregated by encoded length; everything else is read off that
histogram, whose size follows the number of different lengths, not of
documents.  Suffix sums over it answer, for every context limit, how many
documents and tokens there are, how many fit, and how many tokens stay when
each text is cut at the limit.

Null and empty texts have length 0 and are counted.  An empty table gives an
empty histogram, and answers of 0 (null for quantiles).  Repeated rows count as
often as they stand there.  Very long texts are encoded whole.  Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.llm import bpe
from ledgerlink.llm.batches import slices
from ledgerlink.staging import stage

SPAN = 256  # lengths in one block of the two-level suffix sums


def lengths(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """A column n_tokens, a row for each document."""
    path, usual = (vocabulary, pattern) if vocabulary and pattern else bpe.default_vocabulary()
    path, pattern = vocabulary or path, pattern or usual
    ranks = docs.sparkSession.sparkContext.broadcast(bpe.read_ranks(path))  # the vocabulary's size is fixed

    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, **options) -> DataFrame:
    """n_tokens and n_docs, a row for each length that occurs."""
    return lengths(docs, **options).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit:

    n_docs of that length; docs_longer and tokens_longer, of documents with more
    than L tokens; docs_fitting; quantile, the share of documents with L tokens
    or fewer; tokens_total of all; truncated_total, tokens left when every
    document is cut at L; tokens_cut, those lost.

    Sums run within blocks of lengths and over the blocks' totals, so no task
    gets all lengths.
    """
    hist = stage(hist, "lengths").withColumn("block", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    # a row for each block of lengths: the longest text's length over SPAN, at most
    outer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block", *(F.coalesce(F.sum(f"block_{c}").over(outer), F.lit(0)).alias(f"{c}_above") for c in ("docs", "tokens")),
        F.sum("block_docs").over(everything).alias("docs_total"), F.sum("block_tokens").over(everything).alias("tokens_total"),
    )
    longer = hist.select(
        "n_tokens", "n_docs", "block", F.coalesce(F.sum("n_docs").over(inner), F.lit(0)).alias("docs_in"), F.coalesce(F.sum("tokens").over(inner), F.lit(0)).alias("tokens_in")
    ).join(blocks, "block")
    out = longer.select("n_tokens", "n_docs", (F.col("docs_in") + F.col("docs_above")).alias("docs_longer"), (F.col("tokens_in") + F.col("tokens_above")).alias("tokens_longer"), "docs_total", "tokens_total")
    fit = F.col("docs_total") - F.col("docs_longer")
    kept = F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return out.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer", fit.alias("docs_fitting"), (fit / F.col("docs_total")).alias("quantile"),
        "tokens_total", kept.alias("truncated_total"), (F.col("tokens_total") - kept).alias("tokens_cut"),
    )


def answers(hist: DataFrame, limits: list[int], quantiles: list[float]) -> dict:
    """Totals, truncated totals by limit and quantiles (smallest length that the share reaches).

    Each is one aggregation of the histogram; only the numbers come to the driver.
    """
    hist = stage(hist, "lengths")
    cut = lambda n: F.sum(F.least(F.col("n_tokens"), F.lit(n)) * F.col("n_docs"))
    row = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)), *(F.coalesce(cut(n), F.lit(0)) for n in limits)).first()
    table = suffix_sums(hist)
    at = table.agg(*(F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))) for q in quantiles)).first() if quantiles else ()
    return {"documents": row[0], "tokens": row[1], "truncated": dict(zip(limits, row[2:], strict=True)), "quantiles": dict(zip(quantiles, at, strict=True))}
