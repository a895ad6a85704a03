"""Arriving records against a static index: a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_stream(arriving: DataFrame, index: DataFrame, keys: list[str], time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each arriving record with its matches; records that are later than ``late`` are dropped by the watermark of later steps."""
    return arriving.withWatermark(time_col, late).join(index, keys, "left")


def match_rates(matched: DataFrame, found: str, time_col: str = "ts", window: str = "1 hour") -> DataFrame:
    return matched.groupBy(F.window(time_col, window)).agg(F.count("*").alias("n"), F.count(found).alias("n_matched"))
