"""Arrow batches in small slices, so that few texts are Python objects at once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa

ROWS = 512
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark, rows: int = 1000):
    """Jobs that run inside send at most ``rows`` rows of text to Python at once; the session's own setting comes back."""
    was = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, min(rows, int(was)) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(_SETTING, was)


def slices(batches, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
