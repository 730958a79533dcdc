"""The pipeline's exact steps over streams of arriving records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_repeats(stream: DataFrame, keys: Sequence[str], at: str, late: str = "1 day") -> DataFrame:
    """Arrivals without repeats of a key within ``late`` of each other; state older than that is dropped.

    Over a stream the first to arrive stands, which is the batch rule ``first_seen`` where arrival order is ``at``.
    """
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def arrivals_by_window(stream: DataFrame, at: str, window: str, by: Sequence[str], late: str = "1 day") -> DataFrame:
    """Arrivals per tumbling window and value, final once the watermark has passed the window."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n_rows")
