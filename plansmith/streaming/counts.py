"""Structured Streaming forms of running checks: duplicates and leaks as they come in, rates over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_leaks(records: DataFrame, key: str = "record_sha256", split: str = "official_split") -> DataFrame:
    """Per key how many rows and splits have it so far; complete or update mode. The set of splits a key has is small."""
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.size(F.collect_set(split)).alias("splits"))


def first_copies(records: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key wasn't seen within the watermark's delay; append mode, with state that the watermark bounds."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_rate(rows: DataFrame, flag: str, time: str, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """The share of rows with a flag per event-time window; rows later than the delay are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.withWatermark(time, delay).groupBy(w, *(keys or [])).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(flag).cast("double")).alias("rate"))
