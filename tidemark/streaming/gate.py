"""The snapshot gate on a stream of snapshots, and the latest accepted one per period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.snapshots import gated


def accepted(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """Snapshots of a stream that the gate accepts. The calendar is a static table."""
    return gated(snapshots, calendar).where("reject_reason IS NULL").drop("reject_reason")


def latest(snapshots: DataFrame, calendar: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """(era, target, captured_at, source_id) of the latest accepted snapshot so far, for update or complete mode. State is one row a period."""
    return accepted(snapshots, calendar).withWatermark("captured_at", delay).groupBy("era", "target").agg(F.max("captured_at").alias("captured_at"), F.max_by("source_id", "captured_at").alias("source_id"))
