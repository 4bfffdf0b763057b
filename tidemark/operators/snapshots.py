"""Cutoff calendars and dated snapshots: only what was captured strictly before a cutoff counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cutoff_calendar(events: DataFrame) -> DataFrame:
    """(era, period, cutoff), one row a period, from event records."""
    return events.groupBy("era", "period").agg(F.min("cutoff").alias("cutoff"), F.countDistinct("cutoff").alias("_n")).select("era", "period", "cutoff")


def calendar_violations(events: DataFrame) -> DataFrame:
    """Periods with several cutoffs, and cutoffs not after the one before."""
    several = events.groupBy("era", "period").agg(F.countDistinct("cutoff").alias("n")).where("n > 1").select("era", "period", F.lit("several cutoffs").alias("rule"))
    order = Window.partitionBy("era").orderBy("period")
    late = cutoff_calendar(events).withColumn("before", F.lag("cutoff").over(order)).where("cutoff <= before").select("era", "period", F.lit("cutoff not after the one before").alias("rule"))
    return several.unionByName(late)


def gated(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """Snapshots with ``reject_reason``, NULL if accepted.

    A snapshot (era, target period, captured_at, events: array of (period, is_next, cutoff)) must mark exactly one event as
    next, the target, with the calendar's cutoff, and be captured strictly before it.
    """
    marked = F.filter("events", lambda e: F.coalesce(e["is_next"], F.lit(False)))
    known = calendar.select("era", F.col("period").alias("target"), "cutoff")
    joined = snapshots.join(known, ["era", "target"], "left").withColumn("_next", marked)
    first = F.get("_next", F.lit(0))
    reason = (
        F.when(F.size("_next") != 1, "not exactly one next event")
        .when(first["period"] != F.col("target"), "next event isn't the target")
        .when(F.col("cutoff").isNull(), "unknown period")
        .when(~first["cutoff"].eqNullSafe(F.col("cutoff")), "embedded cutoff differs")
        .when(F.col("captured_at") >= F.col("cutoff"), "captured late")
    )
    return joined.withColumn("reject_reason", reason).drop("_next")


def latest_accepted(calendar: DataFrame, accepted: DataFrame, *, by: tuple[str, ...] = ("era", "period"), captured: str = "captured_at") -> DataFrame:
    """Each period's last accepted snapshot; a period without one stays without one. A partial aggregate: no sort of the snapshots."""
    rest = [c for c in accepted.columns if c not in by]
    last = accepted.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(captured, *(c for c in rest if c != captured))).alias("last"))
    return calendar.join(last, list(by), "left").select(*calendar.columns, *(F.col(f"last.{c}").alias(c) for c in rest if c not in calendar.columns))
