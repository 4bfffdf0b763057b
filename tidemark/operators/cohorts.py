"""Overlapping cohorts: a row belongs to as many as apply, found in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: These look at the outcome, so they may diagnose but not select.
DIAGNOSTIC_ONLY = ("played", "long")


def cohort_names(*, exposure: Column, position: Column, n_occurrences: Column, period: Column, status: Column, positions: tuple[str, ...], early: int = 5) -> Column:
    """The array of a row's cohorts. A NULL status is neither available nor flagged."""
    rules = {
        "all": F.lit(True),
        "played": exposure > 0,
        "long": exposure >= 60,
        **{f"position_{p}": position == p for p in positions},
        "single": n_occurrences == 1,
        "multi": n_occurrences > 1,
        "early": period <= early,
        "established": period > early,
        "available": status == "a",
        "flagged": status != "a",
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def with_cohorts(frame: DataFrame, names: Column) -> DataFrame:
    """A row for each cohort it belongs to. Any metric with ``cohort`` in its group then scores every populated cohort."""
    return frame.withColumn("cohort", F.explode(names))


def cohort(frame: DataFrame, name: str) -> DataFrame:
    return frame.where(F.col("cohort") == name)
