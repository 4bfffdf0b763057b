"""Paired comparisons of models on the same rows, and resampling of whole groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_differences(candidate: DataFrame, baseline: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, problem): keys of one side only, and targets or eligibility that differ."""
    a = candidate.select(*key, F.struct(*columns).alias("_a"))
    b = baseline.select(*key, F.struct(*columns).alias("_b"))
    both = a.join(b, list(key), "full_outer")
    problem = F.when(F.col("_b").isNull(), "extra").when(F.col("_a").isNull(), "missing").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return both.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def paired_deltas(candidate: DataFrame, baseline: DataFrame, by: Sequence[str], metric: str, evidence: Sequence[str] = ("rows", "key_hash")) -> DataFrame:
    """Per group: both values, the candidate's less the baseline's, and whether both were measured on the same rows."""
    a = candidate.select(*by, F.col(metric).alias("candidate"), *(F.col(c).alias(f"_a_{c}") for c in evidence))
    b = baseline.select(*by, F.col(metric).alias("baseline"), *(F.col(c).alias(f"_b_{c}") for c in evidence))
    same = reduce(lambda x, y: x & y, (F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in evidence), F.lit(True))
    return a.join(b, list(by)).select(*by, "candidate", "baseline", (F.col("candidate") - F.col("baseline")).alias("delta"), same.alias("same_rows"))


def drawn(seed: int, sample: Column, place: Column, n: Column) -> Column:
    """A hashed draw from 0 .. n - 1, the same in any layout."""
    text = F.concat_ws("|", F.lit(str(seed)), sample.cast("string"), place.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def bootstrap(deltas: DataFrame, order: Sequence[str], delta: str = "delta", *, by: Sequence[str] = (), samples: int = 2000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Per ``by`` (one row without): mean, deviation of the resampled means, and their percentile interval. Whole groups are drawn; a group's delta is one number, so there are as many as periods."""
    by = list(by)
    own = deltas if by else deltas.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    numbered = own.select(*keys, place.alias("place"), F.col(delta).cast("double").alias("value"))
    totals = numbered.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("groups"))
    draws = totals.select(*keys, "groups", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("at"))
    picked = draws.select(*keys, "sample", drawn(seed, F.col("sample"), F.col("at"), F.col("groups")).alias("place"))
    means = picked.join(numbered, [*keys, "place"]).groupBy(*keys, "sample").agg(F.avg("value").alias("mean"))
    tail = (1 - confidence) / 2
    resampled = means.groupBy(*keys).agg(F.stddev_samp("mean").alias("deviation"), F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
    found = totals.join(resampled, keys)
    if by:
        return found
    # Without deltas there is still one row.
    one = found.agg(F.max("mean").alias("mean"), F.coalesce(F.max("groups"), F.lit(0).cast("long")).alias("groups"), *(F.max(c).alias(c) for c in ("deviation", "low", "high")))
    return one


def seed_summary(metrics: DataFrame, by: Sequence[str], metric: str, *, higher_is_better: bool = True, seed: str = "seed") -> DataFrame:
    """Per ``by``: mean, deviation (0 for one seed), best and worst seed, range. A tie goes to the smaller seed."""
    value = F.col(metric)
    good = F.struct(-value if higher_is_better else value, seed)
    bad = F.struct(value if higher_is_better else -value, seed)
    return metrics.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"), F.min_by(seed, good).alias("best_seed"), F.min_by(seed, bad).alias("worst_seed"), (F.max(value) - F.min(value)).alias("range")
    )


def seed_noise(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of a long table (by, metric, seed, value). The best seed has the smallest |bias|, the smallest error, or else the largest value."""
    cost = F.when(F.col("metric") == "mean_bias", F.abs("value")).when(F.col("metric").isin("mae", "rmse", "brier", "log_loss"), F.col("value")).otherwise(-F.col("value"))
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("deviation"), (F.max("value") - F.min("value")).alias("range"), F.min_by("seed", F.struct(cost, "seed")).alias("best_seed")
    )
