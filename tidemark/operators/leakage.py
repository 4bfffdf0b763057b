"""Audits that a table can't see the future. Checks return rows that break them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Endings of provenance columns, and the parts of names that mean a result of the period itself.
PROVENANCE_ENDINGS = ("_captured_at", "_available_at", "_known_at", "_cutoff", "_timestamp")
OUTCOME_PARTS = frozenset("outcome result score points goals actual target label y".split())
CURRENT_PARTS = frozenset("current this final period gw actual".split())


def provenance_columns(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    """The required columns, then all others with a provenance ending."""
    return [*required, *(c for c in columns if c not in required and c.endswith(PROVENANCE_ENDINGS))]


def late_provenance(frame: DataFrame, key: Sequence[str], required: Sequence[str], cutoff: str) -> DataFrame:
    """(key, column, problem): provenance instants at or after the cutoff, and required ones that are NULL. One pass over the frame."""
    found = []
    for c in provenance_columns([x for x in frame.columns if x != cutoff], required):
        problem = F.when(F.col(c) >= F.col(cutoff), "not before the cutoff")
        found.append(F.struct(F.lit(c).alias("column"), (problem.when(F.col(c).isNull(), "is null") if c in required else problem).alias("problem")))
    bad = F.filter(F.array(*found), lambda x: x["problem"].isNotNull())
    return frame.select(*key, F.explode(bad).alias("x")).select(*key, "x.column", "x.problem")


def forbidden_features(columns: Sequence[str], denied: Sequence[str] = ()) -> list[str]:
    """Names that are denied, or hold a word for a result together with one for the period itself. Needs no job."""

    def bad(name: str) -> bool:
        parts = set(re.split(r"[^a-z0-9]+", name.lower()))
        return name in denied or bool(parts & OUTCOME_PARTS and parts & CURRENT_PARTS) or name.startswith("y_")

    return [c for c in columns if bad(c)]


def fold_violations(train: DataFrame, test: DataFrame, key: Sequence[str], era: str, cutoff: str) -> DataFrame:
    """One row: shared keys, and whether the training part ends before the test part begins."""
    shared = train.select(*key).intersect(test.select(*key)).agg(F.count(F.lit(1)).alias("shared_keys"))
    ends = train.agg(F.max(era).alias("train_last_era"), F.max(cutoff).alias("train_last_cutoff"))
    begins = test.agg(F.min(era).alias("test_first_era"), F.min(cutoff).alias("test_first_cutoff"))
    both = shared.join(ends).join(begins)  # one row each
    return both.withColumn("chronological", (F.col("train_last_era") <= F.col("test_first_era")) & (F.col("train_last_cutoff") < F.col("test_first_cutoff")))


def fit_violations(training: DataFrame, fitted: DataFrame, held_out: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, problem): rows fitted outside of training, training rows not fitted, held-out rows fitted."""
    t, f, h = (x.select(*key) for x in (training, fitted, held_out))
    parts = [(f.exceptAll(t), "fitted but not in training"), (t.exceptAll(f), "in training but not fitted"), (f.intersect(h), "held out but fitted")]
    return reduce(DataFrame.unionByName, [x.withColumn("problem", F.lit(p)) for x, p in parts])


def suspicious_features(frame: DataFrame, features: Sequence[str], targets: Sequence[str], *, threshold: float = 0.995, least: int = 8) -> DataFrame:
    """(feature, target, n, r): features that all but equal a target, over the rows that have both. One aggregation for all pairs."""
    aggregates = []
    for f in features:
        for t in targets:
            both = F.col(f).isNotNull() & F.col(t).isNotNull()
            x, y = F.when(both, F.col(f).cast("double")), F.when(both, F.col(t).cast("double"))
            varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
            spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
            aggregates.append(F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.count(x).alias("n"), F.when(varies, F.covar_pop(x, y) / spread).alias("r")))
    found = frame.agg(F.array(*aggregates).alias("pairs")).select(F.explode("pairs").alias("p")).select("p.*")
    return found.where((F.col("n") >= least) & (F.abs("r") >= threshold))


def release_gate(frame: DataFrame, key: Sequence[str], features: Sequence[str], *, required: Sequence[str], cutoff: str, targets: Sequence[str] = (), denied: Sequence[str] = ()) -> DataFrame:
    """(check, subject): everything that stands against releasing the frame. Without targets the proxy check is left out."""
    spark = frame.sparkSession
    names = spark.createDataFrame([("forbidden name", c) for c in forbidden_features(features, denied)], "check string, subject string")
    keys = frame.groupBy(*key).count().where("count > 1").select(F.lit("duplicate key").alias("check"), F.concat_ws("|", *(F.col(c).cast("string") for c in key)).alias("subject"))
    late = late_provenance(frame, key, required, cutoff).groupBy("column", "problem").count().select(F.lit("provenance").alias("check"), F.concat_ws(" ", "column", "problem").alias("subject"))
    out = names.unionByName(keys).unionByName(late)
    if targets:
        out = out.unionByName(suspicious_features(frame, features, targets).select(F.lit("target proxy").alias("check"), F.concat_ws("~", "feature", "target").alias("subject")))
    return out
