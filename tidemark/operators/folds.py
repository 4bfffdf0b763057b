"""Walk-forward folds over named windows of periods."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EvalWindow:
    """An inclusive range of period ordinals. Only windows whose role allows it may select a model."""

    name: str
    first: int
    last: int
    role: str = "discovery"

    @property
    def may_select(self) -> bool:
        return self.role == "discovery"


def window_table(spark: SparkSession, windows: Sequence[EvalWindow]) -> DataFrame:
    return spark.createDataFrame([(w.name, w.first, w.last, w.role, w.may_select) for w in windows], "window string, first long, last long, role string, may_select boolean")


def in_windows(frame: DataFrame, windows: Sequence[EvalWindow], ordinal: str) -> DataFrame:
    """The rows that lie in a window, with its name. The windows are a handful of literals, so they are broadcast."""
    table = F.broadcast(window_table(frame.sparkSession, windows))
    return frame.join(table, (F.col(ordinal) >= F.col("first")) & (F.col(ordinal) <= F.col("last"))).drop("first", "last")


def fold_table(windows: Sequence[EvalWindow], tests: Sequence[str] | None = None) -> list[tuple[str, str, str]]:
    """(fold, window, part). A fold tests one window, calibrates on the block before it and trains on all blocks before that; later windows never enter."""
    ordered = sorted(windows, key=lambda w: w.first)
    for a, b in zip(ordered, ordered[1:]):
        if b.first <= a.last:
            raise ValueError(f"windows {a.name} and {b.name} overlap")
    rows = []
    for k in range(2, len(ordered)):
        if tests is not None and ordered[k].name not in tests:
            continue
        rows += [(ordered[k].name, w.name, "train") for w in ordered[: k - 1]]
        rows += [(ordered[k].name, ordered[k - 1].name, "calibration"), (ordered[k].name, ordered[k].name, "test")]
    return rows


def expanding_folds(frame: DataFrame, windows: Sequence[EvalWindow], ordinal: str, tests: Sequence[str] | None = None) -> DataFrame:
    """One long frame: every row once for each fold and part it belongs to. Rows in no window are dropped."""
    placed = in_windows(frame, windows, ordinal).drop("role", "may_select")
    parts = F.broadcast(frame.sparkSession.createDataFrame(fold_table(windows, tests), "fold string, window string, part string"))
    return placed.join(parts, "window")


def empty_parts(folds: DataFrame, windows: Sequence[EvalWindow]) -> DataFrame:
    """(fold, part) of the plan that have no rows."""
    plan = folds.sparkSession.createDataFrame(sorted({(f, p) for f, _, p in fold_table(windows)}), "fold string, part string")
    return plan.join(folds.select("fold", "part").distinct(), ["fold", "part"], "left_anti")


def assert_may_select(windows: Sequence[EvalWindow], names: Sequence[str]) -> None:
    known = {w.name: w for w in windows}
    bad = [n for n in names if n not in known or not known[n].may_select]
    if bad:
        raise ValueError(f"windows that may not select a model: {', '.join(sorted(bad))}")


def prediction_violations(expected: DataFrame, predicted: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, problem): keys missing, keys added or repeated, and predictions that aren't finite."""
    none = predicted.join(expected, list(key), "left_anti").select(*key, F.lit("not asked for").alias("problem"))
    lost = expected.join(predicted, list(key), "left_anti").select(*key, F.lit("missing").alias("problem"))
    twice = predicted.groupBy(*key).count().where("count > 1").select(*key, F.lit("repeated").alias("problem"))
    wild = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in columns))
    odd = predicted.where(wild).select(*key, F.lit("not finite").alias("problem"))
    return reduce(DataFrame.unionByName, [none, lost, twice, odd])


def walk_forward(
    folds: DataFrame,
    predictor: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame],
    *,
    key: Sequence[str],
    features: Sequence[str],
    targets: Sequence[str],
    retained: Sequence[str],
    names: Sequence[str],
    seeds: Sequence[int],
) -> DataFrame:
    """Fit and predict for each fold and seed. The predictor gets the training and calibration rows with targets, and of the test rows only keys and features; it returns keys and predictions.

    The retained predictions carry keys, fold, seed and the retained columns. Only the fits loop on the driver.
    """
    out = []
    for fold in names:
        own = folds.where(F.col("fold") == fold)
        train, calibration, test = (own.where(F.col("part") == p) for p in ("train", "calibration", "test"))
        learn = [*key, *features, *targets]
        for seed in seeds:
            predicted = predictor(train.select(*learn), calibration.select(*learn), test.select(*key, *features), seed)
            kept = test.select(*key, *dict.fromkeys([*targets, *retained]))
            out.append(kept.join(predicted, list(key), "left").withColumns({"fold": F.lit(fold), "seed": F.lit(seed)}))
    return reduce(DataFrame.unionByName, out)


def retained_violations(retained: DataFrame, key: Sequence[str], eligibility: str) -> DataFrame:
    """Keys repeated within a fold and seed, and rows without eligibility."""
    twice = retained.groupBy(*key, "fold", "seed").count().where("count > 1").select(*key, "fold", "seed", F.lit("repeated").alias("problem"))
    return twice.unionByName(retained.where(F.col(eligibility).isNull()).select(*key, "fold", "seed", F.lit("no eligibility").alias("problem")))
