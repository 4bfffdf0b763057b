"""Reports and promotion gates: what the metrics allow one to conclude."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import bootstrap
from .metrics import calibration_error, calibration_line, calibration_table, mean_over_groups, probability_metrics, ranking_metrics

RANKING = ("ndcg", "spearman", "mae", "rmse", "mean_bias", "top_overlap", "top1_hit")


def long_predictions(frame: DataFrame, keep: Sequence[str], models: Sequence[str]) -> DataFrame:
    """(keep, model, prediction) of the models that predict a row."""
    doubles = frame.select(*keep, *(F.col(m).cast("double").alias(m) for m in models))
    return doubles.unpivot(list(keep), list(models), "model", "prediction").where("prediction IS NOT NULL")


def model_report(frame: DataFrame, by: Sequence[str], models: Sequence[str], actual: str, key: Sequence[str]) -> DataFrame:
    """Mean ranking metrics over periods of every model, from one pass over the long table."""
    keep = list(dict.fromkeys([*by, "era", "period", *key, actual]))
    scores = ranking_metrics(long_predictions(frame, keep, models), [*by, "model", "era", "period"], actual, "prediction", key)
    return mean_over_groups(scores, [*by, "model"], RANKING)


def probability_report(frame: DataFrame, by: Sequence[str], models: Sequence[str], target: str, key: Sequence[str]) -> DataFrame:
    keep = list(dict.fromkeys([*by, "era", "period", *key, target]))
    scores = probability_metrics(long_predictions(frame, keep, models), [*by, "model", "era", "period"], target, "prediction", key)
    return mean_over_groups(scores, [*by, "model"], ("brier", "log_loss", "roc_auc", "pr_auc", "precision_10", "lift_10", "recall_10"))


def prediction_coverage(frame: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    counts = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in columns))
    return counts.unpivot([*by, "rows"], list(columns), "model", "present").withColumn("share", F.col("present") / F.col("rows").cast("double"))


def sanity(frame: DataFrame, key: Sequence[str], *, zero: str, actual: str) -> DataFrame:
    """One row: the zero model is zero, its error is the mean of |actual|, rows are unique."""
    gap = F.abs(F.avg(F.abs(F.col(zero) - F.col(actual))) - F.avg(F.abs(F.col(actual))))
    return frame.agg(F.bool_and(F.col(zero) == 0).alias("zero_is_zero"), (gap < 1e-9).alias("error_identity"), (F.count(F.lit(1)) == F.count_distinct(F.struct(*key))).alias("unique_rows"))


def go_or_stop(report: DataFrame, *, better: str, base: str) -> DataFrame:
    """GO if in every fold the better model has at least the base's NDCG or at most its error."""
    wide = report.where(F.col("model").isin(better, base)).groupBy("fold").agg(
        *(F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{n}_{c}") for m, n in ((better, "a"), (base, "b")) for c in ("ndcg", "mae"))
    )
    holds = (F.col("a_ndcg") >= F.col("b_ndcg")) | (F.col("a_mae") <= F.col("b_mae"))
    return wide.agg(F.when(F.bool_and(holds), "GO").otherwise("STOP").alias("recommendation"), F.count(F.lit(1)).alias("folds"))


def comparison_or_unavailable(deltas: DataFrame, order: Sequence[str], **options) -> DataFrame:
    """The bootstrap of the deltas, or status ``unavailable`` if any delta is NULL."""
    missing = deltas.agg(F.count_if(F.col("delta").isNull()).alias("missing"))
    found = bootstrap(deltas.where("delta IS NOT NULL"), order, **options).join(missing)  # one row each
    wanted = ("mean", "deviation", "low", "high")
    return found.select(F.when(F.col("missing") > 0, "unavailable").otherwise("available").alias("status"), "groups", *(F.when(F.col("missing") == 0, F.col(c)).alias(c) for c in wanted))


#: Conditions of a fold, in this order; the interval's only where there are intervals.
CONDITIONS = ("gains", "above_noise", "interval_holds", "spearman_holds", "error_holds", "bias_holds")


def fold_checks(
    report: DataFrame,
    noise: DataFrame,
    base: str,
    candidates: Sequence[str],
    *,
    intervals: DataFrame | None = None,
    noise_of_both: bool = False,
    unknown_noise: float | None = None,
    least_spearman: float = 0.0,
    most_error: float = 0.0,
    most_bias: float = 0.0,
) -> DataFrame:
    """Per candidate and fold: what it gains on the base model, the noise floor, which conditions hold, and whether all do.

    ``report``: fold, role, model and metrics; ``noise``: fold, model, range of its NDCG over seeds; ``intervals``:
    fold, model, low end of its paired interval. A fold without the base model or without a noise floor (and no
    ``unknown_noise`` to stand for it) passes nothing, nor does a metric that is NULL. ``noise_of_both`` takes the larger
    range of the two models.
    """
    own = report.where(F.col("model").isin(*candidates)).select("fold", "role", "model", *(F.col(c).alias(f"a_{c}") for c in ("ndcg", "spearman", "mae", "mean_bias")))
    other = report.where(F.col("model") == base).select("fold", *(F.col(c).alias(f"b_{c}") for c in ("ndcg", "spearman", "mae", "mean_bias")))
    both = own.join(other, "fold", "left").join(noise.select("fold", "model", F.col("range").alias("own_range")), ["fold", "model"], "left")
    both = both.join(noise.where(F.col("model") == base).select("fold", F.col("range").alias("base_range")), "fold", "left")
    if intervals is not None:
        both = both.join(intervals.select("fold", "model", "low"), ["fold", "model"], "left")
    own_range, base_range = (F.coalesce(c, F.lit(unknown_noise).cast("double")) for c in ("own_range", "base_range"))
    floor = F.when(own_range.isNotNull() & base_range.isNotNull(), F.greatest(own_range, base_range)) if noise_of_both else own_range
    gains = both.select(
        "*",
        (F.col("a_ndcg") - F.col("b_ndcg")).alias("ndcg_gain"),
        (F.col("a_spearman") - F.col("b_spearman")).alias("spearman_gain"),
        (F.col("a_mae") - F.col("b_mae")).alias("mae_change"),
        (F.abs("a_mean_bias") - F.abs("b_mean_bias")).alias("bias_change"),
        floor.alias("noise_floor"),
    )
    holds = {
        "gains": F.col("ndcg_gain") > 0,
        "above_noise": F.col("ndcg_gain") > F.col("noise_floor"),
        **({"interval_holds": F.col("low") >= 0} if intervals is not None else {}),
        "spearman_holds": F.col("spearman_gain") >= least_spearman,
        "error_holds": F.col("mae_change") <= most_error,
        "bias_holds": F.col("bias_change") <= most_bias,
    }
    checked = gains.select("model", "fold", "role", "ndcg_gain", "spearman_gain", "mae_change", "bias_change", "noise_floor", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in holds.items()))
    return checked.withColumn("passed", reduce(and_, (F.col(n) for n in holds)))


def _in(role: str) -> Column:
    return F.col("role") == role


def _confirmation(passed: Column, available: Column) -> Column:
    return F.when(~available, "not_available").when(passed, "passed").otherwise("failed")


def promotion(checks: DataFrame) -> DataFrame:
    """One row: KEEP if every discovery and confirmation fold passes, REJECT if one of either fails, INCONCLUSIVE without folds of a role (a failed discovery is rejected all the same)."""
    n, failed = (lambda r: F.count_if(_in(r))), (lambda r: F.count_if(_in(r) & ~F.col("passed")))
    own = checks.agg(n("discovery").alias("d"), failed("discovery").alias("d_failed"), n("confirmation").alias("c"), failed("confirmation").alias("c_failed"))
    discovery = (F.col("d") > 0) & (F.col("d_failed") == 0)
    result = _confirmation(F.col("c_failed") == 0, F.col("c") > 0)
    decision = F.when(F.col("d_failed") > 0, "REJECT").when((F.col("d") == 0) | (F.col("c") == 0), "INCONCLUSIVE").when(F.col("c_failed") > 0, "REJECT").otherwise("KEEP")
    return own.select(discovery.alias("discovery"), result.alias("confirmation"), decision.alias("decision"))


def probability_gate(reports: DataFrame, candidate: str, base: str, *, strict: bool = True, deltas: DataFrame | None = None, order: Sequence[str] = (), **options) -> DataFrame:
    """Per fold: whether the candidate's Brier score is below (or, not strict, at most) the base's; with ``deltas`` (fold, order, delta per period) also their resampled interval."""
    wide = reports.where(F.col("model").isin(candidate, base)).groupBy("fold").agg(F.max(F.when(F.col("model") == candidate, F.col("brier"))).alias("candidate"), F.max(F.when(F.col("model") == base, F.col("brier"))).alias("base"))
    passed = (F.col("candidate") < F.col("base")) if strict else (F.col("candidate") <= F.col("base"))
    found = wide.select("fold", "candidate", "base", F.coalesce(passed, F.lit(False)).alias("passed"))
    if deltas is None:
        return found
    return found.join(bootstrap(deltas, order, by=["fold"], **options).select("fold", "deviation", "low", "high"), "fold", "left")


def head_decisions(gate: DataFrame) -> DataFrame:
    """Per head (gate: head, fold, role, passed): KEEP if all folds of both roles pass, REJECT if not, INCONCLUSIVE without folds of a role."""
    have = (F.count_if(_in("discovery")) > 0) & (F.count_if(_in("confirmation")) > 0)
    failed = F.count_if(F.col("role").isin("discovery", "confirmation") & ~F.col("passed"))
    return gate.groupBy("head").agg(F.when(~have, "INCONCLUSIVE").when(failed == 0, "KEEP").otherwise("REJECT").alias("decision"))


def single_valued(frame: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """The value of a column per group, and whether it is the only one."""
    return frame.groupBy(*by).agg(F.min(column).alias(column), (F.count_distinct(column) == 1).alias("single"))


def confirmed_selection(checks: DataFrame) -> DataFrame:
    """One row: of the models that pass every discovery fold the one with the largest mean gain (the larger name on a tie), how it fares in confirmation, and the decision."""
    own = checks.groupBy("model").agg(
        F.avg(F.when(_in("discovery"), F.col("ndcg_gain"))).alias("mean_gain"),
        ((F.count_if(_in("discovery")) > 0) & (F.count_if(_in("discovery") & ~F.col("passed")) == 0)).alias("passes"),
        _confirmation(F.count_if(_in("confirmation") & ~F.col("passed")) == 0, F.count_if(_in("confirmation")) > 0).alias("confirmation"),
    )
    best = F.max_by(F.struct("model", "mean_gain", "confirmation"), F.when(F.col("passes"), F.struct("mean_gain", "model")))
    found = own.agg(best.alias("best")).select(F.col("best.model").alias("selected"), F.col("best.mean_gain").alias("mean_gain"), F.coalesce("best.confirmation", F.lit("not_applicable")).alias("confirmation"))
    return found.withColumn("decision", F.when(F.col("confirmation") == "passed", F.concat(F.lit("PROMOTE_"), F.upper("selected"))).otherwise("KEEP_BASE"))


def complete_rows(frame: DataFrame, signals: Sequence[str]) -> Column:
    """All signals are there."""
    out = F.lit(True)
    for c in signals:
        out = out & F.col(c).isNotNull()
    return out


def flag_violations(frame: DataFrame, key: Sequence[str], signals: Sequence[str], flag: str) -> DataFrame:
    """(key, problem): rows whose supplied flag of completeness is NULL, or says other than the signals do."""
    problem = F.when(F.col(flag).isNull(), "no flag").when(F.col(flag) & ~complete_rows(frame, signals), "flagged though a signal is missing").when(~F.col(flag) & complete_rows(frame, signals), "not flagged though all signals are there")
    return frame.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def probability_evidence(frame: DataFrame, heads: Mapping[str, tuple[str, str, str]], key: Sequence[str]) -> DataFrame:
    """A row for each head (name: target, model's and base's probability): both Brier scores, their difference, whether the model's is at most the base's, and how well it is calibrated (error, intercept and slope; the line is NULL with one class only)."""
    found = []
    for name, (target, model, base) in heads.items():
        report = probability_report(frame.withColumn("_all", F.lit(0)), ["_all"], [model, base], target, key)
        wide = report.agg(*(F.max(F.when(F.col("model") == m, F.col("brier"))).alias(n) for m, n in ((model, "brier"), (base, "base_brier"))))
        error = calibration_error(calibration_table(frame.withColumn("_all", F.lit(0)), ["_all"], target, model), ["_all"]).drop("_all")
        line = calibration_line(frame, target, model) or (None, None)
        found.append(wide.join(error).select(F.lit(name).alias("head"), "brier", "base_brier", (F.col("brier") - F.col("base_brier")).alias("delta"), (F.col("brier") <= F.col("base_brier")).alias("passed"), "calibration_error", *(F.lit(v).cast("double").alias(n) for n, v in zip(("intercept", "slope"), line))))
    return reduce(DataFrame.unionByName, found)


def arm_differences(arms: DataFrame, key: Sequence[str], target: str) -> DataFrame:
    """Keys that some arm lacks, or where the target differs between arms."""
    n = arms.agg(F.count_distinct("arm").alias("arms"))
    counts = arms.groupBy(*key, "fold").agg(F.count_distinct("arm").alias("n"), F.count_distinct(F.coalesce(F.col(target).cast("string"), F.lit("null"))).alias("targets"))
    return counts.join(F.broadcast(n)).where((F.col("n") != F.col("arms")) | (F.col("targets") > 1)).select(*key, "fold", "n", "targets")


def arm_deltas(scores: DataFrame, base: str, by: Sequence[str], metric: str) -> DataFrame:
    """Each arm's metric less the base arm's, per group, on the same rows."""
    reference = scores.where(F.col("arm") == base)
    joined = scores.where(F.col("arm") != base).select("arm", *by, F.col(metric).alias("_a"), "rows", "key_hash").join(reference.select(*by, F.col(metric).alias("_b"), F.col("rows").alias("_rows"), F.col("key_hash").alias("_hash")), list(by))
    return joined.select("arm", *by, (F.col("_a") - F.col("_b")).alias("delta"), ((F.col("rows") == F.col("_rows")) & (F.col("key_hash") == F.col("_hash"))).alias("same_rows"))


def candidate_gate(checks: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """Per arm (``fold_checks`` of the discovery folds, with intervals): its mean gain, the largest noise floor, whether it passes in all folds.

    ``exact`` (arm, delta): what the full source gains on the arm on the rows that it has, per fold. An arm that leaves
    the source out passes only if there are such deltas, and none is above zero.
    """
    gate = checks.groupBy(F.col("model").alias("arm")).agg(F.avg("ndcg_gain").alias("mean_gain"), F.max("noise_floor").alias("noise_floor"), F.bool_and("passed").alias("passed"))
    if exact is None:
        return gate
    guard = exact.groupBy("arm").agg(F.coalesce(F.bool_and(F.coalesce(F.col("delta") <= 0, F.lit(False))), F.lit(False)).alias("_exact"))
    return gate.join(guard, "arm", "left").select("arm", "mean_gain", "noise_floor", (F.col("passed") & F.coalesce("_exact", F.lit(True))).alias("passed"))


def base_gate(checks: DataFrame) -> DataFrame:
    """One row: whether the selected arm passes every fold against the standing model."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))


def selected_arm(gate: DataFrame, base: str) -> DataFrame:
    """The passed arm with the largest mean gain, the larger name on a tie; the base arm if none passed."""
    best = F.max_by("arm", F.when(F.col("passed"), F.struct("mean_gain", "arm")))
    return gate.agg(F.coalesce(best, F.lit(base)).alias("selected"))


def ablation_verdicts(gate: DataFrame, selected: DataFrame) -> DataFrame:
    """SELECTED, NOT_SELECTED, REJECT (it lost) or INCONCLUSIVE (a gain within the noise) for each arm."""
    verdict = F.when(F.col("arm") == F.col("selected"), "SELECTED").when(F.col("passed"), "NOT_SELECTED").when(F.col("mean_gain") <= 0, "REJECT").otherwise("INCONCLUSIVE")
    return gate.join(F.broadcast(selected)).select("arm", "mean_gain", "noise_floor", "passed", verdict.alias("verdict"))


def negative_results(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict") != "SELECTED").select("arm", "verdict", "mean_gain")


def confirmation_checks(checks: DataFrame, *, selection: DataFrame, discovery: DataFrame, calibration: DataFrame, audit: DataFrame) -> DataFrame:
    """One row of the nine checks of a confirmation.

    ``checks``: ``fold_checks`` of the confirmation folds, with intervals; ``selection``: confirmation_observed;
    ``discovery``: passed against the standing model; ``calibration``: passed, a row for every head and fold of both
    roles; ``audit``: passed. What is missing doesn't hold.
    """

    def every(frame: DataFrame, condition: Column, name: str) -> DataFrame:
        return frame.agg(F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(False)).alias(name))

    own = checks.agg(*(F.coalesce(F.bool_and(c), F.lit(False)).alias(f"confirmation_{c}") for c in ("above_noise", "interval_holds", "spearman_holds", "error_holds", "bias_holds")))
    parts = [
        every(selection, ~F.col("confirmation_observed"), "selected_on_discovery_only"),
        every(discovery, F.col("passed"), "discovery_passed"),
        own,
        every(calibration, F.col("passed"), "calibrated"),
        every(audit, F.col("passed"), "reproducible"),
    ]
    return reduce(lambda x, y: x.join(y), parts)  # one row each


def confirmation_gate(checks: DataFrame) -> DataFrame:
    """One row of booleans: the decision and the names of those that fail."""
    names = checks.columns
    failed = F.filter(F.array(*(F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in names)), lambda x: x.isNotNull())
    return checks.withColumn("failed", failed).withColumn("decision", F.when(F.size("failed") == 0, "PROMOTE").otherwise("HOLD"))
