"""Folds, metrics, cohorts, comparisons, baselines, boosted heads and gates over the tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import period_ordinal
from ..operators import baselines, cohorts, compare, folds, gates, heads, metrics, study
from ..sources.scratch import scratch_path, stored
from .common import CHANCES_SQL, SCORED_SQL, chances, rounded, scored
from .registry import query, table

KEY = ["entity"]
BY = ["era", "period"]


def _ordinal():
    return period_ordinal(F.col("era"), F.col("period"), 12)


WINDOWS = [folds.EvalWindow(f"w{k}", (1995 + k) * 12, (1995 + k) * 12 + 11, "discovery" if k < 4 else "confirmation") for k in range(6)]
TESTS = ["w2", "w3", "w4", "w5"]
FOLDS_SQL = f"WITH s AS ({SCORED_SQL}), w AS (SELECT *, era * 12 + period - 1 AS ord, era - 1995 AS k FROM s WHERE era BETWEEN 1995 AND 2000), f AS (SELECT w.*, 'w' || t.k AS fold, CASE WHEN w.k = t.k THEN 'test' WHEN w.k = t.k - 1 THEN 'calibration' ELSE 'train' END AS part FROM w JOIN (SELECT unnest(range(2, 6)) AS k) t ON w.k <= t.k)"


def folded(spark: SparkSession, sf_dir: str, tests: Sequence[str] | None = None) -> DataFrame:
    return folds.expanding_folds(scored(spark, sf_dir).withColumn("ord", _ordinal()), WINDOWS, "ord", tests)


@query("h_folds", FOLDS_SQL + " SELECT fold, part, 'w' || k AS \"window\", count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord FROM f GROUP BY 1, 2, 3")
def h_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).groupBy("fold", "part", "window").agg(F.count(F.lit(1)).alias("n"), F.min("ord").cast("long").alias("first_ord"), F.max("ord").cast("long").alias("last_ord"))


@query("h_windows", f"WITH s AS ({SCORED_SQL}) SELECT entity, 'w' || (era - 1995) AS \"window\", CASE WHEN era < 1999 THEN 'discovery' ELSE 'confirmation' END AS role, era < 1999 AS may_select FROM s WHERE era BETWEEN 1995 AND 2000")
def h_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.in_windows(scored(spark, sf_dir).withColumn("ord", _ordinal()), WINDOWS, "ord").select("entity", "window", "role", "may_select")


@query(
    "h_predictions_check",
    "SELECT o_orderkey AS entity, 'missing' AS problem FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'repeated' FROM orders WHERE o_orderkey % 7 = 1 UNION ALL SELECT o_orderkey, 'not finite' FROM orders WHERE o_orderkey % 7 = 2 UNION ALL SELECT -o_orderkey, 'not asked for' FROM orders WHERE o_orderkey % 7 = 3",
)
def h_predictions_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"))
    digit = F.col("entity") % 7
    base = expected.where(digit != 0).withColumn("p", F.when(digit != 2, 1.0))
    extra = base.where(digit == 1).unionByName(expected.where(digit == 3).select((-F.col("entity")).alias("entity"), F.lit(0.5).alias("p")))
    return folds.prediction_violations(expected, base.unionByName(extra), ["entity"], ["p"])


RANK = f"""WITH s AS ({SCORED_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY era, period ORDER BY p DESC, entity) AS rp, row_number() OVER (PARTITION BY era, period ORDER BY y DESC, entity) AS ra, least(count(*) OVER (PARTITION BY era, period), 10) AS k,
 rank() OVER (PARTITION BY era, period ORDER BY p) + (count(*) OVER (PARTITION BY era, period, p) - 1) / 2.0::DOUBLE AS ap, rank() OVER (PARTITION BY era, period ORDER BY y) + (count(*) OVER (PARTITION BY era, period, y) - 1) / 2.0::DOUBLE AS aa FROM s),
 m AS (SELECT era, period, count(*) AS rows, coalesce(sum(CASE WHEN rp <= k THEN greatest(y, 0) / log2(rp + 1) END) / nullif(sum(CASE WHEN ra <= k THEN greatest(y, 0) / log2(ra + 1) END), 0), 0) AS ndcg,
 CASE WHEN min(ap) < max(ap) AND min(aa) < max(aa) THEN covar_pop(ap, aa) / nullif(stddev_pop(ap) * stddev_pop(aa), 0) END AS spearman, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(p - y) AS mean_bias,
 count(*) FILTER (WHERE rp <= k AND ra <= k) / CAST(max(k) AS DOUBLE) AS top_overlap, max(CASE WHEN rp = 1 AND ra <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS top1_hit, sha256(array_to_string(list_sort(list(CAST(entity AS VARCHAR))), chr(10))) AS key_hash FROM r GROUP BY 1, 2)"""
METRICS = "round(ndcg, 6) AS ndcg, round(spearman, 6) AS spearman, round(mae + 1.3e-6, 4) AS mae, round(rmse + 1.3e-6, 4) AS rmse, round(mean_bias + 1.3e-6, 4) AS mean_bias, round(top_overlap, 6) AS top_overlap, top1_hit"


def _fit(frame: DataFrame) -> DataFrame:
    """Ratios to six digits, amounts to four, off exact halves."""
    amounts = ("mae", "rmse", "mean_bias")
    return frame.select(*((F.round(F.col(c) + 1.3e-6, 4) if c in amounts else F.round(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes))


@query("i_ranking", RANK + f" SELECT era, period, rows, {METRICS}, key_hash FROM m")
def i_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(metrics.ranking_metrics(stored(scored(spark, sf_dir), "scored"), BY, "y", "p", KEY, with_hash=True))


@query("i_ranking_summary", RANK + " SELECT count(*) AS groups, round(avg(ndcg), 6) AS ndcg, round(avg(spearman), 6) AS spearman, round(avg(mae) + 1.3e-6, 4) AS mae, round(avg(top_overlap), 6) AS top_overlap FROM m")
def i_ranking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics.ranking_metrics(scored(spark, sf_dir), BY, "y", "p", KEY)
    return _fit(metrics.mean_over_groups(own, [], ["ndcg", "spearman", "mae", "top_overlap"]))


PROB = f"""WITH s AS ({CHANCES_SQL}), r AS (SELECT *, CAST(y AS DOUBLE) AS yd, row_number() OVER (PARTITION BY era, period ORDER BY p DESC, entity) AS n, rank() OVER (PARTITION BY era, period ORDER BY p) + (count(*) OVER (PARTITION BY era, period, p) - 1) / 2.0::DOUBLE AS a FROM s),
 d AS (SELECT era, period, p, sum(CAST(y AS DOUBLE)) AS y, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY 1, 2, 3), q AS (SELECT *, sum(y) OVER w / sum(n) OVER w AS prec, y / nullif(sum(y) OVER (PARTITION BY era, period), 0) AS gain FROM d WINDOW w AS (PARTITION BY era, period ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
 ap AS (SELECT era, period, sum(prec * gain) AS pr_auc FROM q GROUP BY 1, 2),
 m AS (SELECT era, period, count(*) AS rows, sum(yd) AS positives, avg((p - yd) * (p - yd)) AS brier, -avg(yd * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) + (1 - yd) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS log_loss,
 (sum(CASE WHEN y = 1 THEN a END) - sum(yd) * (sum(yd) + 1) / 2) / nullif(sum(yd) * (count(*) - sum(yd)), 0) AS roc_auc, sum(CASE WHEN n <= 10 THEN yd ELSE 0 END) / least(count(*), 10) AS precision_10, sum(CASE WHEN n <= 20 THEN yd ELSE 0 END) / nullif(sum(yd), 0) AS recall_20, sum(yd) / count(*) AS rate FROM r GROUP BY 1, 2)"""


@query("i_probability", PROB + " SELECT era, period, rows, positives, round(brier + 1.3e-9, 6) AS brier, round(log_loss + 1.3e-9, 6) AS log_loss, round(roc_auc + 1.3e-9, 6) AS roc_auc, round(pr_auc + 1.3e-9, 6) AS pr_auc, round(precision_10 + 1.3e-9, 6) AS precision_10, round(precision_10 / nullif(rate, 0) + 1.3e-9, 6) AS lift_10, round(recall_20 + 1.3e-9, 6) AS recall_20 FROM m JOIN ap USING (era, period)")
def i_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics.probability_metrics(stored(chances(spark, sf_dir), "chances"), BY, "y", "p", KEY)
    return rounded(own.select("era", "period", "rows", "positives", "brier", "log_loss", "roc_auc", "pr_auc", "precision_10", "lift_10", "recall_20"), nudge=1.3e-9)


EDGES = " ".join(f"WHEN p >= CAST('{e!r}' AS DOUBLE) THEN {k}" for k, e in reversed(list(enumerate(metrics.linspace(10)[:-1]))))
CAL = f"WITH s AS ({CHANCES_SQL}), t AS (SELECT CASE {EDGES} END AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS DOUBLE)) AS ob FROM s GROUP BY 1)"


@query("i_calibration", CAL + " SELECT bin, n, round(mp, 6) AS mean_probability, round(ob, 6) AS observed FROM t")
def i_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_table(chances(spark, sf_dir), [], "y", "p"))


@query("i_calibration_error", CAL + " SELECT round(sum(n * abs(ob - mp)) / sum(n), 6) AS calibration_error FROM t")
def i_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_error(metrics.calibration_table(chances(spark, sf_dir), [], "y", "p"), []))


@query("i_monotonicity", f"WITH s AS ({CHANCES_SQL}) SELECT era, round(avg(CASE WHEN q > p + 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM s GROUP BY 1")
def i_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(chances(spark, sf_dir).groupBy("era").agg(metrics.monotonicity_violation_rate(F.col("q"), F.col("p")).alias("rate")))


@query("i_calibration_line")
def i_calibration_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: an iterative fit. A test compares it with the same objective solved directly."""
    smooth = chances(spark, sf_dir).withColumn("p", F.col("p") * 0.8 + 0.1)
    line = metrics.calibration_line(smooth, "y", "p") or (None, None)
    return spark.createDataFrame([line], "intercept double, slope double").crossJoin(smooth.agg(F.count(F.lit(1)).alias("rows")))


COHORT_SQL = """unnest(list_filter(['all', CASE WHEN exposure > 0 THEN 'played' END, CASE WHEN exposure >= 60 THEN 'long' END, CASE WHEN position = '1-URGENT' THEN 'position_1-URGENT' END, CASE WHEN position = '5-LOW' THEN 'position_5-LOW' END, CASE WHEN n_occurrences = 1 THEN 'single' END, CASE WHEN n_occurrences > 1 THEN 'multi' END,
 CASE WHEN period <= 5 THEN 'early' END, CASE WHEN period > 5 THEN 'established' END, CASE WHEN status = 'O' THEN 'available' END, CASE WHEN status <> 'O' THEN 'flagged' END], lambda x: x IS NOT NULL))"""


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = cohorts.cohort_names(exposure=F.col("exposure"), position=F.col("position"), n_occurrences=F.col("n_occurrences"), period=F.col("period"), status=F.when(F.col("status") == "O", "a").otherwise("d"), positions=("1-URGENT", "5-LOW"))
    return cohorts.with_cohorts(scored(spark, sf_dir), names)


@query("j_cohorts", f"WITH s AS ({SCORED_SQL}), c AS (SELECT *, {COHORT_SQL} AS cohort FROM s) SELECT cohort, count(*) AS n, round(sum(y), 2) AS total FROM c GROUP BY 1")
def j_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cohorts(spark, sf_dir).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("total"))


@query("j_cohort_metrics", f"WITH s AS ({SCORED_SQL}), c AS (SELECT *, {COHORT_SQL} AS cohort FROM s), g AS (SELECT cohort, era, period, avg(abs(p - y)) AS mae, avg(p - y) AS b FROM c GROUP BY 1, 2, 3) SELECT cohort, count(*) AS groups, round(avg(mae) + 1.3e-6, 4) AS mae, round(avg(b) + 1.3e-6, 4) AS mean_bias FROM g GROUP BY 1")
def j_cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics.ranking_metrics(_cohorts(spark, sf_dir), ["cohort", *BY], "y", "p", KEY)
    return _fit(metrics.mean_over_groups(own, ["cohort"], ["mae", "mean_bias"]))


@query(
    "k_row_differences",
    "SELECT o_orderkey AS entity, CASE WHEN o_orderkey % 9 = 0 THEN 'extra' WHEN o_orderkey % 9 = 1 THEN 'missing' ELSE 'differs' END AS problem FROM orders WHERE o_orderkey % 9 IN (0, 1, 2)",
)
def k_row_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_totalprice").alias("y"))
    digit = F.col("entity") % 9
    return compare.row_differences(rows.where(digit != 1), rows.where(digit != 0).withColumn("y", F.when(digit != 2, F.col("y"))), ["entity"], ["y"])


DELTA = f"WITH s AS ({SCORED_SQL}), g AS (SELECT era, period, avg(abs(p - y)) AS a, avg(abs(q - y)) AS b FROM s GROUP BY 1, 2), d AS (SELECT era, period, a, b, a - b AS delta, row_number() OVER (ORDER BY era, period) - 1 AS place, count(*) OVER () AS n FROM g)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    a, b = (metrics.ranking_metrics(rows, BY, "y", c, KEY, with_hash=True) for c in ("p", "q"))
    return compare.paired_deltas(a, b, BY, "mae")


@query("k_paired_deltas", DELTA + " SELECT era, period, round(a + 1.3e-6, 4) AS candidate, round(b + 1.3e-6, 4) AS baseline, round(delta + 1.3e-6, 4) AS delta, true AS same_rows FROM d")
def k_paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_deltas(spark, sf_dir), 4, 1.3e-6)


@query(
    "k_bootstrap",
    DELTA
    + """, x AS (SELECT b.s, ('0x' || substr(md5('42|' || b.s || '|' || d.place), 1, 8))::BIGINT % d.n AS pick FROM d, (SELECT unnest(range(0, 2000)) AS s) b), m AS (SELECT x.s, avg(d.delta) AS m FROM x JOIN d ON d.place = x.pick GROUP BY 1)
 SELECT (SELECT round(avg(delta), 4) FROM d) AS mean, (SELECT count(*) FROM d) AS groups, round(stddev_samp(m), 4) AS deviation, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""",
)
def k_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.bootstrap(_deltas(spark, sf_dir), BY), 4)


SEEDED = f"WITH s AS ({SCORED_SQL}), z AS (SELECT era, seed, avg(abs(p * (1 + seed / 100.0::DOUBLE) - y)) AS mae, avg(p * (1 + seed / 100.0::DOUBLE) - y) AS b FROM s, (SELECT unnest([1, 2, 3]) AS seed) GROUP BY 1, 2)"


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed")).withColumn("p", F.col("p") * (1 + F.col("seed") / F.lit(100.0)))
    return rows.groupBy("era", "seed").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.avg(F.col("p") - F.col("y")).alias("mean_bias"))


@query("k_seed_summary", SEEDED + " SELECT era, round(avg(mae), 4) AS mean, round(stddev_samp(mae), 4) AS deviation, arg_min(seed, mae) AS best_seed, arg_max(seed, mae) AS worst_seed, round(max(mae) - min(mae), 4) AS range FROM z GROUP BY 1")
def k_seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.seed_summary(_seeded(spark, sf_dir), ["era"], "mae", higher_is_better=False), 4)


@query("k_seed_noise", SEEDED + ", l AS (SELECT era, 'mae' AS metric, seed, mae AS v, mae AS c FROM z UNION ALL SELECT era, 'mean_bias', seed, b, abs(b) FROM z) SELECT era, metric, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS deviation, round(max(v) - min(v), 4) AS range, arg_min(seed, c) AS best_seed FROM l GROUP BY 1, 2")
def k_seed_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _seeded(spark, sf_dir).unpivot(["era", "seed"], ["mae", "mean_bias"], "metric", "value")
    return rounded(compare.seed_noise(long, ["era"]), 4)


# --- baselines and models ---------------------------------------------------------------------------


@query(
    "l_rates",
    FOLDS_SQL + ", b AS (SELECT fold, avg(CASE WHEN y > 200000 THEN 1.0 ELSE 0.0 END) AS base FROM f WHERE part = 'train' GROUP BY 1) SELECT f.fold, entity, round(coalesce(CASE WHEN entity % 3 <> 0 THEN (entity % 10) / 10.0 END, base), 6) AS pred_high FROM f JOIN b USING (fold) WHERE part = 'test'",
)
def l_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = folded(spark, sf_dir).withColumns({"high": (F.col("y") > 200000).cast("int"), "rate": F.when(F.col("entity") % 3 != 0, (F.col("entity") % 10) / F.lit(10.0))})
    train, test = (own.where(F.col("part") == p) for p in ("train", "test"))
    rates = baselines.base_rates(train, ["fold"], ["high"])
    return rounded(baselines.rate_or_base(test, rates, ["fold"], "rate", "high").select("fold", "entity", "pred_high"))


@query(
    "l_group_means",
    FOLDS_SQL + ", a AS (SELECT fold, avg(y) AS m FROM f WHERE part = 'train' GROUP BY 1), g AS (SELECT fold, position, status, avg(y) AS m FROM f WHERE part = 'train' GROUP BY 1, 2, 3) SELECT f.fold, entity, round(coalesce(g.m, a.m), 4) AS pred FROM f JOIN a USING (fold) LEFT JOIN g ON g.fold = f.fold AND g.position = f.position AND g.status = f.status WHERE part = 'test'",
)
def l_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = folded(spark, sf_dir)
    train, test = (own.where(F.col("part") == p) for p in ("train", "test"))
    return rounded(baselines.group_means(train, test, ["fold"], ["position", "status"], "y", "pred").select("fold", "entity", "pred"), 4)


@query(
    "l_history",
    "SELECT event_id, 0.0::DOUBLE AS pred_zero, coalesce(CAST(nullif(event_id % 7, 0) AS DOUBLE), 0) AS pred_last, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS pred_last5, value AS pred_price, CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has_last, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has_last5 FROM events",
)
def l_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    last, mean5 = F.nullif(F.col("event_id") % 7, F.lit(0)), F.when(F.col("event_type") != "view", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in baselines.history_baselines(last, mean5, F.col("value")).items()))


def _prepared(spark: SparkSession, sf_dir: str) -> dict[str, study.Parts]:
    """Training, calibration and test rows of each fold with features fitted on the training part; written, as fits read them many times."""
    own = folded(spark, sf_dir).select("fold", "part", "entity", (F.col("y") / 1e5).alias("label"), "p", F.when(F.col("entity") % 29 != 0, F.col("q")).alias("q"), "exposure", F.col("n_occurrences").cast("double").alias("n_occurrences"), "position")
    own = stored(own, "folds")

    def one(fold: str) -> study.Parts:
        train, calibration, test = (own.where((F.col("fold") == fold) & (F.col("part") == part)) for part in ("train", "calibration", "test"))
        model = baselines.preprocessor(["p", "q", "exposure", "n_occurrences"], ["position"]).fit(train)
        return study.stored_parts(study.Parts(*map(model.transform, (train, calibration, test))), ["fold", "entity", "label"])

    return study.at_once(spark, one, TESTS)


@query("l_linear_models")
def l_linear_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: fits. Tests compare the same functions with closed forms."""
    kept = []
    for parts in _prepared(spark, sf_dir).values():
        train, test = parts.train, parts.test
        out = baselines.ridge(train, test, "label", "pred")
        high = F.when(F.col("label") > 2, 1.0).otherwise(0.0)
        kept.append(baselines.logistic(train.withColumn("high", high), out, "high", "p_high").select("entity", "pred", "p_high"))
    return reduce(DataFrame.unionByName, kept).select("entity", F.round("pred", 6).alias("pred"), F.round(baselines.clipped(F.col("pred"), 0.0), 6).alias("pred_clipped"), F.round("p_high", 6).alias("p_high"))


#: Declared for all fits over the tables: at most 40 rounds, stopped after 6 without a smaller error.
CONFIG = heads.Boosting(rounds=40, patience=6, depth=4)


@query("m_boosted_heads")
def m_boosted_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: boosted trees. Fits see the training part, the regressor stops by the calibration block, and both are averaged over two seeds."""
    path, fits = scratch_path(spark, "heads"), {}
    for fold, parts in _prepared(spark, sf_dir).items():
        train, calibration, test = (x.withColumn("high", (F.col("label") > 2).cast("double")) for x in (parts.train, parts.calibration, parts.test))

        def fit(seed: int, train: DataFrame = train, calibration: DataFrame = calibration, test: DataFrame = test) -> DataFrame:
            out = heads.boosted_regressor(train, calibration, test, "label", "raw", seed=seed, config=CONFIG)
            own, out = heads.boosted_classifier(train, [calibration, out], "high", "p_raw", seed=seed, config=CONFIG)
            own = stored(own.select("high", "p_raw"), "chances")
            line = heads.platt_line(own, "high", "p_raw")
            return out.select("entity", "fold", F.lit(seed).alias("seed"), "raw", heads.calibrated(F.col("p_raw"), line).alias("p_high"))

        fits |= {f"{fold}-{seed}": partial(fit, seed) for seed in (42, 7)}
    both = heads.mean_ensemble(study.run_all(spark, fits, path), ["entity"], ["raw", "p_high"], lowest=0.0)
    return rounded(heads.collapsed(both, ["entity"], ["fold"], ["raw_mean", "p_high_mean"]).select("entity", "raw_mean", "p_high_mean", "varies"))


COHERENT = f"WITH s AS ({CHANCES_SQL}), n AS (SELECT *, entity % 3 AS k FROM s), a AS (SELECT era, entity, k, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE p END AS p1, CASE WHEN k * 45 < 60 THEN 0.0::DOUBLE ELSE least(q, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE p END) END AS p2 FROM n)"


def _coherent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("entity") % 3
    made = heads.coherent(p_played=F.col("p"), p_long=F.col("q"), exposure_if_played=F.lit(70.0), outcome_if_played=(F.col("entity") % 5).cast("double"), n_occurrences=k, most=k * 45)
    return chances(spark, sf_dir).select("era", "entity", k.alias("k"), *(c.alias(n) for n, c in made.items()))


@query("m_coherent", COHERENT + " SELECT era, entity, k, round(p1, 6) AS p_played, round(p2, 6) AS p_long, round(least(greatest(p1 * 70, 60 * p2), 90 * k * p1), 6) AS expected_exposure, round(p1 * (entity % 5), 6) AS expected_outcome FROM a")
def m_coherent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_coherent(spark, sf_dir))


@query(
    "n_coherence",
    f"WITH s AS ({CHANCES_SQL}) SELECT count(*) FILTER (WHERE entity % 3 = 0 AND p > 0) AS blank_played, count(*) FILTER (WHERE q > p + 1e-12) AS long_above_played, CAST(0 AS BIGINT) AS played_outside, CAST(0 AS BIGINT) AS long_outside, count(*) FILTER (WHERE 50 * p < 60 * q - 1e-9) AS exposure_low, count(*) FILTER (WHERE 50 * p > 90 * (entity % 3) * p + 1e-9) AS exposure_high FROM s",
)
def n_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, k = F.col("p"), F.col("q"), F.col("entity") % 3
    return chances(spark, sf_dir).agg(*heads.coherence_counts(p_played=p, p_long=q, exposure=50 * p, n_occurrences=k))


@query("n_coherence_after", "SELECT 0::BIGINT AS blank_played, 0::BIGINT AS long_above_played, 0::BIGINT AS played_outside, 0::BIGINT AS long_outside, 0::BIGINT AS exposure_low, 0::BIGINT AS exposure_high FROM lineitem HAVING count(*) > 0")
def n_coherence_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _coherent(spark, sf_dir)
    return own.agg(*heads.coherence_counts(p_played=F.col("p_played"), p_long=F.col("p_long"), exposure=F.col("expected_exposure"), n_occurrences=F.col("k")))


@query(
    "m_blend_weight",
    f"""WITH s AS ({SCORED_SQL}), b AS (SELECT era, period, entity, y, w / 20.0::DOUBLE AS weight, (w / 20.0::DOUBLE) * p + (1 - w / 20.0::DOUBLE) * q AS v FROM s, (SELECT unnest(range(0, 21)) AS w)), r AS (SELECT *, row_number() OVER (PARTITION BY weight, era, period ORDER BY v DESC, entity) AS rp, row_number() OVER (PARTITION BY weight, era, period ORDER BY y DESC, entity) AS ra, least(count(*) OVER (PARTITION BY weight, era, period), 10) AS k FROM b),
 m AS (SELECT era, period, weight, coalesce(sum(CASE WHEN rp <= k THEN y / log2(rp + 1) END) / nullif(sum(CASE WHEN ra <= k THEN y / log2(ra + 1) END), 0), 0) AS ndcg, avg(abs(v - y)) AS mae FROM r GROUP BY 1, 2, 3), a AS (SELECT era, weight, round(avg(ndcg), 12) AS ndcg, -round(avg(mae), 12) AS mae FROM m GROUP BY 1, 2) SELECT era, arg_max(weight, (ndcg, mae, weight)) AS weight FROM a GROUP BY 1""",
)
def m_blend_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.blend_weight(scored(spark, sf_dir), ["era"], KEY, "y", "p", "q")


ENSEMBLE = f"WITH s AS ({SCORED_SQL}), e AS (SELECT era, entity, seed, p * (1 + seed / 100.0::DOUBLE) - 150000 AS raw FROM s, (SELECT unnest([1, 2, 3]) AS seed) WHERE NOT (entity % 50 = 0 AND seed = 3))"


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("era", "entity", "p", F.lit("w").alias("fold"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed"))
    return rows.where(~((F.col("entity") % 50 == 0) & (F.col("seed") == 3))).withColumn("raw", F.col("p") * (1 + F.col("seed") / F.lit(100.0)) - 150000)


@query("m_mean_ensemble", ENSEMBLE + " SELECT entity, 'w' AS fold, round(greatest(avg(raw), 0) + 1.3e-6, 4) AS raw_mean, false AS varies FROM e GROUP BY 1")
def m_mean_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = heads.mean_ensemble(_retained(spark, sf_dir), ["entity"], ["raw"], lowest=0.0)
    return rounded(heads.collapsed(both, ["entity"], ["era"], ["raw_mean"]).select("entity", "fold", "raw_mean", "varies"), 4, 1.3e-6)


@query("m_incomplete_seeds", ENSEMBLE + " SELECT entity, 'w' AS fold, array_to_string(list_sort(list(seed)), ',') AS seeds FROM e GROUP BY 1 HAVING count(*) < 3")
def m_incomplete_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.incomplete_seeds(_retained(spark, sf_dir), ["entity"], [1, 2, 3]).select("entity", "fold", F.array_join(F.col("seeds").cast("array<string>"), ",").alias("seeds"))


@query("m_target_violations", f"WITH s AS ({CHANCES_SQL}) SELECT entity, era, period, CASE WHEN (entity % 90 > 0) <> (y = 1) THEN 'played' WHEN (entity % 90 >= 60) <> (entity % 2 = 1) THEN 'long' END AS problem FROM s WHERE (entity % 90 > 0) <> (y = 1) OR (entity % 90 >= 60) <> (entity % 2 = 1)")
def m_target_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chances(spark, sf_dir).select("entity", "era", "period", "y", (F.col("entity") % 90).alias("x"), (F.col("entity") % 2).cast("int").alias("l"))
    return heads.target_violations(rows, ["entity", "era", "period"], exposure="x", played="y", long="l")


# --- reports and gates ------------------------------------------------------------------------------


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = folded(spark, sf_dir).where("part = 'test'").withColumn("zero", F.lit(0.0))
    return gates.model_report(tests, ["fold"], ["p", "q", "zero"], "y", KEY)


MODELS = FOLDS_SQL + """, l AS (SELECT fold, era, period, entity, y, model, v FROM (SELECT fold, era, period, entity, y, p, q, 0.0::DOUBLE AS zero FROM f WHERE part = 'test') UNPIVOT (v FOR model IN (p, q, zero))),
 r AS (SELECT *, row_number() OVER w AS rp, row_number() OVER (PARTITION BY fold, model, era, period ORDER BY y DESC, entity) AS ra, least(count(*) OVER (PARTITION BY fold, model, era, period), 10) AS k FROM l WINDOW w AS (PARTITION BY fold, model, era, period ORDER BY v DESC, entity)),
 m AS (SELECT fold, model, era, period, coalesce(sum(CASE WHEN rp <= k THEN y / log2(rp + 1) END) / nullif(sum(CASE WHEN ra <= k THEN y / log2(ra + 1) END), 0), 0) AS ndcg, avg(abs(v - y)) AS mae, avg(v - y) AS mean_bias FROM r GROUP BY 1, 2, 3, 4), rep AS (SELECT fold, model, count(*) AS groups, avg(ndcg) AS ndcg, avg(mae) AS mae, avg(mean_bias) AS mean_bias FROM m GROUP BY 1, 2)"""


@query("n_model_report", MODELS + " SELECT fold, model, groups, round(ndcg, 6) AS ndcg, round(mae + 1.3e-6, 4) AS mae, round(mean_bias + 1.3e-6, 4) AS mean_bias FROM rep")
def n_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(_report(spark, sf_dir).select("fold", "model", "groups", "ndcg", "mae", "mean_bias"))


@query("n_go_or_stop", MODELS + " SELECT CASE WHEN bool_and(a.ndcg >= b.ndcg OR a.mae <= b.mae) THEN 'GO' ELSE 'STOP' END AS recommendation, count(*) AS folds FROM rep a JOIN rep b ON a.fold = b.fold AND a.model = 'p' AND b.model = 'zero'")
def n_go_or_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.go_or_stop(_report(spark, sf_dir), better="p", base="zero")


@query("n_coverage", f"WITH s AS ({SCORED_SQL}) SELECT era, 'a' AS model, count(*) AS rows, count(*) FILTER (WHERE entity % 4 <> 0) AS present, round(count(*) FILTER (WHERE entity % 4 <> 0) / count(*), 6) AS share FROM s GROUP BY 1 UNION ALL SELECT era, 'b', count(*), count(*), 1.0 FROM s GROUP BY 1")
def n_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumns({"a": F.when(F.col("entity") % 4 != 0, F.col("p")), "b": F.col("q")})
    return rounded(gates.prediction_coverage(rows, ["era"], ["a", "b"]))


@query("n_sanity", f"WITH s AS ({SCORED_SQL}) SELECT true AS zero_is_zero, abs(avg(abs(0 - y)) - avg(abs(y))) < 1e-9 AS error_identity, count(*) = count(DISTINCT entity) AS unique_rows FROM s")
def n_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.sanity(scored(spark, sf_dir).withColumn("zero", F.lit(0.0)), KEY, zero="zero", actual="y")


@query("n_single_valued", "SELECT o_orderpriority, min(o_orderstatus) AS o_orderstatus, count(DISTINCT o_orderstatus) = 1 AS single FROM orders GROUP BY 1")
def n_single_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.single_valued(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("n_comparison", DELTA + ", h AS (SELECT era, period, CASE WHEN period <> 13 THEN delta END AS delta FROM d) SELECT 'available' AS status, count(*) AS groups, round(avg(delta), 4) AS mean FROM h")
def n_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gates.comparison_or_unavailable(_deltas(spark, sf_dir), BY, samples=200).select("status", "groups", "mean"), 4)


@query("o_complete_rows", f"WITH s AS ({SCORED_SQL}) SELECT era, count(*) AS rows, count(*) FILTER (WHERE entity % 4 <> 0 AND entity % 3 <> 0) AS complete FROM s GROUP BY 1")
def o_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumns({"a": F.when(F.col("entity") % 4 != 0, F.col("p")), "b": F.when(F.col("entity") % 3 != 0, F.col("q"))})
    return rows.groupBy("era").agg(F.count(F.lit(1)).alias("rows"), F.count_if(gates.complete_rows(rows, ["a", "b"])).alias("complete"))


@query("o_same_rows", f"WITH s AS ({SCORED_SQL}) SELECT entity, 'w' AS fold, CASE WHEN entity % 60 = 0 THEN 1 ELSE 2 END AS n, CASE WHEN entity % 60 = 0 THEN 1 ELSE 2 END AS targets FROM s WHERE entity % 60 = 0 OR entity % 77 = 0")
def o_same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("entity", "y", F.lit("w").alias("fold"), F.explode(F.array(F.lit("base"), F.lit("alt"))).alias("arm"))
    rows = rows.where(~((F.col("entity") % 60 == 0) & (F.col("arm") == "alt"))).withColumn("y", F.when((F.col("entity") % 77 == 0) & (F.col("arm") == "alt"), F.col("y") + 1).otherwise(F.col("y")))
    return gates.arm_differences(rows, ["entity"], "y").select("entity", "fold", F.col("n").cast("int").alias("n"), F.col("targets").cast("int").alias("targets"))


# --- compositions -----------------------------------------------------------------------------------


@query(
    "h_walk_forward",
    FOLDS_SQL + ", g AS (SELECT fold, position, avg(y) AS m FROM f WHERE part = 'train' GROUP BY 1, 2), a AS (SELECT fold, avg(y) AS m FROM f WHERE part = 'train' GROUP BY 1) SELECT f.fold, seed, entity, y, status, round(coalesce(g.m, a.m) * (1 + seed / 1000.0::DOUBLE) + 1.3e-6, 4) AS p_mean FROM f JOIN a USING (fold) LEFT JOIN g ON g.fold = f.fold AND g.position = f.position, (SELECT unnest([7, 42]) AS seed) WHERE part = 'test'",
)
def h_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    def predictor(train: DataFrame, calibration: DataFrame, test: DataFrame, seed: int) -> DataFrame:
        out = baselines.group_means(train.withColumn("all", F.lit(1)), test.withColumn("all", F.lit(1)), ["all"], ["position"], "y", "m")
        return out.select("entity", (F.col("m") * (1 + F.lit(seed) / 1000.0)).alias("p_mean"))

    rows = stored(folded(spark, sf_dir).select("fold", "part", *KEY, "position", "status", "y"), "folds")  # read for every fold and seed
    kept = folds.walk_forward(rows, predictor, key=KEY, features=["position"], targets=["y"], retained=["status"], names=TESTS, seeds=[7, 42])
    return kept.select("fold", "seed", "entity", "y", "status", F.round(F.col("p_mean") + 1.3e-6, 4).alias("p_mean"))


@query(
    "l_forecast_provenance",
    "SELECT 'captured not before cutoff' AS rule, CAST(o_orderkey AS VARCHAR) AS key, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS detail FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' UNION ALL SELECT 'state of forecast', CAST(o_orderkey AS VARCHAR), 'missing state with a value' FROM orders WHERE o_orderkey % 5 = 2",
)
def l_forecast_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import contracts

    digit = F.col("o_orderkey") % 5
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("captured"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz").alias("cutoff"), F.when(digit < 3, F.col("o_totalprice")).alias("forecast"), F.when(digit < 2, "value").otherwise("source_unavailable").alias("forecast_state")
    )
    return contracts.not_before(rows, "captured", "cutoff", ["o_orderkey"]).unionByName(contracts.state_violations(rows, "forecast", "forecast_state", ["o_orderkey"]))


@query(
    "o_source_comparison",
    f"""WITH s AS ({SCORED_SQL}), c AS (SELECT *, entity % 4 <> 0 AND entity % 3 <> 0 AS complete FROM s), r AS (SELECT 'all' AS rows_used, * FROM c UNION ALL SELECT 'complete', * FROM c WHERE complete), g AS (SELECT rows_used, era, period, count(*) AS n, avg(abs(p - y)) - avg(abs(q - y)) AS d FROM r GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY rows_used ORDER BY era, period) - 1 AS place, count(*) OVER (PARTITION BY rows_used) AS m FROM g), b AS (SELECT k.rows_used, x, avg(o.d) AS mean FROM k, (SELECT unnest(range(0, 2000)) AS x) JOIN k o ON o.rows_used = k.rows_used AND o.place = ('0x' || substr(md5('42|' || x || '|' || k.place), 1, 8))::BIGINT % k.m GROUP BY 1, 2),
 i AS (SELECT rows_used, stddev_samp(mean) AS deviation, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM b GROUP BY 1)
 SELECT rows_used, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, round(CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM s), 6) AS coverage, round(avg(d) + 1.3e-6, 4) AS mean_delta, round(max(deviation) + 1.3e-6, 4) AS deviation, round(max(low) + 1.3e-6, 4) AS low, round(max(high) + 1.3e-6, 4) AS high FROM g JOIN i USING (rows_used) GROUP BY 1""",
)
def o_source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources compared on all rows and on those that have both, each set with its coverage and an interval from the same drawn periods."""
    rows = scored(spark, sf_dir)
    marked = rows.withColumns({"a": F.when(F.col("entity") % 4 != 0, F.col("p")), "b": F.when(F.col("entity") % 3 != 0, F.col("q"))})
    complete = rows.join(marked.where(gates.complete_rows(marked, ["a", "b"])).select("entity"), "entity", "left_semi")
    both = rows.withColumn("rows_used", F.lit("all")).unionByName(complete.withColumn("rows_used", F.lit("complete")))
    a, b = (metrics.ranking_metrics(both, ["rows_used", *BY], "y", c, KEY, with_hash=True) for c in ("p", "q"))
    deltas = stored(compare.paired_deltas(a, b, ["rows_used", *BY], "mae").where("same_rows").join(a.select("rows_used", *BY, "rows"), ["rows_used", *BY]), "deltas")
    counts = deltas.groupBy("rows_used").agg(F.sum("rows").alias("rows"))
    whole = F.max(F.when(F.col("rows_used") == "all", F.col("rows"))).over(Window.partitionBy())  # two rows
    found = compare.bootstrap(deltas, BY, by=["rows_used"]).join(counts.withColumn("coverage", F.round(F.col("rows") / whole, 6)), "rows_used")
    return found.select("rows_used", "groups", "rows", "coverage", *(F.round(F.col(c) + 1.3e-6, 4).alias(n) for c, n in (("mean", "mean_delta"), ("deviation", "deviation"), ("low", "low"), ("high", "high"))))


@query(
    "o_flag_violations",
    f"WITH s AS ({SCORED_SQL}) SELECT entity, CASE WHEN entity % 50 = 0 THEN 'no flag' WHEN entity % 60 = 1 THEN 'not flagged though all signals are there' ELSE 'flagged though a signal is missing' END AS problem FROM s WHERE entity % 50 = 0 OR (entity % 60 = 1 AND entity % 4 <> 0 AND entity % 3 <> 0) OR (entity % 60 = 3 AND (entity % 4 = 0 OR entity % 3 = 0))",
)
def o_flag_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("entity")
    rows = scored(spark, sf_dir).withColumns({"a": F.when(k % 4 != 0, F.col("p")), "b": F.when(k % 3 != 0, F.col("q"))})
    flag = F.when(k % 50 == 0, None).when(k % 60 == 1, False).when(k % 60 == 3, True).otherwise((k % 4 != 0) & (k % 3 != 0))
    return gates.flag_violations(rows.withColumn("flag", flag), KEY, ["a", "b"], "flag")


@query("o_probability_evidence")
def o_probability_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two heads against a constant, with their calibration. No SQL: the line is a fit."""
    rows = stored(chances(spark, sf_dir), "chances").withColumn("half", F.lit(0.5))
    return rounded(gates.probability_evidence(rows, {"p": ("y", "p", "half"), "q": ("y", "q", "half")}, KEY))


@query(
    "n_cohort_probabilities",
    f"WITH s AS ({CHANCES_SQL}), c AS (SELECT *, unnest(list_filter(['all', CASE WHEN period <= 5 THEN 'early' ELSE 'established' END, CASE WHEN entity % 2 = 0 THEN 'multi' ELSE 'single' END], lambda x: x IS NOT NULL)) AS cohort FROM s), g AS (SELECT cohort, era, period, avg((p - y) * (p - y)) AS b FROM c GROUP BY 1, 2, 3) SELECT cohort, count(*) AS groups, round(avg(b) + 1.3e-9, 6) AS brier FROM g GROUP BY 1",
)
def n_cohort_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("all"), F.when(F.col("period") <= 5, "early").otherwise("established"), F.when(F.col("entity") % 2 == 0, "multi").otherwise("single"))
    rows = cohorts.with_cohorts(chances(spark, sf_dir), names)
    own = metrics.probability_metrics(rows, ["cohort", *BY], "y", "p", KEY)
    return metrics.mean_over_groups(own, ["cohort"], ["brier"]).select("cohort", "groups", F.round(F.col("brier") + 1.3e-9, 6).alias("brier"))


@query(
    "h_retained_violations",
    f"WITH s AS ({SCORED_SQL}), r AS (SELECT entity, 'w' AS fold, k AS seed, CASE WHEN entity % 37 = 0 AND k = 2 THEN NULL ELSE true END AS eligible FROM s, (SELECT unnest([1, 2]) AS k) UNION ALL SELECT entity, 'w', 1, true FROM s WHERE entity % 41 = 0) SELECT entity, fold, seed, 'repeated' AS problem FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1 UNION ALL SELECT entity, fold, seed, 'no eligibility' FROM r WHERE eligible IS NULL",
)
def h_retained_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained predictions of two seeds, some of them twice or without eligibility."""
    k = F.col("entity")
    rows = scored(spark, sf_dir).select("entity", F.lit("w").alias("fold"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seed")).withColumn("eligible", F.when(~((k % 37 == 0) & (F.col("seed") == 2)), True))
    again = scored(spark, sf_dir).where(k % 41 == 0).select("entity", F.lit("w").alias("fold"), F.lit(1).alias("seed"), F.lit(True).alias("eligible"))
    return folds.retained_violations(rows.unionByName(again), KEY, "eligible")
