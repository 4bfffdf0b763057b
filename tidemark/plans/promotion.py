"""Promotion gates over the tables: three models of an order's price in walk-forward test folds, each with seeded variants.

``p`` is made of all lines of an order, ``q`` of its largest line, ``mix`` is their mean, and ``near`` knows most of the price, so that one model wins. The seeds' variants move each
prediction by up to 0.6 %, so the noise floors come from measured ranges over seeds, and the intervals from resampled
periods.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, folds, gates, heads, metrics, reports
from ..sources.scratch import stored
from .common import CHANCES_SQL, SCORED_SQL, chances, dealt, rounded, tasks
from .evaluation import BY, KEY, TESTS, folded
from .registry import query

ARMS = ["p", "q", "mix", "near"]
CANDIDATES = ["p", "mix", "near"]
SEEDS = (1, 2, 3)

SCORES_SQL = f"""WITH s AS ({SCORED_SQL}),
f AS (SELECT 'w' || (era - 1995) AS fold, CASE WHEN era < 1999 THEN 'discovery' ELSE 'confirmation' END AS role, era, period, entity, y, p, q, (p + q) / 2 AS mix, (9 * y + p) / 10 AS near FROM s WHERE era BETWEEN 1997 AND 2000),
l AS (SELECT fold, role, era, period, entity, y, model, v FROM f UNPIVOT (v FOR model IN (p, q, mix, near))),
x AS (SELECT *, 0 AS seed FROM l UNION ALL SELECT fold, role, era, period, entity, y, model, v * (1 + ((entity * seed) % 7 - 3) / 500.0::DOUBLE), seed FROM l, (SELECT unnest([1, 2, 3]) AS seed)),
r AS (SELECT *, row_number() OVER (g ORDER BY v DESC, entity) AS rp, row_number() OVER (g ORDER BY y DESC, entity) AS ra, least(count(*) OVER g, 10) AS k,
  rank() OVER (g ORDER BY v) + (count(*) OVER (PARTITION BY model, seed, era, period, v) - 1) / 2.0::DOUBLE AS av,
  rank() OVER (g ORDER BY y) + (count(*) OVER (PARTITION BY model, seed, era, period, y) - 1) / 2.0::DOUBLE AS ay
  FROM x WINDOW g AS (PARTITION BY model, seed, era, period)),
m AS (SELECT fold, role, model, seed, era, period, avg(abs(v - y)) AS mae, avg(v - y) AS bias,
  coalesce(sum(CASE WHEN rp <= k THEN y / log2(rp + 1) END) / nullif(sum(CASE WHEN ra <= k THEN y / log2(ra + 1) END), 0), 0) AS ndcg,
  CASE WHEN min(av) < max(av) AND min(ay) < max(ay) THEN covar_pop(av, ay) / nullif(stddev_pop(av) * stddev_pop(ay), 0) END AS sp FROM r GROUP BY ALL),
rep AS (SELECT fold, role, model, seed, avg(ndcg) AS ndcg, avg(sp) AS sp, avg(mae) AS mae, avg(bias) AS bias FROM m GROUP BY ALL),
noise AS (SELECT fold, model, max(ndcg) - min(ndcg) AS floor FROM rep WHERE seed > 0 GROUP BY ALL),
d AS (SELECT a.fold, a.model, a.ndcg - b.ndcg AS delta, row_number() OVER (PARTITION BY a.fold, a.model ORDER BY a.era, a.period) - 1 AS place, count(*) OVER (PARTITION BY a.fold, a.model) AS n
  FROM m a JOIN m b ON b.model = 'q' AND b.seed = 0 AND a.seed = 0 AND a.model <> 'q' AND a.era = b.era AND a.period = b.period),
b AS (SELECT d.fold, d.model, s, avg(o.delta) AS mean FROM d, (SELECT unnest(range(0, 2000)) AS s) JOIN d o ON o.fold = d.fold AND o.model = d.model AND o.place = ('0x' || substr(md5('42|' || s || '|' || d.place), 1, 8))::BIGINT % d.n GROUP BY ALL),
i AS (SELECT fold, model, quantile_cont(mean, 0.025) AS low FROM b GROUP BY ALL),
c AS (SELECT a.model, a.fold, a.role, a.ndcg - q.ndcg AS gain, a.sp - q.sp AS sp_gain, a.mae - q.mae AS mae_change, abs(a.bias) - abs(q.bias) AS bias_change, na.floor AS own_floor, greatest(na.floor, nq.floor) AS both_floor, coalesce(i.low >= 0, false) AS interval_holds
  FROM rep a JOIN rep q ON a.fold = q.fold AND q.model = 'q' AND q.seed = 0 AND a.seed = 0 AND a.model <> 'q' JOIN noise na ON na.fold = a.fold AND na.model = a.model JOIN noise nq ON nq.fold = a.fold AND nq.model = 'q' JOIN i ON i.fold = a.fold AND i.model = a.model),
h AS (SELECT *, gain > 0 AS gains, gain > own_floor AS above_own, gain > both_floor AS above_both, coalesce(sp_gain >= 0, false) AS spearman_holds, mae_change <= 0 AS error_holds, bias_change <= 0 AS bias_holds FROM c),
g AS (SELECT *, gains AND above_own AND spearman_holds AND error_holds AND bias_holds AS passed, gains AND above_own AND interval_holds AND spearman_holds AND error_holds AND bias_holds AS passed_own, gains AND above_both AND interval_holds AND spearman_holds AND error_holds AND bias_holds AS passed_both FROM h)"""


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all test folds with the models' predictions, written."""
    rows = folded(spark, sf_dir).where(F.col("part") == "test").withColumns({"mix": (F.col("p") + F.col("q")) / 2, "near": (9 * F.col("y") + F.col("p")) / 10})
    rows = rows.withColumn("role", F.when(F.col("era") < 1999, "discovery").otherwise("confirmation")).where(F.col("fold").isin(TESTS))
    return stored(rows.select("fold", "role", *BY, *KEY, "y", *ARMS), "tested")


def _scores(rows: DataFrame) -> DataFrame:
    """Of ``_tested``: ranking metrics of every model (seed 0) per test period, and the NDCG of its variants; written, as three branches read them."""
    shared = ["fold", "role", *BY]
    long = gates.long_predictions(rows, [*shared, *KEY, "y"], ARMS)
    own = metrics.ranking_metrics(long.withColumn("seed", F.lit(0)), [*shared, "model", "seed"], "y", "prediction", KEY)
    moved = 1 + (F.pmod(F.col("entity") * F.col("seed"), F.lit(7)) - 3) / F.lit(500.0)
    variants = long.withColumn("seed", F.explode(F.array(*(F.lit(k) for k in SEEDS)))).withColumn("prediction", F.col("prediction") * moved)
    return stored(own.unionByName(metrics.ndcg_scores(variants, rows, [*shared, "model", "seed"], shared, "y", "prediction", KEY), allowMissingColumns=True), "scores")


def _evidence(scores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The models' report, the range of NDCG over seeds, and the intervals of the gains on ``q``."""
    means = metrics.mean_over_groups(scores, ["fold", "role", "model", "seed"], gates.RANKING)
    long = means.where("seed > 0").select("fold", "model", "seed", F.lit("ndcg").alias("metric"), F.col("ndcg").alias("value"))
    noise = compare.seed_noise(long, ["fold", "model"])
    own = scores.where("seed = 0").select("fold", "model", *BY, "ndcg")
    base = own.where("model = 'q'").select("fold", *BY, F.col("ndcg").alias("_base"))
    deltas = own.where("model != 'q'").join(base, ["fold", *BY]).withColumn("delta", F.col("ndcg") - F.col("_base"))
    return means.where("seed = 0"), noise, compare.bootstrap(deltas, BY, by=["fold", "model"])


def _checks(rows: DataFrame, *, intervals: bool = False, **options) -> DataFrame:
    report, noise, found = _evidence(_scores(rows))
    return gates.fold_checks(report, noise, "q", CANDIDATES, intervals=found if intervals else None, **options)


@query(
    "n_fold_gate",
    SCORES_SQL + " SELECT model, fold, role, round(gain, 6) AS ndcg_gain, round(sp_gain, 6) AS spearman_gain, round(mae_change, 4) AS mae_change, round(bias_change, 4) AS bias_change, round(own_floor, 6) AS noise_floor, gains, above_own AS above_noise, spearman_holds, error_holds, bias_holds, passed FROM g",
)
def n_fold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _checks(_tested(spark, sf_dir))
    amounts = ("mae_change", "bias_change")
    return checks.select(*(F.round(c, 4 if c in amounts else 6).alias(c) if t == "double" else F.col(c) for c, t in checks.dtypes))


@query(
    "n_promotion",
    SCORES_SQL + """, t AS (SELECT model, count(*) FILTER (WHERE role = 'discovery') AS d, count(*) FILTER (WHERE role = 'discovery' AND NOT passed) AS df, count(*) FILTER (WHERE role = 'confirmation') AS c, count(*) FILTER (WHERE role = 'confirmation' AND NOT passed) AS cf FROM g GROUP BY 1)
 SELECT model, d > 0 AND df = 0 AS discovery, CASE WHEN c = 0 THEN 'not_available' WHEN cf = 0 THEN 'passed' ELSE 'failed' END AS confirmation, CASE WHEN df > 0 THEN 'REJECT' WHEN d = 0 OR c = 0 THEN 'INCONCLUSIVE' WHEN cf > 0 THEN 'REJECT' ELSE 'KEEP' END AS decision FROM t""",
)
def n_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _checks(_tested(spark, sf_dir))
    checks = stored(checks, "checks")  # a row a model and fold, read once a model
    return reduce(DataFrame.unionByName, [gates.promotion(checks.where(F.col("model") == m)).select(F.lit(m).alias("model"), "*") for m in CANDIDATES])


HEADS_SQL = f"""WITH s AS ({CHANCES_SQL}), g AS (SELECT era, period, avg((p - y) * (p - y)) AS p, avg((q - y) * (q - y)) AS q, avg((0.5::DOUBLE - y) * (0.5::DOUBLE - y)) AS base FROM s WHERE era BETWEEN 1997 AND 2000 GROUP BY 1, 2),
l AS (SELECT era, period, base, head, v FROM g UNPIVOT (v FOR head IN (p, q))),
d AS (SELECT head, 'w' || (era - 1995) AS fold, v - base AS delta, v, base, row_number() OVER (PARTITION BY head, era ORDER BY period) - 1 AS place, count(*) OVER (PARTITION BY head, era) AS n FROM l),
b AS (SELECT d.head, d.fold, s, avg(o.delta) AS mean FROM d, (SELECT unnest(range(0, 2000)) AS s) JOIN d o ON o.fold = d.fold AND o.head = d.head AND o.place = ('0x' || substr(md5('42|' || s || '|' || d.place), 1, 8))::BIGINT % d.n GROUP BY ALL),
f AS (SELECT head, fold, avg(v) AS candidate, avg(base) AS base, avg(v) < avg(base) AS passed FROM d GROUP BY ALL),
i AS (SELECT head, fold, stddev_samp(mean) AS deviation, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM b GROUP BY ALL)"""


def _head_gate(spark: SparkSession, sf_dir: str, head: str, strict: bool = True) -> DataFrame:
    """One head's gate against a constant chance of one half."""
    rows = chances(spark, sf_dir).where(F.col("era").between(1997, 2000)).withColumns({"fold": F.concat(F.lit("w"), (F.col("era") - 1995).cast("string")), "half": F.lit(0.5)})
    rows = stored(rows.select("fold", *BY, *KEY, "y", head, "half"), "chances")
    scores = metrics.probability_metrics(gates.long_predictions(rows, ["fold", *BY, *KEY, "y"], [head, "half"]), ["fold", "model", *BY], "y", "prediction", KEY)
    report = metrics.mean_over_groups(scores, ["fold", "model"], ["brier"])
    one, two = (scores.where(F.col("model") == m).select("fold", *BY, F.col("brier").alias(n)) for m, n in ((head, "_a"), ("half", "_b")))
    deltas = one.join(two, ["fold", *BY]).withColumn("delta", F.col("_a") - F.col("_b"))
    gate = gates.probability_gate(report, head, "half", strict=strict, deltas=deltas, order=BY)
    return gate.select(F.lit(head).alias("head"), "*", F.when(F.col("fold") < "w4", "discovery").otherwise("confirmation").alias("role"))


@query("n_probability_gate", HEADS_SQL + " SELECT head, fold, CASE WHEN fold < 'w4' THEN 'discovery' ELSE 'confirmation' END AS role, round(candidate, 6) AS candidate, round(base, 6) AS base, passed, round(deviation, 6) AS deviation, round(low, 6) AS low, round(high, 6) AS high FROM f JOIN i USING (head, fold)")
def n_probability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_head_gate(spark, sf_dir, "p").unionByName(_head_gate(spark, sf_dir, "q")))


@query("n_head_decisions", HEADS_SQL + " SELECT head, CASE WHEN bool_and(passed) THEN 'KEEP' ELSE 'REJECT' END AS decision FROM f GROUP BY 1")
def n_head_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.head_decisions(_head_gate(spark, sf_dir, "p").unionByName(_head_gate(spark, sf_dir, "q")))


@query(
    "n_confirmed",
    SCORES_SQL + """, t AS (SELECT model, avg(gain) FILTER (WHERE role = 'discovery') AS mean, bool_and(passed) FILTER (WHERE role = 'discovery') AS ok, CASE WHEN bool_and(passed) FILTER (WHERE role = 'confirmation') THEN 'passed' ELSE 'failed' END AS again FROM g GROUP BY 1),
 w AS (SELECT max((mean, model)) FILTER (WHERE ok) AS best FROM t), k AS (SELECT t.* FROM w LEFT JOIN t ON (t.mean, t.model) = w.best)
 SELECT model AS selected, round(mean, 6) AS mean_gain, coalesce(again, 'not_applicable') AS confirmation, CASE WHEN again = 'passed' THEN 'PROMOTE_' || upper(model) ELSE 'KEEP_BASE' END AS decision FROM k""",
)
def n_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gates.confirmed_selection(_checks(_tested(spark, sf_dir), unknown_noise=0.0)))


#: What ``p`` loses on the rows that have both signals if ``q`` takes its place: the exact-source guardrail of the arm ``mix``.
EXACT_SQL = ", e AS (SELECT fold, avg(CASE WHEN model = 'p' THEN ndcg END) - avg(CASE WHEN model = 'mix' THEN ndcg END) AS delta FROM rep WHERE seed = 0 AND role = 'discovery' GROUP BY 1), a AS (SELECT model AS arm, avg(gain) AS mean_gain, max(both_floor) AS noise_floor, bool_and(passed_both) AND (model <> 'mix' OR (SELECT bool_and(delta <= 0) FROM e)) AS passed FROM g WHERE role = 'discovery' GROUP BY 1), w AS (SELECT coalesce(arg_max(arm, (mean_gain, arm)) FILTER (WHERE passed), 'q') AS selected FROM a)"


def _arm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, noise, found = _evidence(_scores(_tested(spark, sf_dir)))
    checks = gates.fold_checks(report.where("role = 'discovery'"), noise, "q", CANDIDATES, intervals=found, noise_of_both=True)
    wide = report.where("role = 'discovery'").groupBy("fold").agg(*(F.max(F.when(F.col("model") == m, F.col("ndcg"))).alias(m) for m in ("p", "mix")))
    return gates.candidate_gate(checks, wide.select(F.lit("mix").alias("arm"), (F.col("p") - F.col("mix")).alias("delta")))


@query("o_arm_gate", SCORES_SQL + EXACT_SQL + " SELECT arm, round(mean_gain, 6) AS mean_gain, round(noise_floor, 6) AS noise_floor, passed FROM a")
def o_arm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_arm_gate(spark, sf_dir))


@query("o_verdicts", SCORES_SQL + EXACT_SQL + " SELECT arm, round(mean_gain, 6) AS mean_gain, round(noise_floor, 6) AS noise_floor, passed, CASE WHEN arm = selected THEN 'SELECTED' WHEN passed THEN 'NOT_SELECTED' WHEN mean_gain <= 0 THEN 'REJECT' ELSE 'INCONCLUSIVE' END AS verdict FROM a, w")
def o_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = stored(_arm_gate(spark, sf_dir), "gate")
    return rounded(gates.ablation_verdicts(gate, gates.selected_arm(gate, "q")))


@query("o_base_gate", SCORES_SQL + " SELECT model, bool_and(passed_own) AS passed FROM g WHERE role = 'discovery' GROUP BY 1")
def o_base_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _checks(_tested(spark, sf_dir), intervals=True).where("role = 'discovery'")
    checks = stored(checks, "checks")
    return reduce(DataFrame.unionByName, [gates.base_gate(checks.where(F.col("model") == m)).select(F.lit(m).alias("model"), "passed") for m in CANDIDATES])


CHECKS = ["selected_on_discovery_only", "discovery_passed", "confirmation_above_noise", "confirmation_interval_holds", "confirmation_spearman_holds", "confirmation_error_holds", "confirmation_bias_holds", "calibrated", "reproducible"]


@query(
    "o_confirmation_gate",
    SCORES_SQL
    + f""", heads AS (SELECT bool_and(a <= b) AS ok FROM (SELECT era, avg(a) AS a, avg(b) AS b FROM (SELECT era, period, avg((p - y) * (p - y)) AS a, avg((0.5::DOUBLE - y) * (0.5::DOUBLE - y)) AS b FROM ({CHANCES_SQL}) WHERE era BETWEEN 1997 AND 2000 GROUP BY 1, 2) GROUP BY 1)),
 audit AS (SELECT count(*) = count(DISTINCT entity) AS ok FROM f), k AS (SELECT true AS selected_on_discovery_only, (SELECT bool_and(passed_own) FROM g WHERE model = 'mix' AND role = 'discovery') AS discovery_passed, bool_and(above_own) AS confirmation_above_noise, bool_and(interval_holds) AS confirmation_interval_holds,
 bool_and(spearman_holds) AS confirmation_spearman_holds, bool_and(error_holds) AS confirmation_error_holds, bool_and(bias_holds) AS confirmation_bias_holds, (SELECT ok FROM heads) AS calibrated, (SELECT ok FROM audit) AS reproducible FROM g WHERE model = 'mix' AND role = 'confirmation')
 SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in CHECKS)}], lambda x: x IS NOT NULL), ',') AS failed, CASE WHEN {" AND ".join(CHECKS)} THEN 'PROMOTE' ELSE 'HOLD' END AS decision FROM k""",
)
def o_confirmation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = _tested(spark, sf_dir)  # orders meet their lines once for all checks
    checks = stored(_checks(tested, intervals=True).where("model = 'mix'"), "checks")
    used = folds.in_windows(tested.drop("role").withColumn("ord", F.col("era") * 12 + F.col("period") - 1), WINDOWS_OF_DISCOVERY, "ord")
    selection = used.agg((F.count_if(~F.col("may_select")) > 0).alias("confirmation_observed"))
    audit = dealt(tested.select("entity"), tasks(tested), "entity").agg((F.count(F.lit(1)) == F.count_distinct("entity")).alias("passed"))
    nine = gates.confirmation_checks(checks.where("role = 'confirmation'"), selection=selection, discovery=gates.base_gate(checks.where("role = 'discovery'")), calibration=_head_gate(spark, sf_dir, "p", strict=False), audit=audit)
    return gates.confirmation_gate(nine).withColumn("failed", F.array_join("failed", ","))


WINDOWS_OF_DISCOVERY = [folds.EvalWindow(f"w{k}", (1995 + k) * 12, (1995 + k) * 12 + 11, "discovery") for k in (2, 3)]


# --- written reports ------------------------------------------------------------------------------


def _object(table: str, outer: str, inner: str, values: dict[str, str]) -> str:
    """SQL for a JSON object of objects of objects, as ``reports.nested`` writes them."""
    one = " || ',' || ".join(f"'\"{n}\":' || coalesce('\"' || printf('%.4f', {v}) || '\"', 'null')" for n, v in sorted(values.items()))
    return f"(SELECT coalesce('{{' || string_agg('\"' || o || '\":{{' || x || '}}', ',' ORDER BY o) || '}}', '{{}}') FROM (SELECT {outer} AS o, string_agg('\"' || {inner} || '\":{{' || {one} || '}}', ',' ORDER BY {inner}) AS x FROM {table} GROUP BY 1))"


_RANKED = {"bias": "bias", "mae": "mae", "ndcg": "ndcg", "spearman": "sp"}
DIRECT_SQL = (
    SCORES_SQL
    + ", r0 AS (SELECT * FROM rep WHERE seed = 0), go AS (SELECT CASE WHEN bool_and(a.ndcg >= b.ndcg OR a.mae <= b.mae) THEN 'GO' ELSE 'STOP' END AS d FROM r0 a JOIN r0 b ON a.fold = b.fold AND a.model = 'near' AND b.model = 'q') SELECT 'direct' AS report, '{\"comparisons\":' || "
    + _object("c JOIN (SELECT fold, model, low FROM i) USING (fold, model)", "fold", "model", {"gain": "gain", "low": "low", "noise": "own_floor"})
    + " || ',\"decision\":\"' || (SELECT d FROM go) || '\",\"folds\":' || "
    + _object("r0", "fold", "model", _RANKED)
    + " || '}' AS document"
)


@query("n_direct_report", DIRECT_SQL)
def n_direct_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document: every model's metrics by fold, each candidate's gain on ``q`` with its interval and noise, and go or stop for ``near``."""
    report, noise, found = _evidence(_scores(_tested(spark, sf_dir)))
    report = report.select("fold", "role", "model", "ndcg", "spearman", "mae", "mean_bias")
    checks = gates.fold_checks(report, noise, "q", CANDIDATES)
    gains = checks.select("fold", "model", F.col("ndcg_gain").alias("gain"), F.col("noise_floor").alias("noise")).join(found.select("fold", "model", "low"), ["fold", "model"])
    parts = {
        "comparisons": reports.nested(gains, "fold", "model", ["gain", "low", "noise"]),
        "decision": gates.go_or_stop(report, better="near", base="q").select("recommendation"),
        "folds": reports.nested(report.withColumnRenamed("mean_bias", "bias"), "fold", "model", ["bias", "mae", "ndcg", "spearman"]),
    }
    return reports.document("direct", parts)


HEADS_REPORT_SQL = (
    HEADS_SQL
    + f", k AS (SELECT count(*) FILTER (WHERE entity % 3 = 0 AND p > 0) AS blank_played, count(*) FILTER (WHERE q > p + 1e-12) AS long_above_played FROM ({CHANCES_SQL})), v AS (SELECT head, fold, candidate, base, low, high FROM f JOIN i USING (head, fold)), t AS (SELECT head, CASE WHEN bool_and(passed) THEN 'KEEP' ELSE 'REJECT' END AS d FROM f GROUP BY 1)"
    + """ SELECT 'heads' AS report, '{"coherence":{"blank_played":' || (SELECT blank_played FROM k) || ',"long_above_played":' || (SELECT long_above_played FROM k) || '},"decisions":{' || (SELECT string_agg('"' || head || '":"' || d || '"', ',' ORDER BY head) FROM t) || '},"heads":' || """
    + _object("v", "head", "fold", {"base": "base", "candidate": "candidate", "high": "high", "low": "low"})
    + " || '}' AS document"
)


@query("n_heads_report", HEADS_REPORT_SQL)
def n_heads_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document: both heads' Brier scores by fold against the constant with their intervals, the decisions, and how often the raw heads contradict one another."""
    gate = stored(_head_gate(spark, sf_dir, "p").unionByName(_head_gate(spark, sf_dir, "q")), "heads")
    p, q, k = F.col("p"), F.col("q"), F.col("entity") % 3
    counts = chances(spark, sf_dir).agg(*heads.coherence_counts(p_played=p, p_long=q, exposure=50 * p, n_occurrences=k)).select(F.struct("blank_played", "long_above_played").alias("coherence"))
    parts = {"coherence": counts, "decisions": reports.mapped(gates.head_decisions(gate), "head", "decision"), "heads": reports.nested(gate, "head", "fold", ["base", "candidate", "high", "low"])}
    return reports.document("heads", parts)
