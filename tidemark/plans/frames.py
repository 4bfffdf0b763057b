"""The frame of all features over the events: users at nine cutoffs, in groups that meet in a schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, facts, frame
from ..sources.scratch import stored
from .common import HISTORY_SQL, history, rounded
from .registry import query, table

PERIODS = 9


def _cutoff(period: Column) -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=3 * period)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user at nine cutoffs with what a snapshot says: some lack a status, a chance, a forecast or the other provider's id."""
    e = F.col("entity")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity")).distinct().select("entity", F.explode(F.sequence(F.lit(1), F.lit(PERIODS))).alias("period"))
    rows = users.select("entity", "period", F.lit(2024).alias("era"), (e % 25).alias("own_group"), _cutoff(F.col("period")).alias("cutoff"))
    return rows.select(
        "*",
        (F.col("cutoff") - F.expr("INTERVAL 2 HOURS")).alias("captured_at"),
        F.when(e % 4 == 0, "G").when(e % 4 == 1, "D").when(e % 4 == 2, "M").otherwise("F").alias("position"),
        (e % 90 + 40).alias("price"),
        F.when(e % 5 == 1, "d").when(e % 5 == 2, "i").when(e % 5 != 3, "a").alias("status"),
        F.when(e % 5 == 3, "source_unavailable").otherwise("value").alias("status_state"),
        F.when(e % 3 == 1, 0).when(e % 3 == 2, 75).alias("chance"),
        F.when(e % 3 == 0, "source_unavailable").when(e % 3 == 1, "genuine_zero").otherwise("value").alias("chance_state"),
        F.when(e % 2 == 0, (e % 7).cast("double")).alias("forecast"),
        F.when(e % 2 == 1, "acquisition_failure").when(e % 7 == 0, "genuine_zero").otherwise("value").alias("forecast_state"),
        F.when(e % 8 != 0, e).alias("foreign_id"),
        F.concat(F.lit("c"), e % 3).alias("source_id"),
    )


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule of the groups: in two of three periods a group is at home to another; a quarter isn't announced in time."""
    g, k = F.col("home"), F.col("period")
    groups = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("home")).distinct().select("home", F.explode(F.sequence(F.lit(1), F.lit(PERIODS))).alias("period"))
    return groups.where((g + k) % 3 != 0).select(
        F.lit(2024).alias("era"), "period", (k * 100 + g).alias("occurrence_id"), (_cutoff(k) + F.make_dt_interval(days=F.lit(1), hours=g)).alias("kickoff"), (_cutoff(k) - F.make_dt_interval(days=g % 4)).alias("available_at"),
        "home", ((g + 1 + (g * 3 + k) % 24) % 25).alias("away"), (g % 5 + 1).cast("double").alias("home_difficulty"), F.when(g % 7 != 0, k % 4 + 1).cast("double").alias("away_difficulty"), F.concat(F.lit("s"), g % 2).alias("source_id"),
    )


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with statistics under the names of two providers, one of them as text."""
    k = F.col("occurrence_id")
    return history(spark, sf_dir).select(
        "era", "entity", "occurrence_id", "kickoff", "side", "exposure", "outcome", "available_at", F.col("event_type").alias("source_id"), (k % 2).alias("starts"), (k % 3).alias("goals"), (k % 5).alias("assisted"), (k % 11 / 10).cast("string").alias("xg"),
        (k % 4).alias("expected_assisted"), F.nullif(k % 9, F.lit(0)).alias("shots"), (k % 6).alias("openings"), (k % 50).alias("rating"), (k % 4).alias("bonus"), (k % 10 == 0).cast("int").alias("warnings"),
    )


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, home = F.col("event_id"), F.col("user_id") % 25
    return table(spark, sf_dir, "events").select(
        F.lit(2024).alias("era"), k.alias("occurrence_id"), F.col("ts").alias("kickoff"), home.alias("home"), ((home + 1 + k % 24) % 25).alias("away"), (k % 4).alias("home_scored"), (k % 3).alias("away_scored"),
        (F.nullif(k % 37, F.lit(0)) / 2).alias("home_expected"), (k % 5).alias("away_expected"), (F.col("ts") + F.make_dt_interval(hours=k % 24)).alias("available_at"), F.concat(F.lit("r"), k % 2).alias("source_id"),
    )


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Period rows, what is announced of their groups, entity history and results, as ``feature_frame`` takes them."""
    snapshots = targets(spark, sf_dir)
    known = facts.announced(snapshots, meetings(spark, sf_dir))
    rows = facts.period_rows(snapshots, known, source="source_id")
    return rows, known, frame.entity_history(raw_history(spark, sf_dir)), frame.two_sided(raw_results(spark, sf_dir))


# --- the same in SQL ------------------------------------------------------------------------------

_TARGETS_SQL = f"""t AS (SELECT entity, CAST(period AS INTEGER) AS period, 2024 AS era, entity % 25 AS own_group, TIMESTAMP '2024-01-01' + to_days(CAST(3 * period AS INTEGER)) AS cutoff, TIMESTAMP '2024-01-01' + to_days(CAST(3 * period AS INTEGER)) - INTERVAL 2 HOUR AS captured_at,
 CASE entity % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'D' WHEN 2 THEN 'M' ELSE 'F' END AS position, (entity % 90 + 40) / 10.0 AS price, CASE entity % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 0 END AS status_ordinal, CASE entity % 3 WHEN 1 THEN 0.0 WHEN 2 THEN 75.0 END AS chance,
 CASE WHEN entity % 2 = 0 THEN CAST(entity % 7 AS DOUBLE) END AS forecast, CASE WHEN entity % 2 = 1 THEN 'acquisition_failure' WHEN entity % 7 = 0 THEN 'genuine_zero' ELSE 'value' END AS forecast_state, (period - 1) / 8.0 AS phase, entity % 8 <> 0 AS foreign, 'c' || entity % 3 AS source_id
 FROM (SELECT DISTINCT user_id AS entity FROM events), (SELECT unnest(range(1, {PERIODS + 1})) AS period))"""

_KNOWN_SQL = f"""m AS (SELECT period, 100 * period + g AS occurrence_id, TIMESTAMP '2024-01-01' + to_days(CAST(3 * period AS INTEGER)) AS cutoff, TIMESTAMP '2024-01-01' + to_days(CAST(3 * period + 1 AS INTEGER)) + to_hours(CAST(g AS INTEGER)) AS kickoff,
 TIMESTAMP '2024-01-01' + to_days(CAST(3 * period - g % 4 AS INTEGER)) AS available_at, g AS home, (g + 1 + (g * 3 + period) % 24) % 25 AS away, CAST(g % 5 + 1 AS DOUBLE) AS hd, CASE WHEN g % 7 <> 0 THEN CAST(period % 4 + 1 AS DOUBLE) END AS ad, 's' || g % 2 AS source_id
 FROM (SELECT DISTINCT user_id % 25 AS g FROM events), (SELECT unnest(range(1, {PERIODS + 1})) AS period) WHERE (g + period) % 3 <> 0),
two AS (SELECT * FROM (SELECT period, cutoff, occurrence_id, kickoff, available_at, source_id, 'home' AS side, home AS own_group, away AS counter_group, hd AS difficulty FROM m UNION ALL SELECT period, cutoff, occurrence_id, kickoff, available_at, source_id, 'away', away, home, ad FROM m)
 WHERE available_at < cutoff AND kickoff > cutoff AND own_group IN (SELECT DISTINCT user_id % 25 FROM events))"""


def _whole(x: str, n: int, f: str = "avg") -> str:
    return f"CASE WHEN count({x}) FILTER (WHERE n <= {n}) = count(*) FILTER (WHERE n <= {n}) THEN {f}({x}) FILTER (WHERE n <= {n}) END"


def _per90(x: str, n: int = 5) -> str:
    return f"CASE WHEN count({x}) FILTER (WHERE n <= {n}) = count(*) FILTER (WHERE n <= {n}) AND sum(exposure) FILTER (WHERE n <= {n}) >= 90 THEN 90 * sum({x}) FILTER (WHERE n <= {n}) / (sum(exposure) FILTER (WHERE n <= {n}) + 1e-6) END"


_STATS = {
    "scored": "occurrence_id % 3", "assisted": "occurrence_id % 5", "expected_scored": "(occurrence_id % 11) / 10.0", "expected_assisted": "occurrence_id % 4", "attempts": "nullif(occurrence_id % 9, 0)", "openings": "occurrence_id % 6",
    "rating": "occurrence_id % 50", "bonus": "occurrence_id % 4",
}
_ENTITY_SQL = f"""h AS ({HISTORY_SQL}), hs AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _STATS.items())}, CASE WHEN occurrence_id % 10 = 0 THEN 1 ELSE 0 END AS warnings FROM h),
e AS (SELECT hs.*, c.cutoff, row_number() OVER (PARTITION BY hs.entity, c.cutoff ORDER BY kickoff DESC, occurrence_id DESC) AS n, row_number() OVER (PARTITION BY hs.entity, c.cutoff, side ORDER BY kickoff DESC, occurrence_id DESC) AS sn
 FROM hs JOIN (SELECT DISTINCT entity, cutoff FROM t) c ON hs.entity = c.entity WHERE greatest(completed_at, available_at) < c.cutoff),
ef AS (SELECT entity, cutoff, count(*) FILTER (WHERE exposure > 0) AS appearances, first(exposure ORDER BY kickoff DESC, occurrence_id DESC) FILTER (WHERE exposure > 0) AS exposure_last_appearance, first(outcome ORDER BY kickoff DESC, occurrence_id DESC) FILTER (WHERE exposure > 0) AS outcome_last_appearance,
 max(kickoff) FILTER (WHERE exposure > 0) AS last_played, {_whole("exposure", 3)} AS exposure_mean_last3, {_whole("exposure", 5)} AS exposure_mean_last5, {_whole("exposure", 5, "stddev_pop")} AS exposure_std_last5, avg(CASE WHEN exposure > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n <= 5) AS played_rate_last5,
 avg(CASE WHEN exposure >= 60 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n <= 5) AS long_rate_last5, avg(occurrence_id % 2) FILTER (WHERE n <= 5) AS started_rate_last5, {_whole("outcome", 3)} AS outcome_mean_last3, {_whole("outcome", 5)} AS outcome_mean_last5, {_per90("outcome")} AS outcome_per90_last5,
 {", ".join(f"{_per90(c)} AS {c}_per90_last5" for c in _STATS)}, {_per90("warnings", 10)} AS warnings_per90_last10, avg(outcome) FILTER (WHERE side = 'home' AND sn <= 5) AS hm, avg(outcome) FILTER (WHERE side = 'away' AND sn <= 5) AS am,
 max(available_at) AS known, list(DISTINCT event_type) AS sources FROM e GROUP BY 1, 2)"""

_G = ("scored", "expected", "conceded", "expected_conceded")
_GROUP_SQL = f"""res AS (SELECT user_id % 25 AS home, (user_id % 25 + 1 + event_id % 24) % 25 AS away, ts AS kickoff, ts + INTERVAL 3 HOUR AS completed_at, ts + to_hours(CAST(event_id % 24 AS INTEGER)) AS available_at, event_id, event_id % 4 AS hs, event_id % 3 AS aws, nullif(event_id % 37, 0) / 2.0 AS hx, event_id % 5 AS ax, 'r' || event_id % 2 AS source_id FROM events),
sides AS (SELECT home AS g, kickoff, completed_at, available_at, event_id, hs AS scored, aws AS conceded, hx AS expected, ax AS expected_conceded, source_id FROM res UNION ALL SELECT away, kickoff, completed_at, available_at, event_id, aws, hs, ax, hx, source_id FROM res),
gn AS (SELECT s.*, c.cutoff, row_number() OVER (PARTITION BY g, c.cutoff ORDER BY kickoff DESC, event_id DESC) AS n FROM sides s, (SELECT DISTINCT cutoff FROM t) c WHERE greatest(completed_at, available_at) < c.cutoff),
gf AS (SELECT g, cutoff, {", ".join(f"{_whole(c, 5)} AS {c}_mean" for c in _G)}, avg(CASE WHEN conceded = 0 THEN 1.0 ELSE 0.0 END) AS clean_rate, avg(CASE WHEN scored > conceded THEN 1.0 ELSE 0.0 END) AS win_rate, avg(CASE WHEN scored < conceded THEN 1.0 ELSE 0.0 END) AS loss_rate,
 max(kickoff) AS last_kickoff, max(available_at) AS known, list(DISTINCT source_id) AS sources FROM gn WHERE n <= 5 GROUP BY 1, 2),
cf AS (SELECT two.own_group, two.cutoff, count(*) AS n, count(*) FILTER (WHERE side = 'home') AS homes, count(*) FILTER (WHERE side = 'away') AS aways, CASE WHEN count(difficulty) = count(*) THEN avg(difficulty) END AS dmean, CASE WHEN count(difficulty) = count(*) THEN min(difficulty) END AS dmin, min(kickoff) AS first_kickoff,
 {", ".join(f"CASE WHEN count({c}) = count(*) THEN avg({c}) END AS counter_{c}_last5" for c in [*(f"{x}_mean" for x in _G), "clean_rate", "loss_rate"])}, greatest(max(available_at), max(gf.known)) AS known, list_concat(list(DISTINCT source_id), flatten(list(sources))) AS sources
 FROM two LEFT JOIN gf ON gf.g = two.counter_group AND gf.cutoff = two.cutoff GROUP BY 1, 2)"""

_INT = {"n_occurrences", "n_home", "appearances"}
_OWN = {
    "position": "position", "price": "price", "n_occurrences": "coalesce(cf.n, 0)", "n_home": "coalesce(homes, 0)", "difficulty_mean": "dmean", "difficulty_min": "dmin", "rest_days": "date_diff('microsecond', gf.last_kickoff, first_kickoff) / 86400000000.0",
    "idle_days": "date_diff('microsecond', last_played, first_kickoff) / 86400000000.0", "status_ordinal": "status_ordinal", "chance": "chance", "appearances": "coalesce(appearances, 0)", "phase": "phase",
    "side_outcome_mean_last5": "(CASE WHEN hm IS NULL THEN 0 ELSE coalesce(homes, 0) * hm END + CASE WHEN am IS NULL THEN 0 ELSE coalesce(aways, 0) * am END) / nullif(CASE WHEN hm IS NULL THEN 0 ELSE coalesce(homes, 0) END + CASE WHEN am IS NULL THEN 0 ELSE coalesce(aways, 0) END, 0)",
    "attack_matchup": "gf.scored_mean * counter_conceded_mean_last5", "clean_matchup": "gf.clean_rate / (1 + counter_scored_mean_last5)",
}


def _column(name: str) -> str:
    if name in _OWN:
        found = _OWN[name]
    elif name.startswith("own_"):
        found = "gf." + name.removeprefix("own_").removesuffix("_last5")
    elif any(name == f"{c}_per90_last5" for c in frame.FOREIGN):
        found = f"CASE WHEN t.foreign THEN {name} END"
    else:
        found = name
    if name in ("position", "status_ordinal"):
        return f"{found} AS {name}"
    return f"CAST({found} AS BIGINT) AS {name}" if name in _INT else f"round(CAST({found} AS DOUBLE), 6) AS {name}"


FRAME_SQL = f"""WITH {_TARGETS_SQL}, {_KNOWN_SQL}, {_ENTITY_SQL}, {_GROUP_SQL}
SELECT t.era, t.period, t.entity, t.cutoff, captured_at, greatest(captured_at, ef.known, gf.known, cf.known) AS known_at, '1' AS contract_version,
 array_to_string(list_sort(list_distinct(list_concat([t.source_id], coalesce(ef.sources, []), coalesce(gf.sources, []), coalesce(cf.sources, [])))), ',') AS sources, CAST(outcome_last_appearance AS DOUBLE) AS outcome_last_appearance,
 CASE WHEN forecast_state IN ('value', 'genuine_zero') THEN forecast END AS forecast, forecast_state, {", ".join(_column(n) for n in frame.NAMES)}
FROM t LEFT JOIN ef ON ef.entity = t.entity AND ef.cutoff = t.cutoff LEFT JOIN gf ON gf.g = t.own_group AND gf.cutoff = t.cutoff LEFT JOIN cf ON cf.own_group = t.own_group AND cf.cutoff = t.cutoff"""


@query("f_frame", FRAME_SQL)
def f_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 46 features of the contract, in its order, with key, instants, sources and official forecast."""
    made = frame.feature_frame(*inputs(spark, sf_dir), periods=PERIODS)
    return rounded(made.withColumn("source_ids", F.array_join("source_ids", ",")).withColumnRenamed("source_ids", "sources"))


@query(
    "f_frame_violations",
    f"WITH {_TARGETS_SQL} SELECT rule, CAST(2024 AS INTEGER) AS era, period, entity FROM (SELECT period, entity, unnest([CASE WHEN entity % 13 = 0 THEN 'unknown status' END, CASE WHEN entity % 17 = 0 AND entity % 3 = 0 THEN 'chance must be missing' END, CASE WHEN entity % 19 = 0 AND entity % 2 = 0 THEN 'forecast must be missing' END, CASE WHEN entity % 23 = 0 THEN 'several frame rows' END]) AS rule FROM t) WHERE rule IS NOT NULL",
)
def f_frame_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame's rules on rows some of which have an unknown status, a value that their state denies, or come twice."""
    rows, known, own, results = inputs(spark, sf_dir)
    made = frame.feature_frame(rows, known, own, results, periods=PERIODS).where("entity % 23 <> 0")
    again = frame.feature_frame(rows.where("entity % 23 = 0"), known, own, results, periods=PERIODS)
    e = F.col("entity")
    broken = rows.withColumns({
        "status": F.when(e % 13 == 0, "x").otherwise(F.col("status")), "status_state": F.when(e % 13 == 0, "value").otherwise(F.col("status_state")), "chance": F.when((e % 17 == 0) & (e % 3 == 0), 50).otherwise(F.col("chance")),
        "forecast_state": F.when((e % 19 == 0) & (e % 2 == 0), "source_unavailable").otherwise(F.col("forecast_state")),
    })
    return frame.frame_violations(made.unionByName(again).unionByName(again), broken)


# --- the whole build ------------------------------------------------------------------------------

#: Orders as occurrences, all announced in time, between a customer's group and one that nobody is in. From 1998 on every tenth customer is in another group.
BUILD_SQL = """o AS (SELECT o_orderkey AS occurrence_id, CAST(year(o_orderdate) AS INTEGER) AS era, CAST(month(o_orderdate) AS INTEGER) AS period, o_custkey AS customer, o_custkey + CASE WHEN o_custkey % 10 = 0 AND year(o_orderdate) >= 1998 THEN 1000000000 ELSE 0 END AS home,
 o_orderkey * 37 % 91 AS exposure, o_orderkey % 13 - 1 AS outcome FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _build(spark: SparkSession, sf_dir: str, wrong: int | None = None) -> build.Built:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    key, customer = F.col("o_orderkey"), F.col("o_custkey")

    def group(k: Column, era: Column) -> Column:
        return k + F.when((k % 10 == 0) & (era >= 1998), 1_000_000_000).otherwise(0)

    month = F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz")
    s = o.select(
        key.alias("occurrence_id"), F.year("o_orderdate").alias("era"), F.month("o_orderdate").alias("period"), month.alias("cutoff"), (F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("kickoff"), customer.alias("customer"),
        group(customer, F.year("o_orderdate")).alias("home"), (-1 - customer).alias("away"), F.lit(1.0).alias("home_difficulty"), F.lit(2.0).alias("away_difficulty"), (month - F.make_dt_interval(days=key % 9 + 1)).alias("available_at"),
    )
    s = stored(s, "schedule")  # orders meet customers once for all stages
    snapshots = s.select("era", "period", F.col("customer").alias("entity"), F.col("home").alias("own_group"), "cutoff", (F.col("cutoff") - F.expr("INTERVAL 2 HOURS")).alias("captured_at")).distinct()
    outcomes = s.select("era", "occurrence_id", F.col("customer").alias("alias"), (F.col("occurrence_id") * 37 % 91).alias("exposure"), (F.col("occurrence_id") % 13 - 1).alias("outcome"), "period", F.lit("home").alias("side"))
    if wrong:
        outcomes = outcomes.withColumn("side", F.when(F.col("occurrence_id") % wrong == 0, "away").otherwise(F.col("side")))
    eras = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("era")).distinct()
    c = table(spark, sf_dir, "customer").join(F.broadcast(eras))  # a handful of years
    registry = c.select("era", F.col("c_custkey").alias("alias"), F.col("c_custkey").alias("entity"), group(F.col("c_custkey"), F.col("era")).alias("own_group"), F.lit(1).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"))
    return build.build(outcomes, s.drop("cutoff", "customer"), snapshots, registry, stored)


@query(
    "e_build",
    f"WITH {BUILD_SQL} SELECT era, period, customer AS entity, home AS own_group, count(*) AS n_occurrences, count(*) AS n_home, string_agg(occurrence_id, ',' ORDER BY occurrence_id) AS ids, CAST(sum(outcome) AS BIGINT) AS y_outcome, CAST(sum(exposure) AS BIGINT) AS y_exposure, CAST(sum(exposure) > 0 AS INTEGER) AS y_played FROM o GROUP BY 1, 2, 3, 4",
)
def e_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows if every stage holds."""
    made = _build(spark, sf_dir)
    if made.rows is None:
        return made.violations
    return made.rows.select(*facts.KEY, "own_group", "n_occurrences", "n_home", F.array_join(F.array_sort("occurrence_ids").cast("array<string>"), ",").alias("ids"), "y_outcome", "y_exposure", "y_played")


@query("e_build_stopped", f"WITH {BUILD_SQL} SELECT 'facts' AS stage, 'side disagrees' AS rule, concat_ws('|', era, occurrence_id, customer) AS subject FROM o WHERE occurrence_id % 53 = 0")
def e_build_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops the build if some outcomes name the wrong side."""
    return _build(spark, sf_dir, wrong=53).violations
