"""Contracts, snapshots, identities, facts, features and audits over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import contracts, facts, features, identity, leakage, snapshots
from .common import CUTOFFS_SQL, HISTORY_SQL, NATIONS_OUTCOMES_SQL, NATIONS_SQL, OUTCOMES_SQL, SCHEDULE_SQL, cutoffs, history, outcomes, rounded, schedule
from .registry import query, table

HC = f"WITH h AS ({HISTORY_SQL}), c AS ({CUTOFFS_SQL})"
ELIGIBLE = HC + ", e AS (SELECT h.*, c.cutoff FROM h JOIN c ON h.entity = c.entity AND h.era = c.era WHERE greatest(completed_at, available_at) < c.cutoff), r AS (SELECT *, row_number() OVER (PARTITION BY entity, era, cutoff ORDER BY kickoff DESC, occurrence_id DESC) AS n FROM e)"


@query(
    "f_last5_mean",
    ELIGIBLE
    + """ SELECT c.entity, c.era, c.cutoff, round(CASE WHEN count(exposure) = count(r.entity) THEN avg(exposure) END, 6) AS exposure_mean, round(CASE WHEN count(stat) = count(r.entity) THEN avg(stat) END, 6) AS stat_mean, count(r.entity) AS frame
 FROM c LEFT JOIN r ON r.entity = c.entity AND r.cutoff = c.cutoff AND n <= 5 GROUP BY 1, 2, 3""",
)
def f_last5_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["entity", "era", "cutoff"]
    c = cutoffs(spark, sf_dir)
    rows = features.last_rows(features.eligible(history(spark, sf_dir), c), by, ["kickoff", "occurrence_id"], 5)
    means = rows.groupBy(*by).agg(features.whole_mean(F.col("exposure"), 5).alias("exposure_mean"), features.whole_mean(F.col("stat"), 5).alias("stat_mean"), F.count(F.lit(1)).alias("frame"))
    return rounded(c.join(means, by, "left").withColumn("frame", F.coalesce("frame", F.lit(0).cast("long"))))


def _whole(x: str, n: int, f: str = "avg") -> str:
    return f"CASE WHEN count({x}) FILTER (WHERE n <= {n}) = count(*) FILTER (WHERE n <= {n}) THEN {f}({x}) FILTER (WHERE n <= {n}) END"


def _per90(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) FILTER (WHERE n <= {n}) = count(*) FILTER (WHERE n <= {n}) AND sum(exposure) FILTER (WHERE n <= {n}) >= 90 THEN 90 * sum({x}) FILTER (WHERE n <= {n}) / (sum(exposure) FILTER (WHERE n <= {n}) + 1e-6) END"


@query(
    "f_entity_features",
    ELIGIBLE
    + f""", s AS (SELECT entity, cutoff, count(*) FILTER (WHERE exposure > 0) AS appearances, arg_max(exposure, kickoff) FILTER (WHERE exposure > 0) AS xl, arg_max(outcome, kickoff) FILTER (WHERE exposure > 0) AS ol, max(greatest(completed_at, available_at)) AS history_known_at FROM e GROUP BY 1, 2),
 f AS (SELECT entity, cutoff, {_whole("exposure", 3)} AS m3, {_whole("exposure", 5)} AS m5, {_whole("exposure", 5, "stddev_pop")} AS d5, avg(CASE WHEN exposure > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n <= 5) AS p5, avg(CASE WHEN exposure >= 60 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n <= 5) AS l5,
 {_whole("outcome", 3)} AS o3, {_whole("outcome", 5)} AS o5, {_per90("outcome", 5)} AS o90, {_per90("stat", 5)} AS s90, {_per90("stat", 10)} AS s910, {_whole("stat", 5)} AS sm FROM r WHERE n <= 10 GROUP BY 1, 2)
 SELECT c.entity, c.era, c.cutoff, coalesce(appearances, 0) AS appearances, round(xl, 6) AS exposure_last_appearance, ol AS outcome_last_appearance, history_known_at, round(m3, 6) AS exposure_mean_last3, round(m5, 6) AS exposure_mean_last5, round(d5, 6) AS exposure_std_last5, round(p5, 6) AS played_rate_last5, round(l5, 6) AS long_rate_last5,
 round(o3, 6) AS outcome_mean_last3, round(o5, 6) AS outcome_mean_last5, round(o90, 6) AS outcome_per90_last5, round(s90, 6) AS stat_per90_last5, round(s910, 6) AS stat_per90_last10, round(sm, 6) AS stat_mean_last5
 FROM c LEFT JOIN s ON c.entity = s.entity AND c.cutoff = s.cutoff LEFT JOIN f ON c.entity = f.entity AND c.cutoff = f.cutoff""",
)
def f_entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.entity_features(history(spark, sf_dir), cutoffs(spark, sf_dir), stats=["stat"]))


WANTED_SQL = "w AS (SELECT entity, era, cutoff, k AS target_id, CASE WHEN (entity + k) % 2 = 0 THEN 'home' ELSE 'away' END AS side, (entity * 3 + k) % 25 AS counter_group FROM c, (SELECT unnest(range(0, 3)) AS k) WHERE k < entity % 4)"


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 to 3 target occurrences for each entity and cutoff."""
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("target_id")
    rows = cutoffs(spark, sf_dir).select("*", k).where(F.col("target_id") < F.col("entity") % 4)
    return rows.withColumns({"side": F.when((F.col("entity") + F.col("target_id")) % 2 == 0, "home").otherwise("away"), "counter_group": (F.col("entity") * 3 + F.col("target_id")) % 25})


@query(
    "f_side_matched",
    HC
    + f""", {WANTED_SQL}, j AS (SELECT w.entity, w.era, w.cutoff, target_id, outcome, row_number() OVER (PARTITION BY w.entity, w.cutoff, target_id ORDER BY kickoff DESC, occurrence_id DESC) AS n FROM w JOIN h ON h.entity = w.entity AND h.era = w.era AND h.side = w.side WHERE greatest(completed_at, available_at) < w.cutoff),
 m AS (SELECT entity, era, cutoff, target_id, avg(outcome) AS m FROM j WHERE n <= 5 GROUP BY 1, 2, 3, 4) SELECT entity, era, cutoff, round(avg(m), 6) AS side_outcome_mean_last5 FROM m GROUP BY 1, 2, 3""",
)
def f_side_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.side_matched_mean(history(spark, sf_dir), wanted(spark, sf_dir)))


GROUPS = f""", res AS (SELECT entity % 25 AS own_group, era, kickoff, occurrence_id, completed_at, available_at, stat AS scored, occurrence_id % 4 AS conceded FROM h), gc AS (SELECT DISTINCT entity % 25 AS own_group, era, cutoff FROM c),
 gr AS (SELECT res.*, cutoff, row_number() OVER (PARTITION BY res.own_group, cutoff ORDER BY kickoff DESC, occurrence_id DESC) AS n FROM res JOIN gc ON res.own_group = gc.own_group AND res.era = gc.era WHERE greatest(completed_at, available_at) < cutoff),
 gf AS (SELECT own_group, era, cutoff, {_whole("scored", 5)} AS own_scored_mean, {_whole("conceded", 5)} AS own_conceded_mean, avg(CASE WHEN conceded = 0 THEN 1.0 ELSE 0.0 END) AS own_clean_rate,
 CASE WHEN count(scored) = count(*) THEN avg(CASE WHEN scored > conceded THEN 1.0 ELSE 0.0 END) END AS own_win_rate, CASE WHEN count(scored) = count(*) THEN avg(CASE WHEN scored < conceded THEN 1.0 ELSE 0.0 END) END AS own_loss_rate FROM gr WHERE n <= 5 GROUP BY 1, 2, 3)"""


def groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = history(spark, sf_dir).select((F.col("entity") % 25).alias("own_group"), "era", "kickoff", "occurrence_id", "completed_at", "available_at", F.col("stat").alias("scored"), (F.col("occurrence_id") % 4).alias("conceded"))
    return features.group_features(results, cutoffs(spark, sf_dir).select((F.col("entity") % 25).alias("own_group"), "era", "cutoff"))


@query("f_group_features", HC + GROUPS + " SELECT own_group, era, cutoff, round(own_scored_mean, 6) AS own_scored_mean, round(own_conceded_mean, 6) AS own_conceded_mean, round(own_clean_rate, 6) AS own_clean_rate, round(own_win_rate, 6) AS own_win_rate, round(own_loss_rate, 6) AS own_loss_rate FROM gf")
def f_group_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(groups_of(spark, sf_dir))


@query(
    "f_matchups",
    HC + GROUPS + f""", {WANTED_SQL}, cf AS (SELECT w.entity, w.era, w.cutoff, CASE WHEN count(own_conceded_mean) = count(*) THEN avg(own_conceded_mean) END AS cc, CASE WHEN count(own_scored_mean) = count(*) THEN avg(own_scored_mean) END AS cs FROM w LEFT JOIN gf ON gf.own_group = w.counter_group AND gf.era = w.era AND gf.cutoff = w.cutoff GROUP BY 1, 2, 3)
 SELECT cf.entity, cf.era, cf.cutoff, round(cc, 6) AS counter_own_conceded_mean, round(cs, 6) AS counter_own_scored_mean, round(own_scored_mean * cc, 6) AS attack_matchup, round(own_clean_rate / (1 + cs), 6) AS clean_matchup FROM cf LEFT JOIN gf ON gf.own_group = cf.entity % 25 AND gf.era = cf.era AND gf.cutoff = cf.cutoff""",
)
def f_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = groups_of(spark, sf_dir)
    counter = features.counter_features(wanted(spark, sf_dir), own, ["own_conceded_mean", "own_scored_mean"])
    joined = counter.withColumn("own_group", F.col("entity") % 25).join(own, ["own_group", "era", "cutoff"], "left")
    made = features.interactions(F.col("own_scored_mean"), F.col("counter_own_conceded_mean"), F.col("own_clean_rate"), F.col("counter_own_scored_mean"))
    return rounded(joined.select("entity", "era", "cutoff", "counter_own_conceded_mean", "counter_own_scored_mean", *(c.alias(n) for n, c in made.items())))


@query(
    "f_trailing_pick",
    HC + """, o AS (SELECT *, avg(exposure) OVER (PARTITION BY entity ORDER BY kickoff, occurrence_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM h), k AS (SELECT c.entity, c.era, c.cutoff, arg_max(m, kickoff) AS m FROM c JOIN o ON o.entity = c.entity AND o.completed_at < c.cutoff GROUP BY 1, 2, 3)
 SELECT c.entity, c.era, c.cutoff, round(m, 6) AS exposure_mean_last5 FROM c LEFT JOIN k ON k.entity = c.entity AND k.cutoff = c.cutoff""",
)
def f_trailing_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_order = history(spark, sf_dir).withColumn("available_at", F.col("completed_at"))
    return rounded(features.trailing_pick(in_order, cutoffs(spark, sf_dir), "exposure"))


@query(
    "f_lineage",
    ELIGIBLE + " SELECT entity, cutoff, list_sort(list(DISTINCT event_type)) AS source_ids, max(greatest(completed_at, available_at)) AS known_at, max(greatest(completed_at, available_at)) < cutoff AS in_time FROM e GROUP BY entity, cutoff",
)
def f_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.eligible(history(spark, sf_dir), cutoffs(spark, sf_dir))
    known = rows.groupBy("entity", "cutoff").agg(F.max("_known_at").alias("known_at"))
    return features.lineage(rows, ["entity", "cutoff"], "event_type").join(known, ["entity", "cutoff"]).withColumn("in_time", F.col("known_at") < F.col("cutoff"))


@query(
    "f_context_features",
    """SELECT o_orderkey AS entity, round(o_totalprice / 10.0, 6) AS price, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 END AS status_ordinal, round(least(greatest((month(o_orderdate) - 1) / 11.0, 0.0), 1.0), 6) AS phase, false AS unknown_status,
 CASE WHEN o_orderkey % 5 IN (0, 1) THEN o_totalprice END AS forecast, round(date_diff('microsecond', o_orderdate, TIMESTAMP '2002-01-01') / 86400000000.0, 6) AS days FROM orders""",
)
def f_context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "a").when(F.col("o_orderstatus") == "P", "d").otherwise("i")
    made = features.context_features(status, F.col("o_totalprice"), F.month("o_orderdate"), 12)
    state = F.when(F.col("o_orderkey") % 5 == 0, "value").when(F.col("o_orderkey") % 5 == 1, "genuine_zero").otherwise("source_unavailable")
    late = F.unix_micros(F.lit("2002-01-01 00:00:00").cast("timestamp"))
    days = features.days_between(F.unix_micros(F.col("o_orderdate").cast("timestamp")), late)
    return rounded(o.select(F.col("o_orderkey").alias("entity"), *(c.alias(n) for n, c in made.items()), features.official_forecast(F.col("o_totalprice"), state).alias("forecast"), days.alias("days")))


@query(
    "f_coverage",
    ELIGIBLE
    + f""", f AS (SELECT entity, cutoff, {_whole("stat", 5)} AS stat_mean_last5, {_per90("stat", 5)} AS stat_per90_last5 FROM r WHERE n <= 10 GROUP BY 1, 2), g AS (SELECT c.era, c.entity, stat_mean_last5, stat_per90_last5 FROM c LEFT JOIN f ON c.entity = f.entity AND c.cutoff = f.cutoff)
 SELECT era, 'stat_mean_last5' AS feature, count(*) AS rows, count(stat_mean_last5) AS present, round(count(stat_mean_last5) / count(*), 6) AS share FROM g GROUP BY 1 UNION ALL SELECT era, 'stat_per90_last5', count(*), count(stat_per90_last5), round(count(stat_per90_last5) / count(*), 6) FROM g GROUP BY 1""",
)
def f_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = features.entity_features(history(spark, sf_dir), cutoffs(spark, sf_dir), stats=["stat"])
    return rounded(features.coverage(frame, "era", ["stat_mean_last5", "stat_per90_last5"]))


@query(
    "f_spot_checks",
    "WITH f AS (SELECT o_custkey AS entity, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1), c AS (SELECT 'case_' || r_regionkey AS \"case\", CAST(r_regionkey * 100 + 1 AS BIGINT) AS entity FROM region) SELECT \"case\", c.entity, CAST(count(f.entity) AS BIGINT) AS matches, max(n) AS n, max(top) AS top FROM c LEFT JOIN f USING (entity) GROUP BY 1, 2",
)
def f_spot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    cases = table(spark, sf_dir, "region").select(F.concat(F.lit("case_"), F.col("r_regionkey")).alias("case"), (F.col("r_regionkey") * 100 + 1).cast("long").alias("entity"))
    return features.spot_checks(frame, cases, ["entity"])


# --- contracts ------------------------------------------------------------------------------------


@query(
    "b_contract",
    """SELECT 'field' AS rule, l_orderkey || '|' || l_linenumber AS key, 'l_returnflag isn''t a choice' AS detail FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
 UNION ALL SELECT 'duplicate key', l_orderkey || '|' || l_linenumber, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT 'extra column', 'line', c FROM (VALUES ('l_comment_missing')) t(c) WHERE false
 UNION ALL SELECT 'large discount', l_orderkey || '|' || l_linenumber, '' FROM lineitem WHERE l_discount > 0.09""",
)
def b_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = contracts.Field
    line = contracts.Contract(
        "line", (f("l_orderkey", "integer"), f("l_linenumber", "integer"), f("l_quantity", "number"), f("l_discount", "number"), f("l_returnflag", "string", choices=("A", "N"))), ("l_orderkey", "l_linenumber"), (("large discount", lambda: F.col("l_discount") > 0.09),), extra_allowed=True
    )
    return contracts.violations(table(spark, sf_dir, "lineitem"), line)


@query(
    "b_row_rules",
    """SELECT 'negative balance' AS rule, CAST(c_custkey AS VARCHAR) AS key, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS detail FROM customer WHERE floor(c_acctbal) < 0
 UNION ALL SELECT 'balance outside', CAST(c_custkey AS VARCHAR), CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) FROM customer WHERE floor(c_acctbal) NOT BETWEEN 0 AND 5000
 UNION ALL SELECT 'state of seen', CAST(c_custkey AS VARCHAR), CASE c_custkey % 4 WHEN 0 THEN 'missing state with a value' WHEN 1 THEN 'zero must be genuine_zero' END FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_custkey % 3 = 0""",
)
def b_row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    odd = k % 3 == 0
    rows = table(spark, sf_dir, "customer").select(
        k, F.floor("c_acctbal").alias("balance"), F.when(odd & (k % 4 == 0), 5.0).when(odd & (k % 4 == 1), 0.0).when(~odd, 1.0).alias("seen"), F.when(odd & (k % 4 == 0), "source_unavailable").when(odd & (k % 4 == 1), "value").when(odd, "acquisition_failure").otherwise("value").alias("seen_state")
    )
    return contracts.union([contracts.negative_values(rows, ["balance"], ["c_custkey"]), contracts.outside(rows, "balance", 0, 5000, ["c_custkey"]), contracts.state_violations(rows, "seen", "seen_state", ["c_custkey"])])


@query(
    "b_late_capture",
    f"WITH s AS ({SCHEDULE_SQL}) SELECT 'available_at not before cutoff' AS rule, CAST(occurrence_id AS VARCHAR) AS key, strftime(available_at, '%Y-%m-%d %H:%M:%S') AS detail FROM s WHERE available_at >= cutoff",
)
def b_late_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.not_before(schedule(spark, sf_dir), "available_at", "cutoff", ["occurrence_id"])


@query(
    "b_intervals",
    """WITH v AS (SELECT o_custkey AS k, o_orderkey % 50 AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 50 + o_orderkey % 3 END AS b FROM orders), n AS (SELECT *, lead(a) OVER (PARTITION BY k ORDER BY a, b NULLS LAST) AS x FROM v)
 SELECT 'overlapping intervals' AS rule, k || '|' || a AS key, CAST(x AS VARCHAR) AS detail FROM n WHERE x IS NOT NULL AND (b IS NULL OR b >= x)""",
)
def b_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (k % 50).alias("a"), F.when(k % 5 != 0, k % 50 + k % 3).alias("b"))
    return contracts.overlapping_intervals(rows, ["k"], "a", "b")


@query(
    "b_one_to_one",
    """SELECT 'p_brand with several p_type' AS rule, p_brand AS key, CAST(count(DISTINCT p_type) AS VARCHAR) AS detail FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1 UNION ALL SELECT 'p_type with several p_brand', p_type, CAST(count(DISTINCT p_brand) AS VARCHAR) FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1""",
)
def b_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.not_one_to_one(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query(
    "b_coercion",
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '+' || (event_id % 100) WHEN 1 THEN (event_id % 100) || '.0' WHEN 2 THEN 'x' || event_id WHEN 3 THEN '0' || (event_id % 9 + 1) WHEN 4 THEN '-' || (event_id % 9 + 1) ELSE CAST(event_id AS VARCHAR) END AS raw,
 CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN '0' WHEN 2 THEN 'yes' END AS flag FROM events)
 SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id % 100 WHEN 4 THEN -(event_id % 9 + 1) WHEN 5 THEN event_id END AS as_integer, CASE WHEN event_id % 6 <> 2 THEN CAST(raw AS DOUBLE) END AS as_number, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS as_boolean, event_id % 6 IN (1, 2, 3) AS bad_integer, event_id % 4 = 2 AS bad_boolean,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM t JOIN events USING (event_id)""",
)
def b_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    kind = k % 6
    raw = F.when(kind == 0, F.concat(F.lit("+"), k % 100)).when(kind == 1, F.concat(k % 100, F.lit(".0"))).when(kind == 2, F.concat(F.lit("x"), k)).when(kind == 3, F.concat(F.lit("0"), k % 9 + 1)).when(kind == 4, F.concat(F.lit("-"), k % 9 + 1)).otherwise(k.cast("string"))
    flag = F.when(k % 4 == 0, "True").when(k % 4 == 1, "0").when(k % 4 == 2, "yes")
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), flag.alias("flag"), F.get_json_object("props", "$.k").alias("k"))
    whole, yes = scalars.strict_integer(F.col("raw")), scalars.strict_boolean(F.col("flag"))
    return rows.select("event_id", whole.alias("as_integer"), scalars.strict_number(F.col("raw")).alias("as_number"), yes.cast("int").alias("as_boolean"), scalars.unreadable(F.col("raw"), whole).alias("bad_integer"), F.coalesce(scalars.unreadable(F.col("flag"), yes), F.lit(False)).alias("bad_boolean"), scalars.strict_integer(F.col("k")).alias("k"))


@query(
    "b_aliases",
    "SELECT 'aliases disagree' AS rule, CAST(c_custkey AS VARCHAR) AS key, concat_ws('/', CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS VARCHAR) END, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey + c_custkey % 7 // 6 AS VARCHAR) END) AS detail FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 7 = 6",
)
def b_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 3 != 0, F.col("c_nationkey")).alias("a"), F.when(k % 2 == 0, F.col("c_nationkey") + (k % 7 == 6).cast("int")).alias("b"))
    return contracts.disagreeing_aliases(rows, ["a", "b"], ["c_custkey"])


@query(
    "b_value_states",
    "SELECT CASE WHEN event_type = 'view' OR event_id % 7 = 0 THEN 'source_unavailable' WHEN event_id % 7 = 3 THEN 'genuine_zero' ELSE 'value' END AS state, count(*) AS n FROM events GROUP BY 1",
)
def b_value_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("long")).otherwise(F.col("event_id") % 7 - 3)
    state = scalars.value_state(value, F.col("event_type") != "view")
    return table(spark, sf_dir, "events").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


# --- snapshots ------------------------------------------------------------------------------------

SNAPS_SQL = """WITH cal AS (SELECT 2024 AS era, k AS period, TIMESTAMP '2024-01-01' + to_days(CAST(k AS INTEGER)) AS cutoff FROM (SELECT unnest(range(1, 30)) AS k)),
 s AS (SELECT 2024 AS era, event_id, 1 + event_id * 29 // (SELECT count(*) FROM events) AS target, ts AS captured_at, event_id % 10 AS kind FROM events),
 g AS (SELECT s.*, cutoff, CASE WHEN kind = 0 THEN 'not exactly one next event' WHEN kind = 1 THEN 'next event isn''t the target' WHEN cutoff IS NULL THEN 'unknown period' WHEN kind = 2 THEN 'embedded cutoff differs' WHEN captured_at >= cutoff THEN 'captured late' END AS reject_reason FROM s LEFT JOIN cal ON cal.period = s.target)"""


def snaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    days = F.explode(F.sequence(F.lit(1), F.lit(29))).alias("period")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events")
    calendar = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit(2024).alias("era"), days).withColumn("cutoff", start + F.make_dt_interval(days=F.col("period")))
    n = e.agg(F.count(F.lit(1)).alias("n"))
    rows = e.join(F.broadcast(n)).select(F.lit(2024).alias("era"), "event_id", F.expr("CAST(1 + event_id * 29 div n AS INT)").alias("target"), F.col("ts").alias("captured_at"), (F.col("event_id") % 10).alias("kind"))
    cutoff = start + F.make_dt_interval(days=F.col("target")) + F.make_dt_interval(mins=F.when(F.col("kind") == 2, 1).otherwise(0))
    period = F.col("target") + F.when(F.col("kind") == 1, 1).otherwise(0)
    other = F.struct((F.col("target") - 1).alias("period"), (F.col("kind") == 0).alias("is_next"), cutoff.alias("cutoff"))
    return calendar, rows.withColumn("events", F.array(other, F.struct(period.alias("period"), F.lit(True).alias("is_next"), cutoff.alias("cutoff"))))


@query("c_gate", SNAPS_SQL + " SELECT coalesce(reject_reason, 'accepted') AS verdict, count(*) AS n FROM g GROUP BY 1")
def c_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar, rows = snaps(spark, sf_dir)
    return snapshots.gated(rows, calendar).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("c_latest", SNAPS_SQL + ", l AS (SELECT target, max(captured_at) AS captured_at, arg_max(event_id, captured_at) AS event_id FROM g WHERE reject_reason IS NULL GROUP BY 1) SELECT cal.era, CAST(cal.period AS INTEGER) AS period, cal.cutoff, event_id, captured_at FROM cal LEFT JOIN l ON l.target = cal.period")
def c_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar, rows = snaps(spark, sf_dir)
    accepted = snapshots.gated(rows, calendar).where("reject_reason IS NULL").select("era", F.col("target").alias("period"), "event_id", "captured_at")
    return snapshots.latest_accepted(calendar, accepted)


@query(
    "c_calendar",
    f"WITH s AS ({SCHEDULE_SQL}), e AS (SELECT DISTINCT era, period, CASE WHEN period = 7 AND era % 2 = 0 THEN cutoff - INTERVAL 40 DAY ELSE cutoff END AS cutoff FROM s), n AS (SELECT *, lag(cutoff) OVER (PARTITION BY era ORDER BY period) AS b FROM e) SELECT era, period, 'cutoff not after the one before' AS rule FROM n WHERE cutoff <= b",
)
def c_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.when((F.col("period") == 7) & (F.col("era") % 2 == 0), F.col("cutoff") - F.expr("INTERVAL 40 DAYS")).otherwise(F.col("cutoff"))
    return snapshots.calendar_violations(schedule(spark, sf_dir).select("era", "period", early.alias("cutoff")))


# --- identities -----------------------------------------------------------------------------------

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
OBSERVED_SQL = "SELECT o_custkey AS entity, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS gp, max(o_orderpriority) AS grp FROM orders GROUP BY 1, 2"
VERSIONS_SQL = f"WITH o AS ({OBSERVED_SQL}), b AS (SELECT *, lag(grp) OVER w AS before, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY entity ORDER BY gp)), v AS (SELECT entity, grp, gp AS valid_from, lead(gp) OVER (PARTITION BY entity ORDER BY gp) - 1 AS valid_to FROM b WHERE n = 1 OR grp <> before)"


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    gp = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), gp.alias("gp")).agg(F.max("o_orderpriority").alias("grp"))


@query("d_versions", VERSIONS_SQL + " SELECT * FROM v")
def d_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.versions(observed(spark, sf_dir), ["entity"], "gp", "grp")


@query(
    "d_as_of",
    VERSIONS_SQL + ", q AS (SELECT o_custkey AS entity, row_number() OVER () AS k, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER) AS gp FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT q.entity, q.gp, CASE WHEN count(v.entity) = 1 THEN max(grp) END AS grp, count(v.entity) AS matches FROM q LEFT JOIN v ON v.entity = q.entity AND q.gp BETWEEN valid_from AND coalesce(valid_to, 2147483647) GROUP BY q.entity, q.gp, q.k",
)
def d_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    gp = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("entity"), gp.alias("gp"))
    return identity.as_of(rows, identity.versions(observed(spark, sf_dir), ["entity"], "gp", "grp"), ["entity"], "gp", ["grp"])


@query(
    "d_change_log",
    """WITH c AS (SELECT user_id AS entity, CAST(day(ts) AS INTEGER) AS gp, arg_max(event_type, event_id) AS a FROM events GROUP BY 1, 2), b AS (SELECT *, lag(a) OVER w AS before, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY entity ORDER BY gp)) SELECT entity, a AS event_type, gp AS valid_from, lead(gp) OVER (PARTITION BY entity ORDER BY gp) - 1 AS valid_to FROM b WHERE n = 1 OR a <> before""",
)
def d_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("gp"), "event_type", F.col("event_id").alias("sequence"))
    return identity.change_log(changes, ["entity"], "gp", "event_type")


@query(
    "d_conflicts",
    "SELECT 'p_name' AS id_column, '' AS scope, p_name AS id, count(DISTINCT p_partkey) AS n_keys FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1 UNION ALL SELECT 'p_size', '', CAST(p_size AS VARCHAR), count(DISTINCT p_partkey) FROM part GROUP BY p_size HAVING count(DISTINCT p_partkey) > 1",
)
def d_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.conflicts(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_size"])


@query(
    "d_matches",
    """WITH n AS (SELECT p_name AS nm, list_sort(list(DISTINCT p_partkey)) AS ids FROM part GROUP BY 1) SELECT p_partkey, coalesce(array_to_string(ids, ','), '') AS candidates, CASE WHEN ids IS NULL THEN 'unmatched' WHEN len(ids) = 1 THEN 'candidate' ELSE 'ambiguous' END AS status FROM part LEFT JOIN n ON n.nm = p_name""",
)
def d_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    other = part.select(F.col("p_partkey").alias("other_id"), F.upper("p_name").alias("other_name"))
    return identity.match_proposals(part, other, left_id="p_partkey", left_name="p_name", right_id="other_id", right_name="other_name", separator=",")


@query(
    "d_keys",
    "SELECT c_custkey, c_name, lower(trim(regexp_replace(strip_accents(lower(c_name)), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS plain, sha1('x' || c_custkey) AS probe FROM customer",
)
def d_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", scalars.plain_name(F.col("c_name")).alias("plain"), F.sha1(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).cast("binary")).alias("probe"))


@query(
    "d_by_code",
    "SELECT code, CASE WHEN count(DISTINCT entity) = 1 THEN min(entity) END AS entity, count(DISTINCT entity) AS matches FROM (SELECT unnest([c_name, CAST(c_nationkey AS VARCHAR)]) AS code, c_custkey AS entity FROM customer) GROUP BY 1",
)
def d_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that name one customer (names) and codes that don't (nations)."""
    codes = F.explode(F.array(F.col("c_name"), F.col("c_nationkey").cast("string"))).alias("code")
    registry = table(spark, sf_dir, "customer").select(codes, F.col("c_custkey").alias("entity"))
    return identity.by_code(registry.select("code").distinct(), registry, "code", "entity")


RESOLVED_SQL = """WITH al AS (SELECT c_custkey AS alias, 1 AS valid_from, 36 AS valid_to, c_custkey AS entity FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 36 ELSE 37 END, NULL, c_custkey + 1 FROM customer),
 o AS (SELECT o_orderkey, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS gp, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS alias, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS supplied FROM orders),
 r AS (SELECT o_orderkey, any_value(alias) AS alias, any_value(supplied) AS supplied, count(al_entity) AS matches, max(al_entity) AS found FROM (SELECT o.*, al.entity AS al_entity FROM o LEFT JOIN al USING (alias) WHERE al.alias IS NULL OR gp BETWEEN valid_from AND coalesce(valid_to, 2147483647) UNION ALL SELECT o.*, NULL FROM o) GROUP BY 1)
 SELECT o_orderkey, CASE WHEN alias IS NULL AND supplied IS NULL THEN 'no identity' WHEN alias IS NOT NULL AND matches <> 1 THEN 'alias not known then' WHEN alias IS NOT NULL AND supplied <> found THEN 'alias of another entity' END AS problem, CASE WHEN (alias IS NULL OR matches = 1) AND (alias IS NULL OR supplied IS NULL OR supplied = found) THEN coalesce(supplied, found) END AS entity FROM r"""


@query("e_resolved", RESOLVED_SQL)
def e_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that name their customer, an alias of it, both, or none; aliases pass to the next customer after period 36, some too early."""
    k, customer = F.col("o_orderkey"), F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    first = customers.select(customer.alias("alias"), F.lit(1).alias("valid_from"), F.lit(36).alias("valid_to"), customer.alias("entity"))
    then = customers.select(customer.alias("alias"), F.when(customer % 10 == 0, 36).otherwise(37).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), (customer + 1).alias("entity"))
    gp = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", gp.alias("gp"), F.when(k % 7 != 0, F.col("o_custkey")).alias("alias"), F.when(k % 3 == 0, F.col("o_custkey")).alias("supplied"))
    return identity.resolved(rows, first.unionByName(then), alias="alias", supplied="supplied", period="gp", entity="entity").select("o_orderkey", "problem", "entity")


@query(
    "d_surrogate_keys",
    f"""SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS entity_key
 FROM (SELECT c_custkey, sha1(unhex('{SPACE.hex}') || encode('customer:' || c_custkey)) AS h FROM customer)""",
)
def d_surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.uuid5(SPACE, F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))).alias("entity_key"))


@query(
    "b_instants",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate END AS strict, CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate WHEN o_orderkey % 4 = 2 THEN o_orderdate - INTERVAL 2 HOUR END AS converted FROM orders",
)
def b_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text in UTC, in another offset, and without one."""
    k = F.col("o_orderkey") % 4
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "Z").when(k == 1, "+00:00").when(k == 2, "+02:00").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.utc_instant(text).cast("timestamp_ntz").alias("strict"), scalars.utc_instant(text, convert=True).cast("timestamp_ntz").alias("converted"))


# --- facts ----------------------------------------------------------------------------------------

FACTS = f"WITH schedule AS ({SCHEDULE_SQL}), outs AS ({OUTCOMES_SQL}), f AS (SELECT o.era, period, entity, o.occurrence_id, kickoff, own_group, CASE own_group WHEN home THEN away WHEN away THEN home END AS counter_group, CASE own_group WHEN home THEN 'home' WHEN away THEN 'away' END AS side, exposure, outcome, CASE WHEN own_group NOT IN (home, away) THEN 'group not in occurrence' END AS problem FROM outs o JOIN schedule s ON s.era = o.era AND s.occurrence_id = o.occurrence_id)"
#: The same over whole nations, for the queries that must see all of a nation's occurrences at once.
NATION_FACTS = FACTS.replace(SCHEDULE_SQL, NATIONS_SQL).replace(OUTCOMES_SQL, NATIONS_OUTCOMES_SQL)
SNAPSHOT_SQL = ", sn AS (SELECT DISTINCT era, period, customer AS entity, home AS own_group, cutoff, cutoff - INTERVAL 2 HOUR AS captured_at FROM schedule)"
CONTEXT_SQL = SNAPSHOT_SQL + """, two AS (SELECT occurrence_id, era, period, kickoff, cutoff, available_at, 'home' AS side, home AS own_group, away AS counter_group, home_difficulty AS difficulty FROM schedule UNION ALL SELECT occurrence_id, era, period, kickoff, cutoff, available_at, 'away', away, home, away_difficulty FROM schedule),
 cx AS (SELECT sn.era, sn.period, sn.entity, sn.own_group, sn.cutoff, captured_at, occurrence_id, kickoff, available_at, side, counter_group, difficulty, greatest(captured_at, max(available_at) OVER (PARTITION BY sn.era, sn.period, sn.entity)) AS known_at FROM sn JOIN two ON two.era = sn.era AND two.period = sn.period AND two.own_group = sn.own_group WHERE available_at < sn.cutoff AND kickoff > sn.cutoff),
 pr AS (SELECT sn.era, sn.period, sn.entity, count(cx.entity) AS n_occurrences, count(*) FILTER (WHERE side = 'home') AS n_home, CASE WHEN count(difficulty) = count(cx.entity) THEN avg(difficulty) END AS difficulty_mean, CASE WHEN count(difficulty) = count(cx.entity) THEN min(difficulty) END AS difficulty_min, count(cx.entity) = 0 AS is_blank, coalesce(list(occurrence_id ORDER BY kickoff, occurrence_id) FILTER (WHERE occurrence_id IS NOT NULL), []) AS occurrence_ids FROM sn LEFT JOIN cx ON cx.era = sn.era AND cx.period = sn.period AND cx.entity = sn.entity GROUP BY 1, 2, 3)"""


def _snapshots(spark: SparkSession, sf_dir: str, **which) -> DataFrame:
    s = schedule(spark, sf_dir, **which)
    return s.select("era", "period", F.col("customer").alias("entity"), F.col("home").alias("own_group"), "cutoff", (F.col("cutoff") - F.expr("INTERVAL 2 HOURS")).alias("captured_at")).distinct()


def _occurrences(spark: SparkSession, sf_dir: str, **which) -> DataFrame:
    return schedule(spark, sf_dir, **which).drop("cutoff", "customer")


def _contexts(spark: SparkSession, sf_dir: str, **which) -> DataFrame:
    return facts.context(_snapshots(spark, sf_dir, **which), _occurrences(spark, sf_dir, **which))


def _period_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = _snapshots(spark, sf_dir)
    return facts.period_rows(snapshots, facts.announced(snapshots, _occurrences(spark, sf_dir)))


def _nation_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Period rows of whole nations with the numbers of their ids instead of the ids, which are all of a nation's; what is announced; and the facts."""
    snapshots = _snapshots(spark, sf_dir, nations=True)
    known = facts.announced(snapshots, _occurrences(spark, sf_dir, nations=True))
    return facts.period_rows(snapshots, known, listed=False), known, facts.facts(outcomes(spark, sf_dir, nations=True), schedule(spark, sf_dir, nations=True))


@query("e_facts", FACTS + " SELECT * FROM f")
def e_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.facts(outcomes(spark, sf_dir), schedule(spark, sf_dir))


@query("e_context", NATION_FACTS + CONTEXT_SQL + " SELECT * REPLACE (CAST(own_group AS BIGINT) AS own_group, CAST(counter_group AS BIGINT) AS counter_group) FROM cx")
def e_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir, nations=True).select("era", "period", "entity", "own_group", "cutoff", "captured_at", "occurrence_id", "kickoff", "available_at", "side", "counter_group", "difficulty", "known_at")


@query(
    "e_context_violations",
    NATION_FACTS + CONTEXT_SQL + " SELECT rule, era, period, entity, occurrence_id FROM (SELECT sn.era, sn.period, sn.entity, occurrence_id, unnest([CASE WHEN available_at >= sn.cutoff THEN 'not announced before the cutoff' END, CASE WHEN kickoff <= sn.cutoff THEN 'starts before the cutoff' END, CASE WHEN captured_at >= sn.cutoff THEN 'captured after the cutoff' END]) AS rule FROM sn JOIN two ON two.era = sn.era AND two.period = sn.period AND two.own_group = sn.own_group) WHERE rule IS NOT NULL",
)
def e_context_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.context_violations(_snapshots(spark, sf_dir, nations=True), _occurrences(spark, sf_dir, nations=True))


SOURCES_SQL = ", so AS (SELECT sn.era, sn.period, sn.entity, array_to_string(list_sort(list_distinct(list_append(list('s' || occurrence_id % 7) FILTER (WHERE occurrence_id IS NOT NULL), 'c' || sn.entity % 3))), ',') AS sources FROM sn LEFT JOIN cx ON cx.era = sn.era AND cx.period = sn.period AND cx.entity = sn.entity GROUP BY 1, 2, 3)"


@query(
    "e_period_rows",
    FACTS + CONTEXT_SQL + SOURCES_SQL + """ SELECT pr.era, pr.period, pr.entity, n_occurrences, n_home, round(difficulty_mean, 6) AS difficulty_mean, difficulty_min, is_blank, array_to_string(occurrence_ids, ',') AS ids, sources
 FROM pr JOIN so ON so.era = pr.era AND so.period = pr.period AND so.entity = pr.entity""",
)
def e_period_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = _snapshots(spark, sf_dir).withColumn("source_id", F.concat(F.lit("c"), F.col("entity") % 3))
    known = facts.announced(snapshots, _occurrences(spark, sf_dir)).withColumn("source_id", F.concat(F.lit("s"), F.col("occurrence_id") % 7))
    rows = facts.period_rows(snapshots, known, source="source_id").withColumn("sources", F.array_join("source_ids", ","))
    return rounded(rows.select("era", "period", "entity", "n_occurrences", "n_home", "difficulty_mean", "difficulty_min", "is_blank", F.array_join(F.col("occurrence_ids").cast("array<string>"), ",").alias("ids"), "sources"))


@query("e_rolled_up", FACTS + " SELECT era, period, entity, CAST(sum(outcome) AS BIGINT) AS outcome, CAST(sum(exposure) AS BIGINT) AS exposure, array_to_string(list_sort(list(occurrence_id)), ',') AS ids FROM f GROUP BY 1, 2, 3")
def e_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = facts.rolled_up(e_facts(spark, sf_dir))
    return up.select("era", "period", "entity", "outcome", "exposure", F.array_join(F.col("fact_ids").cast("array<string>"), ",").alias("ids"))


LABELS_SQL = CONTEXT_SQL + ", up AS (SELECT era, period, entity, sum(outcome) AS o, sum(exposure) AS x, list_sort(list(occurrence_id)) AS ids FROM f GROUP BY 1, 2, 3)"


@query(
    "e_labelled",
    FACTS + LABELS_SQL + " SELECT pr.era, pr.period, pr.entity, is_blank, CAST(coalesce(o, 0) AS BIGINT) AS y_outcome, CAST(coalesce(x, 0) AS BIGINT) AS y_exposure, CAST(coalesce(x, 0) > 0 AS INTEGER) AS y_played, CAST(coalesce(x, 0) >= 60 AS INTEGER) AS y_long, CAST(coalesce(o, 0) >= 5 AS INTEGER) AS y_high5, CAST(coalesce(o, 0) >= 10 AS INTEGER) AS y_high10, CAST(CASE WHEN x > 0 THEN o END AS BIGINT) AS y_outcome_if_played FROM pr LEFT JOIN up ON up.era = pr.era AND up.period = pr.period AND up.entity = pr.entity",
)
def e_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _period_rows(spark, sf_dir).select(*facts.KEY, "is_blank")
    return facts.labelled(rows, e_facts(spark, sf_dir))


@query(
    "e_label_violations",
    FACTS + CONTEXT_SQL + " SELECT 'fact without a row' AS rule, era, period, entity, occurrence_id FROM f WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.era = f.era AND pr.period = f.period AND pr.entity = f.entity) UNION ALL SELECT 'occurrence wasn''t known', f.era, f.period, f.entity, occurrence_id FROM f JOIN pr ON pr.era = f.era AND pr.period = f.period AND pr.entity = f.entity WHERE NOT list_contains(occurrence_ids, occurrence_id)",
)
def e_label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.label_violations(_period_rows(spark, sf_dir), e_facts(spark, sf_dir))


@query(
    "e_reconciled",
    NATION_FACTS + LABELS_SQL + """ SELECT count(up.entity) AS fact_keys, count(pr.entity) AS row_keys, count(*) FILTER (WHERE pr.entity IS NULL) AS facts_without_row, count(*) FILTER (WHERE is_blank) AS blanks, count(*) FILTER (WHERE n_occurrences > 1) AS multis, CAST(coalesce(sum(o), 0) AS BIGINT) AS fact_outcome, CAST(coalesce(sum(CASE WHEN pr.entity IS NOT NULL THEN o END), 0) AS BIGINT) AS row_outcome, CAST(coalesce(sum(x), 0) AS BIGINT) AS fact_exposure, CAST(coalesce(sum(CASE WHEN pr.entity IS NOT NULL THEN x END), 0) AS BIGINT) AS row_exposure,
 count(*) FILTER (WHERE pr.entity IS NULL AND o <> 0) AS keys_with_other_outcome, count(*) FILTER (WHERE len(occurrence_ids) > 0 AND (ids IS NULL OR list_sort(occurrence_ids) <> ids)) AS keys_with_other_ids, (SELECT count(*) FROM (SELECT 1 FROM f GROUP BY era, period, entity, occurrence_id HAVING count(*) > 1)) AS repeated_facts, (SELECT count(*) FROM (SELECT 1 FROM pr GROUP BY era, period, entity HAVING count(*) > 1)) AS repeated_rows, (SELECT count(*) FROM pr WHERE len(list_distinct(occurrence_ids)) < len(occurrence_ids)) AS rows_with_repeated_ids
 FROM up FULL JOIN pr ON up.era = pr.era AND up.period = pr.period AND up.entity = pr.entity""",
)
def e_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known, happened = _nation_rows(spark, sf_dir)
    rows = rows.select(*facts.GROUP, "entity", "is_blank", "n_occurrences", "n_ids", "n_distinct_ids")
    return facts.reconciled(happened, facts.labelled(rows, happened), known)


ROWS_SQL = FACTS + LABELS_SQL + """, w AS (SELECT pr.era, pr.period, pr.entity, n_occurrences, n_home, n_occurrences + CASE WHEN pr.entity % 11 = 0 THEN 1 ELSE 0 END AS moved, is_blank, occurrence_ids, coalesce(o, 0) AS o, coalesce(x, 0) AS x FROM pr LEFT JOIN up ON up.era = pr.era AND up.period = pr.period AND up.entity = pr.entity)"""


def _wronged(rows: DataFrame, happened: DataFrame) -> DataFrame:
    """Labelled period rows: every eleventh entity's count is one too large, and every thirteenth's played flag is turned."""
    made = facts.labelled(rows.withColumn("known_at", F.col("captured_at")), happened)
    wrong = F.col("n_occurrences") + F.when(F.col("entity") % 11 == 0, 1).otherwise(0)
    return made.withColumns({"n_occurrences": wrong, "y_played": F.when(F.col("entity") % 13 == 0, 1 - F.col("y_played")).otherwise(F.col("y_played"))})


@query(
    "b_model_rows",
    NATION_FACTS + ROWS_SQL.removeprefix(FACTS) + """ SELECT rule, era, period, entity FROM (SELECT era, period, entity, unnest([CASE WHEN is_blank <> (moved = 0) THEN 'blank disagrees with the count' END, CASE WHEN len(occurrence_ids) <> moved THEN 'ids disagree with the count' END, CASE WHEN len(list_distinct(occurrence_ids)) < len(occurrence_ids) THEN 'repeated ids' END, CASE WHEN entity % 13 = 0 THEN 'y_played disagrees' END, CASE WHEN is_blank AND (o <> 0 OR x <> 0) THEN 'blank with an outcome' END]) AS rule FROM w) WHERE rule IS NOT NULL""",
)
def b_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, happened = _nation_rows(spark, sf_dir)
    return facts.row_violations(_wronged(rows, happened))


@query(
    "f_inputs",
    ROWS_SQL + " SELECT 'other number of contexts' AS rule, era, period, entity FROM w WHERE moved <> n_occurrences UNION ALL SELECT 'other number of home contexts', era, period, entity FROM w WHERE entity % 17 = 0",
)
def f_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wronged(_period_rows(spark, sf_dir), e_facts(spark, sf_dir)).withColumn("n_home", F.col("n_home") + F.when(F.col("entity") % 17 == 0, 1).otherwise(0))
    return facts.input_violations(rows, _contexts(spark, sf_dir))


@query(
    "b_registry",
    """SELECT rule, c_custkey, valid_from FROM (SELECT c_custkey, 10 AS valid_from, unnest([CASE WHEN c_custkey % 5 = 0 THEN 'inverted interval' END, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 3 = 0 THEN 'no audit note' END, CASE WHEN (c_custkey % 4 = 0) <> (c_custkey % 8 = 0) THEN 'method and confidence disagree' END, CASE WHEN (c_custkey % 4 = 0) <> (c_custkey % 12 = 0) THEN 'unresolved and the id disagree' END]) AS rule FROM customer) WHERE rule IS NOT NULL""",
)
def b_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    method = F.when(k % 4 == 0, "unresolved").when(k % 4 == 1, "manual").otherwise("code")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit(10).alias("valid_from"), F.when(k % 5 == 0, 9).when(k % 5 == 1, 12).alias("valid_to"), method.alias("method"), F.when(k % 8 == 0, "unresolved").otherwise("exact").alias("confidence"), F.when(k % 3 == 0, "").otherwise("seen").alias("note"), F.when(k % 12 != 0, k).alias("foreign_id")
    )
    return identity.registry_violations(rows, ["c_custkey"], foreign_id="foreign_id")


@query(
    "e_anchors",
    f"WITH s AS ({SCHEDULE_SQL}) SELECT era, period, customer, concat_ws(',', CASE WHEN count(DISTINCT coalesce(CAST(available_at AS VARCHAR), 'null')) > 1 THEN 'available_at' END, CASE WHEN count(DISTINCT coalesce(CAST(home_difficulty AS VARCHAR), 'null')) > 1 THEN 'home_difficulty' END) AS anchors FROM s GROUP BY 1, 2, 3 HAVING anchors <> ''",
)
def e_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.anchor_violations(schedule(spark, sf_dir), ["era", "period", "customer"], ["cutoff", "available_at", "home_difficulty"])


@query(
    "e_schedule_violations",
    "SELECT 'repeated occurrence' AS rule, l_orderkey AS occurrence_id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'same group on both sides', l_orderkey FROM lineitem WHERE l_partkey % 25 = l_suppkey % 25",
)
def e_schedule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("era"), F.col("l_orderkey").alias("occurrence_id"), (F.col("l_partkey") % 25).alias("home"), (F.col("l_suppkey") % 25).alias("away"))
    return facts.schedule_violations(rows)


# --- audits ---------------------------------------------------------------------------------------


@query(
    "g_provenance",
    HC + " SELECT 'available_at' AS \"column\", 'not before the cutoff' AS problem, count(*) AS n FROM h JOIN c ON h.entity = c.entity WHERE h.kickoff < c.cutoff AND available_at >= cutoff UNION ALL SELECT 'completed_at', 'not before the cutoff', count(*) FROM h JOIN c ON h.entity = c.entity WHERE h.kickoff < c.cutoff AND completed_at >= cutoff",
)
def g_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).join(cutoffs(spark, sf_dir), ["entity", "era"]).where("kickoff < cutoff")
    late = leakage.late_provenance(rows.select("occurrence_id", "cutoff", "available_at", "completed_at"), ["occurrence_id"], ["available_at", "completed_at"], "cutoff")
    return late.groupBy("column", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g_fold",
    """WITH a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-12-15') SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM a INTERSECT SELECT o_orderkey FROM b)) AS shared_keys, (SELECT max(CAST(year(o_orderdate) AS INTEGER)) FROM a) AS train_last_era, (SELECT max(o_orderdate) FROM a) AS train_last_cutoff, (SELECT min(CAST(year(o_orderdate) AS INTEGER)) FROM b) AS test_first_era, (SELECT min(o_orderdate) FROM b) AS test_first_cutoff,
 (SELECT max(year(o_orderdate)) FROM a) <= (SELECT min(year(o_orderdate)) FROM b) AND (SELECT max(o_orderdate) FROM a) < (SELECT min(o_orderdate) FROM b) AS chronological""",
)
def g_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("era", F.year("o_orderdate"))
    return leakage.fold_violations(rows.where("o_orderdate < '1998-01-01'"), rows.where("o_orderdate >= '1997-12-15'"), ["o_orderkey"], "era", "o_orderdate")


@query(
    "g_fitted",
    "SELECT o_orderkey, 'fitted but not in training' AS problem FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey, 'in training but not fitted' FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT o_orderkey, 'held out but fitted' FROM orders WHERE o_orderkey % 10 = 3",
)
def g_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, digit = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 10
    return leakage.fit_violations(rows.where(digit < 3), rows.where(digit.isin(0, 2, 3)), rows.where(digit >= 3), ["o_orderkey"])


@query(
    "g_proxies",
    "SELECT 'l_extendedprice' AS feature, 'twice' AS target, count(*) AS n, round(corr(l_extendedprice, l_extendedprice * 2 + 1), 6) AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', 'net', count(*), round(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 6) FROM lineitem HAVING abs(corr(l_extendedprice, l_extendedprice * (1 - l_discount))) >= 0.995",
)
def g_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"twice": F.col("l_extendedprice") * 2 + 1, "net": F.col("l_extendedprice") * (1 - F.col("l_discount"))})
    return rounded(leakage.suspicious_features(rows, ["l_extendedprice", "l_quantity"], ["twice", "net"]))


@query(
    "g_release_gate",
    "SELECT 'duplicate key' AS \"check\", l_orderkey || '|' || l_linenumber AS subject FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'forbidden name', 'y_points' UNION ALL SELECT 'provenance', 'l_shipdate not before the cutoff' FROM lineitem HAVING count(*) > 0",
)
def g_release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", F.col("l_tax").alias("y_points"), F.lit("1995-06-01 00:00:00").cast("timestamp_ntz").alias("cutoff"))
    return leakage.release_gate(rows, ["l_orderkey", "l_linenumber"], ["l_quantity", "y_points"], required=["l_shipdate"], cutoff="cutoff")
