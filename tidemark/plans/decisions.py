"""Selections, back-tests, files and manifests over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regret, select
from ..sources import files
from ..sources.scratch import scratch_path
from .common import PORTFOLIOS_SQL, portfolios, rounded
from .registry import query, table

BY = ["portfolio"]
FORMS = ", ".join(f"({d}, {m}, {f})" for _, d, m, f in select.FORMATIONS)


def line_up_sql(score: str, name: str) -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY portfolio, position ORDER BY {score} DESC, entity) AS k FROM pf),
 {name}_t AS (SELECT portfolio, d || '-' || m || '-' || f AS formation, round(sum({score}), 9) AS total, list_sort(list(entity)) AS line_up FROM {name}_r, (VALUES {FORMS}) t(d, m, f) WHERE k <= CASE position WHEN 'G' THEN 1 WHEN 'D' THEN d WHEN 'M' THEN m ELSE f END GROUP BY 1, 2),
 {name} AS (SELECT portfolio, arg_min({{'formation': formation, 'total': total, 'line_up': line_up}}, (-total, line_up)) AS b FROM {name}_t GROUP BY 1)"""


PF = f"WITH pf AS ({PORTFOLIOS_SQL}), {line_up_sql('score', 'best')}"


@query("p_line_up", PF + " SELECT portfolio, b.formation AS formation, b.total AS line_up_score, array_to_string(b.line_up, ',') AS line_up FROM best")
def p_line_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select.best_line_up(portfolios(spark, sf_dir), BY)
    return found.withColumn("line_up", F.array_join(F.col("line_up").cast("array<string>"), ","))


DECIDED = PF + """, s AS (SELECT pf.*, b.formation AS formation, list_contains(b.line_up, entity) AS starter FROM pf JOIN best USING (portfolio)),
 k AS (SELECT *, row_number() OVER (PARTITION BY portfolio, starter ORDER BY score DESC, p_long DESC, p_played DESC, entity) AS place, row_number() OVER (PARTITION BY portfolio, starter ORDER BY CASE WHEN position = 'G' THEN 1 ELSE 0 END, score * p_played DESC, score DESC, p_played DESC, entity) AS ord FROM s),
 l AS (SELECT *, starter AND place = 1 AS lead, (1 - max(CASE WHEN starter AND place = 1 THEN p_played END) OVER (PARTITION BY portfolio)) * p_played * score AS dv FROM k),
 z AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY (starter AND NOT lead) DESC, dv DESC, score DESC, p_played DESC, p_long DESC, entity) = 1 AS deputy FROM l)"""


@query("p_decided", DECIDED + " SELECT portfolio, entity, position, club, CASE WHEN lead THEN 'LEAD' WHEN deputy THEN 'DEPUTY' WHEN starter THEN 'STARTER' ELSE 'RESERVE' END AS role, CAST(CASE WHEN starter THEN place ELSE 11 + ord END AS INTEGER) AS place, formation, round(score, 3) AS score FROM z")
def p_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.summary(select.decided(portfolios(spark, sf_dir), BY), BY)


@query("p_reasons", DECIDED + " SELECT portfolio, entity, CASE WHEN lead THEN 'lead: largest score ' || printf('%.3f', score) WHEN deputy THEN 'deputy: covers the lead, score ' || printf('%.3f', score) WHEN starter THEN 'starts in ' || formation || ', score ' || printf('%.3f', score) ELSE 'reserve ' || ord || ', score ' || printf('%.3f', score) END AS reason FROM z")
def p_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.reasons(select.decided(portfolios(spark, sf_dir), BY)).select("portfolio", "entity", "reason")


@query(
    "p_violations",
    f"""WITH pf AS ({PORTFOLIOS_SQL}), q AS (SELECT portfolio, entity, position, CASE WHEN portfolio % 5 = 1 THEN 0 ELSE club END AS club, CASE WHEN portfolio % 4 = 1 THEN p_played - 0.5 ELSE p_played END AS p1, p_long, CASE WHEN portfolio % 3 = 1 AND position = 'F' THEN 'M' ELSE position END AS pos FROM pf)
 SELECT DISTINCT portfolio, 'club limit' AS problem FROM q GROUP BY portfolio, club HAVING count(*) > 3 UNION ALL SELECT portfolio, 'positions' FROM q GROUP BY 1 HAVING count(*) FILTER (WHERE pos = 'F') <> 3 UNION ALL SELECT portfolio, 'probability outside 0..1' FROM q GROUP BY 1 HAVING min(p1) < 0 UNION ALL SELECT portfolio, 'p_long above p_played' FROM q GROUP BY 1 HAVING count(*) FILTER (WHERE p_long > p1 + 1e-12) > 0""",
)
def p_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("portfolio")
    rows = portfolios(spark, sf_dir).withColumns(
        {"club": F.when(n % 5 == 1, 0).otherwise(F.col("club")), "p_played": F.when(n % 4 == 1, F.col("p_played") - 0.5).otherwise(F.col("p_played")), "position": F.when((n % 3 == 1) & (F.col("position") == "F"), "M").otherwise(F.col("position"))}
    )
    return select.portfolio_violations(rows, BY)


@query(
    "p_risk_flags",
    f"""WITH pf AS ({PORTFOLIOS_SQL}), z AS (SELECT *, CASE entity % 4 WHEN 0 THEN 'ACQUISITION_FAILURE' WHEN 1 THEN 'SOURCE_UNAVAILABLE' ELSE 'OK' END AS quality FROM pf),
 q AS (SELECT portfolio, entity, quality, concat_ws('|', CASE WHEN entity % 3 = 0 THEN 'BLANK' END, CASE entity % 4 WHEN 0 THEN 'STATUS_I' WHEN 1 THEN 'STATUS_D' END, CASE WHEN entity % 5 > 0 AND entity % 101 < 100 THEN 'CHANCE_BELOW_100' END,
  CASE WHEN p_played < 0.6 THEN 'MAY_NOT_PLAY' END, CASE WHEN p_long < 0.5 THEN 'MAY_BE_SHORT' END, CASE WHEN exposure < 45 THEN 'LOW_EXPOSURE' END, CASE WHEN quality <> 'OK' THEN 'DATA_QUALITY' END) AS f FROM z)
 SELECT portfolio, entity, CASE WHEN f = '' THEN 'NONE' ELSE f END AS flags, quality, CASE entity % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'D' ELSE NULL END AS position FROM q""",
)
def p_risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("entity")
    second = F.when(k % 4 == 0, "Acquisition_Failure").when(k % 4 == 1, "source_unavailable").when(k % 4 == 3, "value")
    quality = select.data_quality(F.lit("value"), second)
    status = F.when(k % 4 == 0, "i").when(k % 4 == 1, "d").when(k % 4 == 2, "A")
    flags = select.risk_flags(p_played=F.col("p_played"), p_long=F.col("p_long"), exposure=F.col("exposure"), status=status, n_occurrences=k % 3, chance=F.when(k % 5 > 0, k % 101), quality=F.col("quality"))
    name = F.when(k % 3 == 0, " gk ").when(k % 3 == 1, "2").otherwise("coach")
    return portfolios(spark, sf_dir).withColumn("quality", quality).select("portfolio", "entity", flags.alias("flags"), "quality", select.position_of(name).alias("position"))


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regret.backtest(portfolios(spark, sf_dir), BY, {"score": "score", "rival": "rival"})


@query("q_line_up_regret", PF + f", {line_up_sql('actual', 'hind')} SELECT best.portfolio, round(sum(pf.actual), 6) AS line_up_points, round(max(hind.b.total), 6) AS hindsight_points, round(max(hind.b.total) - sum(pf.actual), 6) AS line_up_regret FROM best JOIN pf ON pf.portfolio = best.portfolio AND list_contains(best.b.line_up, pf.entity) JOIN hind ON hind.portfolio = best.portfolio GROUP BY 1")
def q_line_up_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_policies(spark, sf_dir).where("policy = 'score'").select("portfolio", "line_up_points", "hindsight_points", "line_up_regret"))


@query("q_lead", DECIDED + ", g AS (SELECT portfolio, max(actual) FILTER (WHERE lead AND actual_exposure > 0) AS a, max(actual) FILTER (WHERE deputy AND actual_exposure > 0) AS b, max(actual) FILTER (WHERE starter AND actual_exposure > 0) AS c FROM z GROUP BY 1) SELECT portfolio, coalesce(a, b, 0) AS lead_bonus, coalesce(c, 0) AS best_lead_bonus, a IS NULL AS deputy_needed, a IS NULL AND b IS NOT NULL AS deputy_covered FROM g")
def q_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regret.lead_points(select.decided(portfolios(spark, sf_dir), BY), BY)


def _legal_sql(p: str) -> str:
    """Whether one count of the formation is in range if reserve r takes the place of the absent starter a."""
    low, high = select.RANGES[p]
    return f"s.{p} - CAST(a.position = '{p}' AS INTEGER) + CAST(r.position = '{p}' AS INTEGER) BETWEEN {low} AND {high}"


def _moved_sql(p: str) -> str:
    return f"'{p}': s.{p} - CAST(gone.position = '{p}' AS INTEGER) + CAST(r.position = '{p}' AS INTEGER)"


#: Every order of three reserves; each reserve takes the first absent starter's place that keeps the formation legal, one after the other.
BACKTEST = f"""WITH pf AS ({PORTFOLIOS_SQL}), pp AS (SELECT portfolio, entity, position, p_played, p_long, actual, actual_exposure > 0 AS played, policy, v AS score FROM pf UNPIVOT (v FOR policy IN (score, rival))),
 lr AS (SELECT *, row_number() OVER (PARTITION BY portfolio, policy, position ORDER BY score DESC, entity) AS k FROM pp),
 lt AS (SELECT portfolio, policy, d, m, f, round(sum(score), 9) AS total, list_sort(list(entity)) AS line_up FROM lr, (VALUES {FORMS}) t(d, m, f) WHERE k <= CASE position WHEN 'G' THEN 1 WHEN 'D' THEN d WHEN 'M' THEN m ELSE f END GROUP BY ALL),
 best AS (SELECT portfolio, policy, arg_min(line_up, (-total, line_up)) AS line_up FROM lt GROUP BY 1, 2), s AS (SELECT pp.*, list_contains(line_up, entity) AS starter FROM pp JOIN best USING (portfolio, policy)),
 k AS (SELECT *, row_number() OVER (PARTITION BY portfolio, policy, starter ORDER BY score DESC, p_long DESC, p_played DESC, entity) AS place, row_number() OVER (PARTITION BY portfolio, policy, starter ORDER BY CASE WHEN position = 'G' THEN 1 ELSE 0 END, score * p_played DESC, score DESC, p_played DESC, entity) AS ord FROM s),
 l AS (SELECT *, starter AND place = 1 AS lead, (1 - max(CASE WHEN starter AND place = 1 THEN p_played END) OVER (PARTITION BY portfolio, policy)) * p_played * score AS dv FROM k),
 z AS (SELECT *, row_number() OVER (PARTITION BY portfolio, policy ORDER BY (starter AND NOT lead) DESC, dv DESC, score DESC, p_played DESC, p_long DESC, entity) = 1 AS deputy FROM l),
 g AS (SELECT portfolio, policy, sum(CASE WHEN starter THEN actual ELSE 0 END) AS line_up_points, sum(CASE WHEN starter AND played THEN actual ELSE 0 END) + CASE WHEN bool_or(starter AND position = 'G' AND NOT played) THEN sum(CASE WHEN NOT starter AND position = 'G' AND played THEN actual ELSE 0 END) ELSE 0 END AS base,
  coalesce(list(struct_pack(entity := entity, position := position) ORDER BY entity) FILTER (WHERE starter AND position <> 'G' AND NOT played), []) AS absent, coalesce(list(struct_pack(ord := ord, position := position, actual := actual)) FILTER (WHERE NOT starter AND position <> 'G' AND played), []) AS reserves,
  count(*) FILTER (WHERE starter AND position = 'D') AS D, count(*) FILTER (WHERE starter AND position = 'M') AS M, count(*) FILTER (WHERE starter AND position = 'F') AS F,
  max(actual) FILTER (WHERE lead AND played) AS own_lead, max(actual) FILTER (WHERE deputy AND played) AS own_deputy, coalesce(max(actual) FILTER (WHERE starter AND played), 0) AS best_lead_bonus FROM z GROUP BY 1, 2),
 t AS (SELECT g.*, o, list_sort([{{'o': o[r.ord], 'position': r.position, 'actual': r.actual}} FOR r IN reserves]) AS turn FROM g, (SELECT unnest([[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]]) AS o)),
 w AS (SELECT *, base + list_reduce(turn, lambda s, r: list_transform([list_filter(s.absent, lambda a: {" AND ".join(map(_legal_sql, "DMF"))})[1]],
   lambda gone: CASE WHEN gone IS NULL THEN s ELSE {{'absent': list_filter(s.absent, lambda x: x.entity <> gone.entity), {", ".join(map(_moved_sql, "DMF"))}, 'points': s.points + r.actual}} END)[1], {{'absent': absent, 'D': D, 'M': M, 'F': F, 'points': 0.0::DOUBLE}}).points AS points FROM t),
 hr AS (SELECT *, row_number() OVER (PARTITION BY portfolio, position ORDER BY actual DESC, entity) AS k FROM pf), ht AS (SELECT portfolio, d, m, f, sum(actual) AS total FROM hr, (VALUES {FORMS}) t(d, m, f) WHERE k <= CASE position WHEN 'G' THEN 1 WHEN 'D' THEN d WHEN 'M' THEN m ELSE f END GROUP BY ALL),
 hind AS (SELECT portfolio, max(total) AS hindsight_points FROM ht GROUP BY 1),
 bt AS (SELECT portfolio, policy, max(line_up_points) AS line_up_points, max(points) FILTER (WHERE o = [1, 2, 3]) AS points, max(points) AS best_points, max(coalesce(own_lead, own_deputy, 0)) AS lead_bonus, max(best_lead_bonus) AS best_lead_bonus, bool_and(own_lead IS NULL) AS deputy_needed, bool_and(own_lead IS NULL AND own_deputy IS NOT NULL) AS deputy_covered FROM w GROUP BY 1, 2),
 res AS (SELECT bt.*, hindsight_points, hindsight_points - line_up_points AS line_up_regret, best_points - points AS reserve_regret, best_lead_bonus - lead_bonus AS lead_regret FROM bt JOIN hind USING (portfolio))"""
_MEASURES = ("points", "line_up_regret", "reserve_regret", "lead_regret")


@query("q_backtest", BACKTEST + " SELECT * FROM res")
def q_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_policies(spark, sf_dir))


@query(
    "q_policy_summary",
    BACKTEST + f" SELECT policy, count(*) AS decisions, {', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in ('points', 'lead_bonus', *_MEASURES[1:]))}, round(avg(CASE WHEN deputy_needed THEN CAST(deputy_covered AS DOUBLE) END), 6) AS deputy_coverage FROM res GROUP BY 1",
)
def q_policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regret.policy_summary(_policies(spark, sf_dir)))


@query(
    "q_paired_policies",
    BACKTEST + f" SELECT policy, measure, count(*) AS pairs, round(avg(delta), 6) AS mean_delta FROM (SELECT o.policy, {', '.join(f'c.{m} - o.{m} AS {m}' for m in _MEASURES)} FROM res o JOIN res c ON c.portfolio = o.portfolio AND c.policy = 'score' AND o.policy <> 'score') UNPIVOT (delta FOR measure IN ({', '.join(_MEASURES)})) GROUP BY 1, 2",
)
def q_paired_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regret.paired_with_champion(_policies(spark, sf_dir), BY, "score"))


# --- files ----------------------------------------------------------------------------------------


@query(
    "a_picks",
    """SELECT k AS portfolio, problem FROM (SELECT CAST(floor(c_custkey / 15) AS BIGINT) AS k, count(*) AS n FROM customer GROUP BY 1) c, (SELECT unnest(['not 15 picks', 'repeated element', 'slots aren''t 1..15', 'not one lead', 'not one deputy', 'lead is deputy']) AS problem)
 WHERE (problem = 'not 15 picks' AND n <> 15) OR (problem = 'repeated element' AND k % 4 = 1 AND n > 1) OR (problem = 'slots aren''t 1..15' AND (n <> 15 OR k % 5 = 2)) OR (problem = 'not one lead' AND k % 6 = 3) OR (problem = 'lead is deputy' AND k % 7 = 4 AND k % 6 <> 3)
 OR (problem = 'not one deputy' AND k % 7 <> 4 AND n < 2)""",
)
def a_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("c_custkey") / 15)
    slot = F.col("c_custkey") % 15
    element = F.when((k % 4 == 1) & (slot == 1), F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))
    pick = F.struct(
        element.alias("element"), F.when((k % 5 == 2) & (slot == 0), 99).otherwise(slot + 1).alias("position"), ((slot == 0) & (k % 6 != 3)).alias("is_lead"), F.when(k % 7 == 4, slot == 0).otherwise(slot == 1).alias("is_deputy")
    )
    payload = F.to_json(F.struct(F.collect_list(pick).alias("picks")))
    stored = table(spark, sf_dir, "customer").groupBy(k.alias("portfolio")).agg(payload.alias("json"))
    parsed = stored.select("portfolio", F.from_json("json", "picks array<struct<element:long,position:long,is_lead:boolean,is_deputy:boolean>>").alias("p"))
    return files.picks_violations(parsed.select("portfolio", "p.picks"), BY)


@query("a_manifest", "SELECT CAST(page_id AS VARCHAR) AS path, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS n_bytes, sha256('{\"license\":\"none\",\"sha256\":\"' || sha256(html) || '\",\"source\":\"pages\"}') AS artifact_id FROM pages")
def a_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("html").cast("binary")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.sha2(content, 256).alias("sha256"), F.length(content).alias("length"))
    return files.with_artifact_id(pages, {"source": "pages", "license": "none"})


@query(
    "a_verify",
    "SELECT CAST(page_id AS VARCHAR) AS path, CASE page_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'other size' WHEN 2 THEN 'other content' END AS problem FROM pages WHERE page_id % 10 < 3",
)
def a_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, digit = a_manifest(spark, sf_dir), F.col("path").cast("long") % 10
    found = stored.where(digit != 0).withColumns({"n_bytes": F.when(digit == 1, F.col("n_bytes") + 1).otherwise(F.col("n_bytes")), "sha256": F.when(digit == 2, F.reverse("sha256")).otherwise(F.col("sha256"))})
    return files.manifest_violations(stored, found)


@query("a_append", "SELECT count(DISTINCT sha256(html)) AS n FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 2 = 0)")
def a_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = a_manifest(spark, sf_dir)
    return files.new_artifacts(new, new.where(F.col("path").cast("long") % 2 == 0)).agg(F.count(F.lit(1)).alias("n"))


@query("a_collisions", "SELECT CAST(page_id AS VARCHAR) AS path FROM pages WHERE page_id % 3 = 0 AND sha256(html) IN (SELECT sha256(html) FROM pages WHERE page_id % 3 = 0)")
def a_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts whose id is known with another content: every third page's stored digest is reversed."""
    new = a_manifest(spark, sf_dir)
    known = new.where(F.col("path").cast("long") % 3 == 0).select("artifact_id", F.reverse("sha256").alias("sha256")).distinct()
    return files.collisions(new.where(F.col("path").cast("long") % 3 == 0), known).select("path")


_NATION = "sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}')"


@query(
    "a_digest",
    f"SELECT count(*) AS rows, 'n_nationkey,n_name,n_regionkey' AS columns, concat_ws('-', {', '.join(f'sum(CAST((chr(48) || chr(120) || substr(h, {1 + 16 * k}, 16)) AS UBIGINT)::HUGEINT) % 18446744073709551616' for k in range(4))}) AS digest FROM (SELECT {_NATION} AS h FROM nation)",
)
def a_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table_digest(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("a_set", "SELECT o_orderpriority AS arm, count(*) AS rows, 'ok' AS state FROM orders GROUP BY 1 UNION ALL SELECT 'all', count(*), 'ok' FROM orders")
def a_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a folder for each priority, indexed, verified and read back."""
    path = scratch_path(spark, "set")
    index = files.write_set(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "arm"), path, "arm")
    bad = files.set_violations(spark, path, "arm")
    each = index.join(bad, "arm", "left").select("arm", "rows", F.coalesce("problem", F.lit("ok")).alias("state"))
    return each.unionByName(files.read_set(spark, path, "arm").agg(F.lit("all").alias("arm"), F.count(F.lit(1)).alias("rows"), F.lit("ok").alias("state")))


@query(
    "a_elements",
    "SELECT 'nation' AS list, CAST(n_nationkey + 1 AS INTEGER) AS ordinal, unnest(CASE WHEN n_nationkey % 7 = 3 THEN ['no id', 'no name'] WHEN n_nationkey % 4 = 0 THEN ['no name'] ELSE [] END) AS problem FROM nation UNION ALL SELECT 'region', CAST(r_regionkey + 1 AS INTEGER), 'no id' FROM region WHERE r_regionkey = 2",
)
def a_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of two lists of objects, some of which lack fields."""
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    nations = table(spark, sf_dir, "nation").select(F.struct(n.alias("k"), F.when(n % 7 != 3, n).alias("id"), F.when((n % 4 != 0) & (n % 7 != 3), F.col("n_name")).alias("name")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("nation"))
    regions = table(spark, sf_dir, "region").select(F.struct(r.alias("k"), F.when(r != 2, r).alias("id"), F.col("r_name").alias("name")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("region"))
    kind = "nation array<struct<id:int,name:string>>, region array<struct<id:int,name:string>>"
    payload = nations.join(regions).select(F.lit("p").alias("path"), F.from_json(F.to_json(F.struct("nation", "region")), kind).alias("payload"))  # one row each
    return files.element_violations(payload, {"nation": ["id", "name"], "region": ["id", "name"]}).drop("path")
