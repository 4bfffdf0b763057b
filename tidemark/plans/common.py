"""How the star-schema tables stand for histories, cutoffs, occurrences and portfolios, in Spark and in SQL.

Each ``*_SQL`` is the body of a common table expression that gives the rows of the function of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

#: Rows of a large table that a task of a keyed step gets.
TASK_ROWS = 500_000


def tasks(rows: DataFrame) -> int | None:
    """How many tasks a large table's keyed steps are dealt to; None if the session's shuffles have enough. Their number is fixed, so a task's aggregates and sorts would grow with the table."""
    n = -(-rows.count() // TASK_ROWS)
    return n if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    return rows.repartition(n, *keys) if n else rows


HISTORY_SQL = """SELECT user_id AS entity, 2024 AS era, event_id AS occurrence_id, ts AS kickoff, ts + INTERVAL 3 HOUR AS completed_at, ts + to_hours(CAST(event_id % 48 AS INTEGER)) AS available_at,
 CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS exposure, event_id % 13 - 1 AS outcome, nullif(event_id % 7, 0) AS stat, event_type, CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS side FROM events"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the history of their users; some become available late, and some lack the statistic."""
    e = table(spark, sf_dir, "events")
    hours = F.make_dt_interval(hours=F.pmod(F.col("event_id"), F.lit(48)))
    return e.select(
        F.col("user_id").alias("entity"), F.lit(2024).alias("era"), F.col("event_id").alias("occurrence_id"), F.col("ts").alias("kickoff"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("completed_at"), (F.col("ts") + hours).alias("available_at"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("exposure"), (F.col("event_id") % 13 - 1).alias("outcome"), F.nullif(F.col("event_id") % 7, F.lit(0)).alias("stat"), "event_type",
        F.when(F.col("event_id") % 2 == 0, "home").otherwise("away").alias("side"),
    )


CUTOFFS_SQL = "SELECT entity, 2024 AS era, TIMESTAMP '2024-01-01' + to_days(CAST(3 * k AS INTEGER)) AS cutoff FROM (SELECT DISTINCT user_id AS entity FROM events), (SELECT unnest(range(1, 10)) AS k)"


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user at nine cutoffs, three days apart."""
    days = F.explode(F.sequence(F.lit(3), F.lit(27), F.lit(3))).alias("d")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity")).distinct().select("entity", days)
    return users.select("entity", F.lit(2024).alias("era"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("d"))).alias("cutoff"))


SCHEDULE_SQL = """SELECT o_orderkey AS occurrence_id, CAST(year(o_orderdate) AS INTEGER) AS era, CAST(month(o_orderdate) AS INTEGER) AS period, o_orderdate + INTERVAL 12 HOUR AS kickoff, date_trunc('month', o_orderdate) AS cutoff,
 c_nationkey + 25 * (c_custkey // 600) AS home, (c_nationkey + 1 + o_orderkey % 24) % 25 + 25 * (c_custkey // 600) AS away, CAST(CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 5 + 1 END AS DOUBLE) AS home_difficulty, CAST(o_orderkey % 4 + 1 AS DOUBLE) AS away_difficulty,
 date_trunc('month', o_orderdate) - to_days(CAST(o_orderkey % 9 AS INTEGER)) AS available_at, o_custkey AS customer FROM orders JOIN customer ON c_custkey = o_custkey"""


#: The same with whole nations as groups.
NATIONS_SQL = SCHEDULE_SQL.replace(" + 25 * (c_custkey // 600)", "")


def schedule(spark: SparkSession, sf_dir: str, *, nations: bool = False) -> DataFrame:
    """Orders as occurrences between two groups in a month of a year: a group is a nation's customers of 600 in a row, so that groups grow in number and not in size, or with ``nations`` a whole nation. A month's cutoff is its beginning, and one in nine isn't announced before it."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    month = F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz")
    key, block = F.col("o_orderkey"), F.lit(0).cast("long") if nations else 25 * F.floor(F.col("c_custkey") / 600)
    return o.select(
        key.alias("occurrence_id"), F.year("o_orderdate").alias("era"), F.month("o_orderdate").alias("period"), (F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("kickoff"), month.alias("cutoff"),
        (F.col("c_nationkey") + block).alias("home"), ((F.col("c_nationkey") + 1 + key % 24) % 25 + block).alias("away"), F.when(key % 11 != 0, key % 5 + 1).cast("double").alias("home_difficulty"), (key % 4 + 1).cast("double").alias("away_difficulty"),
        (month - F.make_dt_interval(days=key % 9)).alias("available_at"), F.col("o_custkey").alias("customer"),
    )


OUTCOMES_SQL = "SELECT era, occurrence_id, customer AS entity, CASE WHEN occurrence_id % 97 = 0 THEN -1 WHEN occurrence_id % 2 = 0 THEN home ELSE away END AS own_group, occurrence_id * 37 % 91 AS exposure, occurrence_id % 13 - 1 AS outcome FROM schedule"


NATIONS_OUTCOMES_SQL = OUTCOMES_SQL.replace("THEN -1 ", "THEN 99 ")


def outcomes(spark: SparkSession, sf_dir: str, *, nations: bool = False) -> DataFrame:
    """What the customers got out of the occurrences; a few name a group that doesn't take part."""
    s, key = schedule(spark, sf_dir, nations=nations), F.col("occurrence_id")
    group = F.when(key % 97 == 0, F.lit(99 if nations else -1).cast("long")).when(key % 2 == 0, F.col("home").cast("long")).otherwise(F.col("away"))
    return s.select("era", "occurrence_id", F.col("customer").alias("entity"), group.alias("own_group"), (key * 37 % 91).alias("exposure"), (key % 13 - 1).alias("outcome"))


SCORED_SQL = """SELECT CAST(year(o_orderdate) AS INTEGER) AS era, CAST(month(o_orderdate) AS INTEGER) AS period, o_orderkey AS entity, o_totalprice AS y, round(sum(l_extendedprice * (1 - l_discount)), 4) AS p, round(max(l_extendedprice) * 2, 4) AS q,
 o_orderpriority AS position, o_orderstatus AS status, count(*) AS n_occurrences, round(sum(l_quantity), 2) AS exposure FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderdate, o_orderkey, o_totalprice, o_orderpriority, o_orderstatus"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an actual (their price) and two predictions from their lines; the group is the month."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = tasks(lines)
    lines = dealt(lines.select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity"), n, "l_orderkey").groupBy("l_orderkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("p"), F.round(F.max("l_extendedprice") * 2, 4).alias("q"), F.count(F.lit(1)).alias("n_occurrences"), F.round(F.sum("l_quantity"), 2).alias("exposure")
    )
    orders = dealt(orders.select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"), n, "o_orderkey")
    o = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.year("o_orderdate").alias("era"), F.month("o_orderdate").alias("period"), F.col("o_orderkey").alias("entity"), F.col("o_totalprice").alias("y"), "p", "q", F.col("o_orderpriority").alias("position"), F.col("o_orderstatus").alias("status"), "n_occurrences", "exposure")


CHANCES_SQL = """SELECT CAST(year(l_shipdate) AS INTEGER) AS era, CAST(month(l_shipdate) AS INTEGER) AS period, l_orderkey * 8 + l_linenumber AS entity, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y, least(max(l_discount) * 10, 1.0) AS p, least(max(l_tax) * 12, 1.0) AS q FROM lineitem GROUP BY 1, 2, 3"""


def chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a yes or no (returned) and two probabilities with many ties; the group is the month of shipping."""
    rows, by = table(spark, sf_dir, "lineitem"), ["era", "period", "entity"]
    lines = rows.select(F.year("l_shipdate").alias("era"), F.month("l_shipdate").alias("period"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("entity"), "l_returnflag", "l_discount", "l_tax")
    return dealt(lines, tasks(rows), *by).groupBy(*by).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"), F.least(F.max("l_discount") * 10, F.lit(1.0)).alias("p"), F.least(F.max("l_tax") * 12, F.lit(1.0)).alias("q")
    )


PORTFOLIOS_SQL = """SELECT * FROM (SELECT CAST(floor(c_custkey / 15) AS BIGINT) AS portfolio, c_custkey AS entity, CASE WHEN c_custkey % 15 < 2 THEN 'G' WHEN c_custkey % 15 < 7 THEN 'D' WHEN c_custkey % 15 < 12 THEN 'M' ELSE 'F' END AS position,
 c_custkey % 5 AS club, round(c_acctbal / 1000) + 0.0::DOUBLE AS score, round(c_acctbal / 700 + c_custkey % 4) + 0.0::DOUBLE AS rival, CAST(c_custkey % 7 + 4 AS DOUBLE) / 10 AS p_played, CAST(c_custkey % 7 + 2 AS DOUBLE) / 10 AS p_long, CAST(c_custkey % 90 AS DOUBLE) AS exposure,
 CAST(c_custkey * 7919 % 16 AS DOUBLE) AS actual, CASE WHEN c_custkey * 31 % 5 = 0 THEN 0.0 ELSE 90.0 END AS actual_exposure FROM customer) QUALIFY count(*) OVER (PARTITION BY portfolio) = 15"""


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in portfolios of 15."""
    k = F.col("c_custkey")
    slot = k % 15
    rows = table(spark, sf_dir, "customer").select(
        F.floor(k / 15).alias("portfolio"), k.alias("entity"), F.when(slot < 2, "G").when(slot < 7, "D").when(slot < 12, "M").otherwise("F").alias("position"), (k % 5).alias("club"), F.round(F.col("c_acctbal") / 1000).alias("score"),
        F.round(F.col("c_acctbal") / 700 + k % 4).alias("rival"), ((k % 7 + 4).cast("double") / 10).alias("p_played"), ((k % 7 + 2).cast("double") / 10).alias("p_long"), (k % 90).cast("double").alias("exposure"),
        (k * 7919 % 16).cast("double").alias("actual"), F.when(k * 31 % 5 == 0, 0.0).otherwise(90.0).alias("actual_exposure"),
    )
    full = rows.groupBy("portfolio").count().where("count = 15").select("portfolio")
    return rows.join(full, "portfolio", "left_semi")


def rounded(frame: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show. A nudge keeps exact halves from going either way."""
    return frame.select(*(F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes))
