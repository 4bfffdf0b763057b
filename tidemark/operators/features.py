"""Features that cannot see the future: frames of the last rows known strictly before a cutoff.

A history row counts for a cutoff only if it was complete and available strictly before it, in the same
era. Means and deviations are NULL if any value in their frame is: a missing value is never left out
silently (``whole_*``), other than where a plain ``avg`` is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_ratio

RESTS = "3 hours"


def completed_at(kickoff: Column, completed: Column | None = None) -> Column:
    """Three hours after the start, unless known."""
    late = kickoff + F.expr(f"INTERVAL {RESTS}")
    return late if completed is None else F.coalesce(completed, late)


def eligible(history: DataFrame, cutoffs: DataFrame, *, entity: str = "entity", era: str = "era") -> DataFrame:
    """History rows (entity, era, completed_at, available_at, ...) for each cutoff (entity, era, cutoff) they count for.

    An equi-join on entity and era with the instants as a condition, so an era's history of one entity bounds it. The two
    instants are folded into one first.
    """
    known = history.withColumn("_known_at", F.greatest("completed_at", "available_at"))
    return known.join(cutoffs.select(entity, era, "cutoff").distinct(), [entity, era]).where(F.col("_known_at") < F.col("cutoff"))


def last_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The last ``most`` rows of each group, with ``recency`` 1 for the last."""
    window = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("recency", F.row_number().over(window)).where(F.col("recency") <= most)


def last_known(history: DataFrame, cutoffs: DataFrame, order: Sequence[str], most: int, *, entity: str = "entity", era: str = "era") -> DataFrame:
    """``last_rows`` of ``eligible`` for entities with long histories: rows aren't repeated for each cutoff before they are ranked.

    All rows that become known between two cutoffs count for the same ones, so only the last of them do. These meet the cutoffs.
    """
    marks = cutoffs.groupBy(entity, era).agg(F.sort_array(F.collect_set("cutoff")).alias("_cutoffs"))
    since = F.get(F.filter("_cutoffs", lambda c: c > F.greatest("completed_at", "available_at")), F.lit(0))
    placed = history.join(marks, [entity, era]).withColumn("_since", since).where("_since IS NOT NULL").drop("_cutoffs")
    few = last_rows(placed, [entity, era, "_since"], order, most).drop("_since", "recency")
    return last_rows(eligible(few, cutoffs, entity=entity, era=era), [entity, era, "cutoff"], order, most)


def _in(x: Column, n: int) -> Column:
    return F.when(F.col("recency") <= n, x)


def _complete(x: Column, n: int) -> Column:
    """All rows of the frame have the value."""
    inside = F.col("recency") <= n
    return F.count(_in(x, n)) == F.count(F.when(inside, F.lit(1)))


def whole_mean(x: Column, n: int) -> Column:
    return F.when(_complete(x, n), F.avg(_in(x.cast("double"), n)))


def whole_deviation(x: Column, n: int) -> Column:
    """Population standard deviation; 0 for one row."""
    return F.when(_complete(x, n), F.stddev_pop(_in(x.cast("double"), n)))


def whole_rate(condition: Column, n: int) -> Column:
    return whole_mean(condition.cast("double"), n)


def per_90(x: Column, exposure: Column, n: int) -> Column:
    """90 * sum(x) / (sum(exposure) + 1e-6); NULL below 90 of exposure or with a value missing."""
    total = F.sum(_in(exposure.cast("double"), n))
    return F.when(_complete(x, n) & _complete(exposure, n) & (total >= 90), 90 * F.sum(_in(x.cast("double"), n)) / (total + 1e-6))


def last_where(x: Column, condition: Column, order: Column) -> Column:
    """The value of the last row that meets the condition."""
    return F.max_by(F.when(condition, x), F.when(condition, order))


def days_between(early: Column, late: Column) -> Column:
    """From unix microseconds of two instants."""
    return (late - early) / 86_400_000_000.0


def entity_features(history: DataFrame, cutoffs: DataFrame, *, stats: Sequence[str] = (), entity: str = "entity", era: str = "era") -> DataFrame:
    """One row a cutoff. All frames (3, 5, 10) come from one ranking; cutoffs without history keep a count of 0 and NULL means."""
    by = [entity, era, "cutoff"]
    rows = eligible(history, cutoffs, entity=entity, era=era)
    order = F.struct("kickoff", "occurrence_id")
    played = F.col("exposure") > 0
    season = rows.groupBy(*by).agg(
        F.count_if(played).alias("appearances"),
        last_where(F.col("exposure"), played, order).alias("exposure_last_appearance"),
        last_where(F.col("outcome"), played, order).alias("outcome_last_appearance"),
        F.max("_known_at").alias("history_known_at"),
    )
    framed = last_rows(rows, by, ["kickoff", "occurrence_id"], 10)
    recent = framed.groupBy(*by).agg(
        whole_mean(F.col("exposure"), 3).alias("exposure_mean_last3"),
        whole_mean(F.col("exposure"), 5).alias("exposure_mean_last5"),
        whole_deviation(F.col("exposure"), 5).alias("exposure_std_last5"),
        whole_rate(played, 5).alias("played_rate_last5"),
        whole_rate(F.col("exposure") >= 60, 5).alias("long_rate_last5"),
        whole_mean(F.col("outcome"), 3).alias("outcome_mean_last3"),
        whole_mean(F.col("outcome"), 5).alias("outcome_mean_last5"),
        per_90(F.col("outcome"), F.col("exposure"), 5).alias("outcome_per90_last5"),
        *(per_90(F.col(c), F.col("exposure"), 5).alias(f"{c}_per90_last5") for c in stats),
        *(per_90(F.col(c), F.col("exposure"), 10).alias(f"{c}_per90_last10") for c in stats),
        *(whole_mean(F.col(c), 5).alias(f"{c}_mean_last5") for c in stats),
    )
    out = cutoffs.join(season, by, "left").join(recent, by, "left")
    return out.withColumn("appearances", F.coalesce("appearances", F.lit(0).cast("long")))


def side_matched_mean(history: DataFrame, wanted: DataFrame, n: int = 5) -> DataFrame:
    """Per cutoff: the mean over its target occurrences (entity, era, cutoff, target_id, side) of the mean outcome of the last n history rows on that side. Targets without such history are left out."""
    rows = history.withColumn("_known_at", F.greatest("completed_at", "available_at")).join(wanted, ["entity", "era", "side"]).where(F.col("_known_at") < F.col("cutoff"))
    per_target = last_rows(rows, ["entity", "era", "cutoff", "target_id"], ["kickoff", "occurrence_id"], n).groupBy("entity", "era", "cutoff", "target_id").agg(F.avg(F.col("outcome").cast("double")).alias("_mean"))
    return per_target.groupBy("entity", "era", "cutoff").agg(F.avg("_mean").alias("side_outcome_mean_last5"))


def group_features(results: DataFrame, cutoffs: DataFrame, prefix: str = "own", n: int = 5) -> DataFrame:
    """Last-n features of groups from results (own_group, era, kickoff, occurrence_id, scored, conceded, completed_at, available_at), once for each distinct (group, era, cutoff)."""
    by = ["own_group", "era", "cutoff"]
    rows = last_known(results, cutoffs, ["kickoff", "occurrence_id"], n, entity="own_group")
    scored, conceded = F.col("scored"), F.col("conceded")
    return rows.groupBy(*by).agg(
        whole_mean(scored, n).alias(f"{prefix}_scored_mean"),
        whole_mean(conceded, n).alias(f"{prefix}_conceded_mean"),
        whole_rate(conceded == 0, n).alias(f"{prefix}_clean_rate"),
        whole_rate(scored > conceded, n).alias(f"{prefix}_win_rate"),
        whole_rate(scored < conceded, n).alias(f"{prefix}_loss_rate"),
    )


def counter_features(wanted: DataFrame, groups: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per (entity, era, cutoff): the mean over its target occurrences' counter-groups, NULL if any of them is."""
    own = groups.withColumnRenamed("own_group", "counter_group")
    joined = wanted.join(own, ["counter_group", "era", "cutoff"], "left")
    return joined.groupBy("entity", "era", "cutoff").agg(*(F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(f"counter_{c}") for c in columns))


def interactions(attack: Column, counter_conceded: Column, clean: Column, counter_scored: Column) -> dict[str, Column]:
    return {"attack_matchup": attack * counter_conceded, "clean_matchup": clean / (1 + counter_scored)}


def context_features(status: Column, price: Column, period: Column, periods: int) -> dict[str, Column]:
    """Price in tens, the ordinal of a status code, and how far the era has come; an unknown code is NULL and named by ``unknown_status``."""
    ordinal = F.when(status == "a", 0).when(status == "d", 1).when(status.isin("i", "s", "u", "n"), 2)
    phase = F.least(F.greatest((period - 1) / (periods - 1.0), F.lit(0.0)), F.lit(1.0))
    return {"price": price / 10.0, "status_ordinal": ordinal, "phase": phase, "unknown_status": status.isNotNull() & ordinal.isNull()}


def official_forecast(value: Column, state: Column) -> Column:
    """Only a forecast whose state says so."""
    return F.when(state.isin("value", "genuine_zero"), value)


def lineage(rows: DataFrame, by: Sequence[str], source: str = "source_id") -> DataFrame:
    """The sorted distinct sources of all rows used."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(source)).alias("source_ids"))


def trailing_pick(history: DataFrame, cutoffs: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The last-n mean as of a cutoff where rows become known in the order they happen: an aggregate trails on each history row, and an as-of pick takes the last before the cutoff.

    Exact under that condition, and without the product of history and cutoffs: both sides go through one sort by instant.
    """
    order = Window.partitionBy("entity", "era").orderBy("kickoff", "occurrence_id").rowsBetween(-(n - 1), 0)
    x = F.col(column).cast("double")
    mean = F.when(F.count(x).over(order) == F.count(F.lit(1)).over(order), F.avg(x).over(order))
    events = history.select("entity", "era", F.greatest("completed_at", "available_at").alias("_at"), F.lit(1).alias("_kind"), F.struct(mean.alias("mean")).alias("_value"), "kickoff", "occurrence_id")
    marks = cutoffs.select("entity", "era", F.col("cutoff").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("struct<mean:double>").alias("_value"), F.lit(None).cast(history.schema["kickoff"].dataType).alias("kickoff"), F.lit(None).cast(history.schema["occurrence_id"].dataType).alias("occurrence_id"))
    # A cutoff sorts before history of the same instant: equality is late.
    line = Window.partitionBy("entity", "era").orderBy("_at", "_kind", "kickoff", "occurrence_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.unionByName(marks).withColumn("_last", F.last("_value", ignorenulls=True).over(line)).where("_kind = 0")
    return seen.select("entity", "era", F.col("_at").alias("cutoff"), F.col("_last.mean").alias(f"{column}_mean_last{n}")).distinct()


def coverage(frame: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, feature, rows, present, share) in one pass."""
    counts = frame.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(c) for c in columns))
    long = counts.unpivot([by, "rows"], list(columns), "feature", "present")
    return long.select(by, "feature", "rows", "present", safe_ratio(F.col("present").cast("double"), F.col("rows").cast("double")).alias("share"))


def spot_checks(frame: DataFrame, cases: DataFrame, key: Sequence[str]) -> DataFrame:
    """The named cases with the frame's row for each and ``matches``: a case must match exactly one row."""
    found = cases.join(frame.withColumn("_present", F.lit(1)), list(key), "left")
    rest = [c for c in frame.columns if c not in key]
    return found.groupBy("case", *key).agg(F.count("_present").alias("matches"), *(F.first(c, ignorenulls=True).alias(c) for c in rest))


#: Cases that a report of spot checks has to hold.
REQUIRED_CASES = ("single", "multi", "new", "flagged", "moved")


def spot_check_violations(found: DataFrame, required: Sequence[str] = REQUIRED_CASES) -> DataFrame:
    """(case, problem) of ``spot_checks``: required cases that are absent, and cases that match no row or several."""
    names = found.sparkSession.createDataFrame([(c,) for c in required], "case string")
    absent = names.join(found.select("case").distinct(), "case", "left_anti").select("case", F.lit("absent").alias("problem"))
    odd = F.when(F.col("matches") == 0, "no row").when(F.col("matches") > 1, "several rows")
    return absent.unionByName(found.select("case", odd.alias("problem")).where("problem IS NOT NULL"))
