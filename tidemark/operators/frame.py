"""The frame of all features: one row an entity and period, its columns driven by a contract that is data.

Histories are normalised first (``entity_history``, ``two_sided``), then summed up once each: an entity's rows for each of its cutoffs in
one pass over one ranking, a group's for each distinct group and cutoff, whether it is a row's own group or a counter-group of its
occurrences. What depends on a group and cutoff alone is joined to the rows afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import STATES, is_finite, strict_number, unreadable
from .facts import GROUP, KEY, sides
from .features import RESTS, completed_at, context_features, days_between, eligible, interactions, last_known, last_where, official_forecast, per_90, whole_deviation, whole_mean, whole_rate

VERSION = "1"


@dataclass(frozen=True)
class Feature:
    name: str
    type: str
    source: str
    window: str
    missing: str


# The features in their order, with type, where they come from, over which rows, and when they are NULL.
_CONTRACT = """
position|string|snapshot|period|never
price|double|snapshot|period|never
n_occurrences|bigint|schedule|period|never
n_home|bigint|schedule|period|never
difficulty_mean|double|schedule|period|blank, or one unknown
difficulty_min|double|schedule|period|blank, or one unknown
rest_days|double|group results|last row|blank, or no row
idle_days|double|entity history|last played row|blank, or never played
status_ordinal|int|snapshot|period|state says missing
chance|double|snapshot|period|state says missing
appearances|bigint|entity history|era to date|never
phase|double|calendar|period|never
exposure_last_appearance|double|entity history|last played row|never played
exposure_mean_last3|double|entity history|last 3|no row
exposure_mean_last5|double|entity history|last 5|no row
exposure_std_last5|double|entity history|last 5|no row
played_rate_last5|double|entity history|last 5|no row
long_rate_last5|double|entity history|last 5|no row
started_rate_last5|double|entity history|last 5|no row, or one unknown
outcome_mean_last3|double|entity history|last 3|no row
outcome_mean_last5|double|entity history|last 5|no row
outcome_per90_last5|double|entity history|last 5|under 90 of exposure
scored_per90_last5|double|entity history|last 5|under 90 of exposure, or one unknown
assisted_per90_last5|double|entity history|last 5|under 90 of exposure, or one unknown
expected_scored_per90_last5|double|entity history|last 5|under 90 of exposure, or one unknown, or no foreign id
expected_assisted_per90_last5|double|entity history|last 5|under 90 of exposure, or one unknown, or no foreign id
attempts_per90_last5|double|entity history|last 5|under 90 of exposure, or one unknown, or no foreign id
openings_per90_last5|double|entity history|last 5|under 90 of exposure, or one unknown, or no foreign id
rating_per90_last5|double|entity history|last 5|under 90 of exposure, or one unknown
bonus_per90_last5|double|entity history|last 5|under 90 of exposure, or one unknown
warnings_per90_last10|double|entity history|last 10|under 90 of exposure, or one unknown
side_outcome_mean_last5|double|entity history|last 5 on each occurrence's side|no such row
own_scored_mean_last5|double|group results|last 5|no row
own_expected_mean_last5|double|group results|last 5|no row, or one unknown
own_conceded_mean_last5|double|group results|last 5|no row
own_expected_conceded_mean_last5|double|group results|last 5|no row, or one unknown
own_clean_rate_last5|double|group results|last 5|no row
own_win_rate_last5|double|group results|last 5|no row
counter_scored_mean_last5|double|group results|last 5 of each counter-group|blank, or one NULL
counter_expected_mean_last5|double|group results|last 5 of each counter-group|blank, or one NULL
counter_conceded_mean_last5|double|group results|last 5 of each counter-group|blank, or one NULL
counter_expected_conceded_mean_last5|double|group results|last 5 of each counter-group|blank, or one NULL
counter_clean_rate_last5|double|group results|last 5 of each counter-group|blank, or one NULL
counter_loss_rate_last5|double|group results|last 5 of each counter-group|blank, or one NULL
attack_matchup|double|own_scored_mean_last5 * counter_conceded_mean_last5|-|either NULL
clean_matchup|double|own_clean_rate_last5 / (1 + counter_scored_mean_last5)|-|either NULL
"""
CONTRACT = tuple(Feature(*line.split("|")) for line in _CONTRACT.strip().splitlines())
NAMES = tuple(f.name for f in CONTRACT)

#: Statistics of a history row, and the names they may come under.
STATISTICS: dict[str, tuple[str, ...]] = {
    "started": ("started", "starts"),
    "scored": ("scored", "goals"),
    "assisted": ("assisted", "assists"),
    "expected_scored": ("expected_scored", "xg"),
    "expected_assisted": ("expected_assisted", "xa"),
    "attempts": ("attempts", "shots"),
    "openings": ("openings", "key_passes"),
    "rating": ("rating",),
    "bonus": ("bonus",),
    "warnings": ("warnings", "cards"),
}
#: Those that another provider gives, known only for entities with its id.
FOREIGN = ("expected_scored", "expected_assisted", "attempts", "openings")
PER_90 = ("scored", "assisted", *FOREIGN, "rating", "bonus")
_GROUP_STATS = ("scored_mean", "expected_mean", "conceded_mean", "expected_conceded_mean", "clean_rate")


# --- histories ------------------------------------------------------------------------------------


def _require(rows: DataFrame, names: Sequence[str], what: str) -> None:
    lost = [n for n in names if n not in rows.columns]
    if lost:
        raise ValueError(f"{what} lacks {', '.join(lost)}")


def _number(rows: DataFrame, name: str) -> Column:
    """A column as a nullable double: text is parsed strictly, numbers are taken if finite."""
    if isinstance(rows.schema[name].dataType, T.StringType):
        return strict_number(F.col(name).cast("string"))
    number = F.col(name).cast("double")
    return F.when(is_finite(number), number)


def _first_number(rows: DataFrame, names: Sequence[str]) -> Column:
    there = [_number(rows, n) for n in names if n in rows.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


def _instants(rows: DataFrame) -> dict[str, Column]:
    done = completed_at(F.col("kickoff"), F.col("completed_at") if "completed_at" in rows.columns else None)
    return {"completed_at": done, "available_at": F.coalesce(F.col("available_at"), done) if "available_at" in rows.columns else done}


def entity_history(rows: DataFrame, statistics: Mapping[str, Sequence[str]] = STATISTICS) -> DataFrame:
    """History rows (era, entity, occurrence_id, kickoff, side, exposure, outcome) with every statistic as a nullable double, under the first of its names that has a value.

    A row is complete three hours after its start unless it says when, and available when complete unless it says when.
    """
    _require(rows, ("era", "entity", "occurrence_id", "kickoff", "side", "exposure", "outcome"), "the entity history")
    kept = [c for c in ("own_group", "source_id") if c in rows.columns]
    numbers = {c: _number(rows, c) for c in ("exposure", "outcome")} | {n: _first_number(rows, names) for n, names in statistics.items()}
    made = numbers | _instants(rows)
    return rows.select("era", "entity", "occurrence_id", "kickoff", "side", *kept, *(c.alias(n) for n, c in made.items()))


def history_violations(rows: DataFrame, statistics: Mapping[str, Sequence[str]] = STATISTICS) -> DataFrame:
    """(rule, era, entity, occurrence_id): required values that are missing, and values that aren't numbers."""
    rules = [F.when(F.col(c).isNull(), f"{c} is missing") for c in ("era", "entity", "occurrence_id", "kickoff", "side", "exposure", "outcome")]
    for name in (n for names in [("exposure",), ("outcome",), *statistics.values()] for n in names if n in rows.columns):
        rules.append(F.when(unreadable(F.col(name).cast("string"), _number(rows, name)), f"{name} isn't a number"))
    return rows.select(F.explode(F.array(*rules)).alias("rule"), "era", "entity", "occurrence_id").where("rule IS NOT NULL")


def two_sided(results: DataFrame) -> DataFrame:
    """Results of occurrences, (home, away, home_scored, away_scored) and, if known, (home_expected, away_expected), as one row for each side: scored and conceded swap. Rows that have a side's own_group are taken as they are."""
    kept = [c for c in ("source_id",) if c in results.columns]
    names = ("scored", "conceded", "expected", "expected_conceded")
    if "own_group" in results.columns:
        _require(results, ("era", "occurrence_id", "kickoff", "own_group", "scored", "conceded"), "the group results")
        numbers = [_first_number(results, (n,)).alias(n) for n in names]
        return results.select("era", "occurrence_id", "kickoff", *kept, "own_group", *numbers, *(c.alias(n) for n, c in _instants(results).items()))
    _require(results, ("era", "occurrence_id", "kickoff", "home", "away", "home_scored", "away_scored"), "the results")

    def side(own: str, other: str) -> Column:
        values = [_first_number(results, (f"{o}_{n}",)) for n in ("scored", "expected") for o in (own, other)]
        return F.struct(F.col(own).alias("own_group"), *(v.alias(n) for v, n in zip(values, ("scored", "conceded", "expected", "expected_conceded"))))

    both = results.withColumns(_instants(results)).select("era", "occurrence_id", "kickoff", *kept, "completed_at", "available_at", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("_s"))
    return both.select("era", "occurrence_id", "kickoff", *kept, "_s.*", "completed_at", "available_at")


# --- the parts ------------------------------------------------------------------------------------


def _sources(rows: DataFrame) -> list[Column]:
    return [F.collect_set("source_id").alias("_sources")] if "source_id" in rows.columns else []


def entity_part(history: DataFrame, marks: DataFrame) -> DataFrame:
    """All features of an entity's own history for each (entity, era, cutoff), from one ranking over its rows known before the cutoff; a row's place on its side is counted in the same order."""
    by = ["entity", "era", "cutoff"]
    late = Window.partitionBy(*by).orderBy(F.col("kickoff").desc(), F.col("occurrence_id").desc())
    upto = late.rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(F.col("side") == "home", F.count_if(F.col("side") == "home").over(upto)).when(F.col("side") == "away", F.count_if(F.col("side") == "away").over(upto))
    rows = eligible(history, marks).withColumns({"recency": F.row_number().over(late), "_side": place})
    played, order = F.col("exposure") > 0, F.struct("kickoff", "occurrence_id")
    exposure, outcome = F.col("exposure"), F.col("outcome")
    return rows.groupBy(*by).agg(
        F.count_if(played).alias("appearances"),
        last_where(exposure, played, order).alias("exposure_last_appearance"),
        last_where(outcome, played, order).alias("outcome_last_appearance"),
        last_where(F.col("kickoff"), played, order).alias("_last_played"),
        whole_mean(exposure, 3).alias("exposure_mean_last3"),
        whole_mean(exposure, 5).alias("exposure_mean_last5"),
        whole_deviation(exposure, 5).alias("exposure_std_last5"),
        whole_rate(played, 5).alias("played_rate_last5"),
        whole_rate(exposure >= 60, 5).alias("long_rate_last5"),
        whole_mean(F.col("started"), 5).alias("started_rate_last5"),
        whole_mean(outcome, 3).alias("outcome_mean_last3"),
        whole_mean(outcome, 5).alias("outcome_mean_last5"),
        per_90(outcome, exposure, 5).alias("outcome_per90_last5"),
        *(per_90(F.col(c), exposure, 5).alias(f"{c}_per90_last5") for c in PER_90),
        per_90(F.col("warnings"), exposure, 10).alias("warnings_per90_last10"),
        *(F.avg(F.when((F.col("side") == s) & (F.col("_side") <= 5), outcome)).alias(f"_{s}_mean") for s in ("home", "away")),
        F.max("available_at").alias("_known"),
        *_sources(history),
    )


def group_part(results: DataFrame, marks: DataFrame) -> DataFrame:
    """Features of each (own_group, era, cutoff) from its last five results known before the cutoff."""
    by = ["own_group", "era", "cutoff"]
    rows = last_known(results, marks, ["kickoff", "occurrence_id"], 5, entity="own_group")
    scored, conceded = F.col("scored"), F.col("conceded")
    return rows.groupBy(*by).agg(
        whole_mean(scored, 5).alias("scored_mean"),
        whole_mean(F.col("expected"), 5).alias("expected_mean"),
        whole_mean(conceded, 5).alias("conceded_mean"),
        whole_mean(F.col("expected_conceded"), 5).alias("expected_conceded_mean"),
        whole_rate(conceded == 0, 5).alias("clean_rate"),
        whole_rate(scored > conceded, 5).alias("win_rate"),
        whole_rate(scored < conceded, 5).alias("loss_rate"),
        F.max("kickoff").alias("last_kickoff"),
        F.max("available_at").alias("_known"),
        *_sources(results),
    )


def groups_part(marks: DataFrame, known: DataFrame, results: DataFrame) -> DataFrame:
    """For each of ``GROUP``: its own features, its first occurrence, how many are on each side, and the means over its counter-groups (NULL if one of them is)."""
    counters = known.select(F.col("counter_group").alias("own_group"), "era", "cutoff")
    one = group_part(results, marks.select("own_group", "era", "cutoff").unionByName(counters).distinct())
    there = "_sources" in one.columns
    met = known.select(*GROUP, "kickoff", "side", "counter_group", "available_at", *(["source_id"] if "source_id" in known.columns else []))
    met = met.join(one.withColumnRenamed("own_group", "counter_group"), ["counter_group", "era", "cutoff"], "left")
    listed = F.collect_set("source_id") if "source_id" in met.columns else F.array().cast("array<string>")
    used = F.flatten(F.collect_list("_sources")) if there else F.array().cast("array<string>")
    every = F.count(F.lit(1))
    counter = met.groupBy(*GROUP).agg(
        *(F.when(F.count(c) == every, F.avg(c)).alias(f"counter_{c}_last5") for c in (*_GROUP_STATS, "loss_rate")),
        F.min("kickoff").alias("_first_kickoff"),
        F.count_if(F.col("side") == "home").alias("_homes"),
        F.count_if(F.col("side") == "away").alias("_aways"),
        F.greatest(F.max("available_at"), F.max("_known")).alias("_counter_known"),
        F.array_distinct(F.concat(listed, used)).alias("_counter_sources"),
    )
    own = one.select("own_group", "era", "cutoff", *(F.col(c).alias(f"own_{c}_last5") for c in (*_GROUP_STATS, "win_rate")), "last_kickoff", F.col("_known").alias("_own_known"), *([F.col("_sources").alias("_own_sources")] if there else []))
    return marks.join(own, ["own_group", "era", "cutoff"], "left").join(counter, list(GROUP), "left")


# --- the frame ------------------------------------------------------------------------------------


def _micros(instant: Column) -> Column:
    return F.unix_micros(instant.cast("timestamp"))


def feature_frame(rows: DataFrame, known: DataFrame, history: DataFrame, results: DataFrame, *, periods: int = 38) -> DataFrame:
    """One row for each of ``rows``: its key, instants, lineage and official forecast, then the features of the contract in order and type.

    ``rows`` are period rows with position, price, status, chance, forecast (each of the three with ``_state``), foreign_id, own_group,
    cutoff and captured_at; ``known`` is what ``facts.announced`` gives for them; ``history`` and ``results`` come from ``entity_history`` and
    ``two_sided``. ``known_at`` is the latest instant at which any of what a row uses became known; ``frame_violations`` holds it against
    the cutoff. Outcomes of the row's own period can't be among the inputs, as only what is known strictly before the cutoff is read.
    """
    entity = entity_part(history, rows.select("entity", "era", "cutoff").distinct())
    group = groups_part(rows.select(*GROUP).distinct(), known, results)
    sources = [c for c, there in (("_sources", "_sources" in entity.columns), ("_own_sources", "_own_sources" in group.columns)) if there]
    rows = rows.select(*(F.col(c) for c in rows.columns if c not in ("known_at", "source_ids")), *([F.col("source_ids").alias("_row_sources")] if "source_ids" in rows.columns else []))
    joined = rows.join(entity, ["entity", "era", "cutoff"], "left").join(group, list(GROUP), "left")

    context = context_features(F.lower("status"), F.col("price"), F.col("period"), periods)
    missing = lambda c: F.col(f"{c}_state").isin(*STATES[2:])
    first = _micros(F.col("_first_kickoff"))
    homes, aways = (F.when(F.col(m).isNotNull(), F.coalesce(n, F.lit(0))).otherwise(0) for m, n in (("_home_mean", "_homes"), ("_away_mean", "_aways")))
    total = homes * F.coalesce("_home_mean", F.lit(0.0)) + aways * F.coalesce("_away_mean", F.lit(0.0))
    pairs = interactions(F.col("own_scored_mean_last5"), F.col("counter_conceded_mean_last5"), F.col("own_clean_rate_last5"), F.col("counter_scored_mean_last5"))
    made = {
        "rest_days": days_between(_micros(F.col("last_kickoff")), first),
        "idle_days": days_between(_micros(F.col("_last_played")), first),
        "status_ordinal": F.when(~missing("status"), context["status_ordinal"]),
        "chance": F.when(~missing("chance"), F.col("chance")),
        "appearances": F.coalesce("appearances", F.lit(0)),
        "side_outcome_mean_last5": F.when(homes + aways > 0, total / (homes + aways)),
        **{f"{c}_per90_last5": F.when(F.col("foreign_id").isNotNull(), F.col(f"{c}_per90_last5")) for c in FOREIGN},
        **{n: context[n] for n in ("price", "phase")},
        **pairs,
    }
    forecast = official_forecast(F.col("forecast"), F.col("forecast_state"))
    listed = F.array_sort(F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in [*sources, "_counter_sources", *(["_row_sources"] if "_row_sources" in joined.columns else [])]))))
    instants = F.greatest("captured_at", "announced_at", "_known", "_own_known", "_counter_known") if "announced_at" in joined.columns else F.greatest("captured_at", "_known", "_own_known", "_counter_known")
    columns = [made[f.name] if f.name in made else F.col(f.name) for f in CONTRACT]
    return joined.select(
        *KEY, "cutoff", "captured_at", instants.alias("known_at"), F.lit(VERSION).alias("contract_version"), listed.alias("source_ids"), "outcome_last_appearance", forecast.alias("forecast"), "forecast_state",
        *(c.cast(f.type).alias(f.name) for c, f in zip(columns, CONTRACT)),
    )


def contract_problems(frame: DataFrame, contract: Sequence[Feature] = CONTRACT) -> list[str]:
    """How a frame's last columns differ from the contract in name, order or type. Empty if they conform."""
    have = frame.dtypes[-len(contract) :]
    found = []
    if len(frame.columns) < len(contract):
        found.append(f"{len(frame.columns)} columns instead of {len(contract)}")
    for k, (feature, (name, kind)) in enumerate(zip(contract, have)):
        if name != feature.name:
            found.append(f"column {k + 1} is {name} instead of {feature.name}")
        elif kind != feature.type:
            found.append(f"{name} is {kind} instead of {feature.type}")
    return found


def frame_violations(frame: DataFrame, rows: DataFrame) -> DataFrame:
    """(rule, key): rows without a frame row or with several, instants not before the cutoff, unknown status codes, states that contradict their values, and features that are NULL though never missing."""
    never = [f.name for f in CONTRACT if f.missing == "never"]
    inside = F.array(
        F.when(~F.coalesce(F.col("known_at") < F.col("cutoff"), F.lit(False)), "known after the cutoff"),
        F.when(F.col("known_at") < F.col("captured_at"), "known before the capture"),
        *(F.when(F.col(c).isNull(), f"{c} is missing") for c in never),
    )
    from_frame = frame.select(F.explode(inside).alias("rule"), *KEY)
    states = []
    for c in ("status", "chance", "forecast"):
        value, state = F.col(c), F.col(f"{c}_state")
        states += [F.when(state.isNull() | ~state.isin(*STATES), f"{c} has an unknown state"), F.when(state.isin(*STATES[2:]) & value.isNotNull(), f"{c} must be missing")]
    unknown = context_features(F.lower("status"), F.lit(0), F.lit(1), 2)["unknown_status"]
    from_rows = rows.select(F.explode(F.array(*states, F.when(unknown, "unknown status"))).alias("rule"), *KEY)
    counts = rows.select(*KEY).join(frame.groupBy(*KEY).count(), list(KEY), "left").select(F.when(F.col("count").isNull(), "no frame row").when(F.col("count") > 1, "several frame rows").alias("rule"), *KEY)
    return from_frame.unionByName(from_rows).unionByName(counts).where("rule IS NOT NULL")


__all__ = ["CONTRACT", "NAMES", "RESTS", "Feature", "contract_problems", "entity_history", "entity_part", "feature_frame", "frame_violations", "group_part", "groups_part", "history_violations", "sides", "two_sided"]
