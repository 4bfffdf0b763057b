"""Fact tables of entities in two-sided events: facts, contexts known before a cutoff, one row an entity and period, labels, reconciliation.

Column names: era, period, entity, occurrence_id, kickoff, home, away, side, own_group, counter_group, exposure, outcome.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("era", "period", "entity")
#: At most so much exposure in one occurrence; from so much on it counts as a long one.
LONG = 60


def targets(exposure: Column, outcome: Column) -> dict[str, Column]:
    played = exposure > 0
    return {
        "y_outcome": outcome,
        "y_exposure": exposure,
        "y_played": played.cast("int"),
        "y_long": (exposure >= LONG).cast("int"),
        "y_high5": (outcome >= 5).cast("int"),
        "y_high10": (outcome >= 10).cast("int"),
        "y_outcome_if_played": F.when(played, outcome),
    }


def schedule_violations(schedule: DataFrame) -> DataFrame:
    """(rule, occurrence_id): a group against itself, and occurrences that aren't unique in their era."""
    same = schedule.where(F.col("home").eqNullSafe(F.col("away"))).select(F.lit("same group on both sides").alias("rule"), "occurrence_id")
    twice = schedule.groupBy("era", "occurrence_id").count().where("count > 1").select(F.lit("repeated occurrence").alias("rule"), "occurrence_id")
    return same.unionByName(twice)


def sides(schedule: DataFrame) -> DataFrame:
    """A row for each side of an occurrence, with what belongs to the side swapped over."""
    rest = [c for c in schedule.columns if c not in ("home", "away", "home_difficulty", "away_difficulty")]

    def side(name: str, own: str, other: str) -> Column:
        return F.struct(F.lit(name).alias("side"), F.col(own).alias("own_group"), F.col(other).alias("counter_group"), F.col(f"{own}_difficulty").alias("difficulty"))

    return schedule.select(*rest, F.explode(F.array(side("home", "home", "away"), side("away", "away", "home"))).alias("_s")).select(*rest, "_s.*")


def facts(outcomes: DataFrame, schedule: DataFrame) -> DataFrame:
    """Outcomes (era, occurrence_id, entity, own_group, exposure, outcome) with their occurrence; ``problem`` names what doesn't fit, else NULL."""
    known = schedule.select("era", "occurrence_id", "period", "kickoff", "home", "away")
    joined = outcomes.join(known, ["era", "occurrence_id"], "left")
    own = F.col("own_group")
    side = F.when(own == F.col("home"), "home").when(own == F.col("away"), "away")
    problem = F.when(F.col("kickoff").isNull(), "unknown occurrence").when(own.isNull(), "unknown group").when(side.isNull(), "group not in occurrence")
    return joined.select(*KEY, "occurrence_id", "kickoff", "own_group", F.when(side == "home", F.col("away")).when(side == "away", F.col("home")).alias("counter_group"), side.alias("side"), "exposure", "outcome", problem.alias("problem"))


GROUP = ("era", "period", "own_group", "cutoff")


def announced(snapshots: DataFrame, schedule: DataFrame) -> DataFrame:
    """What is known before each cutoff of a group's occurrences in a period: those announced before the cutoff and starting after it. One set for all snapshots of a group, however many."""
    marks = snapshots.select(*GROUP).distinct()
    return marks.join(sides(schedule), ["era", "period", "own_group"]).where((F.col("available_at") < F.col("cutoff")) & (F.col("kickoff") > F.col("cutoff")))


def _met(known: DataFrame, snapshots: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Each group's occurrences with each of its snapshots, all of one occurrence in a row: what is written holds runs of an occurrence's columns, and a task keeps a group's snapshots, which are narrow.

    The tables are small and their product isn't, so the shuffles have a number of their own: tasks put together by the size of what they read would be few.
    """
    n = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return known.repartition(n, *by).join(snapshots.repartition(n, *by), list(by))


def context(snapshots: DataFrame, schedule: DataFrame) -> DataFrame:
    """A row for each snapshot (era, period, entity, own_group, cutoff, captured_at) and occurrence that its group is known to have.

    ``known_at`` is one instant for all rows of an entity and period: the latest of the capture and the announcements.
    """
    known = announced(snapshots, schedule)
    latest = known.groupBy(*GROUP).agg(F.max("available_at").alias("_latest"))
    rows = snapshots.join(latest, list(GROUP)).withColumn("known_at", F.greatest("captured_at", "_latest")).drop("_latest")
    others = [c for x in (snapshots, known) for c in x.columns if c not in GROUP]
    return _met(known, rows).select(*GROUP, *others, "known_at")


def context_violations(snapshots: DataFrame, schedule: DataFrame) -> DataFrame:
    """(rule, key, occurrence_id) of what a snapshot's group has in its period but can't be known, which ``context`` leaves out: announced too late, begun too early, or captured too late.

    What an occurrence breaks is known from its group's cutoff, and that a snapshot is late from itself; so only what breaks a rule is paired.
    """
    late = F.col("captured_at") >= F.col("cutoff")
    rules = F.array(
        F.when(F.col("available_at") >= F.col("cutoff"), F.struct(F.lit("not announced before the cutoff").alias("rule"), F.lit(False).alias("_late"))),
        F.when(F.col("kickoff") <= F.col("cutoff"), F.struct(F.lit("starts before the cutoff").alias("rule"), F.lit(False).alias("_late"))),
        F.when(F.col("_any_late"), F.struct(F.lit("captured after the cutoff").alias("rule"), F.lit(True).alias("_late"))),
    )
    marks = snapshots.groupBy(*GROUP).agg(F.max(late).alias("_any_late"))
    own = marks.join(sides(schedule), ["era", "period", "own_group"]).select(*GROUP, "occurrence_id", F.explode(rules).alias("_rule")).where("_rule IS NOT NULL").select(*GROUP, "occurrence_id", "_rule.*")
    # every snapshot meets what is wrong with its group's occurrences, a late one all of them once more
    asked = snapshots.select(*GROUP, "entity", F.explode(F.when(late, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_late"))
    return _met(own, asked, [*GROUP, "_late"]).select("rule", *KEY, "occurrence_id")


def period_rows(snapshots: DataFrame, known: DataFrame, *, source: str | None = None, listed: bool = True) -> DataFrame:
    """One row for every snapshot, also without an occurrence: counts, ordered ids, difficulty only where complete, the latest announcement.

    ``known`` is what ``announced`` gives: it is summed up once for each group and cutoff, then joined, so nothing grows with snapshots times
    occurrences. With ``source``, a column of both, ``source_ids`` are the sorted distinct sources of the snapshot and its occurrences.
    A row's ids are all of its group's: where groups are large, ``listed=False`` gives ``n_ids`` and ``n_distinct_ids`` instead of them.
    """
    order = F.struct("kickoff", "occurrence_id")
    complete = F.count("difficulty") == F.count(F.lit(1))
    sources = [F.collect_set(source).alias("_sources")] if source else []
    own = known.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_occurrences"),
        F.sum((F.col("side") == "home").cast("long")).alias("n_home"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["occurrence_id"]).alias("occurrence_ids"),
        F.when(complete, F.avg("difficulty")).alias("difficulty_mean"),
        F.when(complete, F.min("difficulty")).alias("difficulty_min"),
        F.max("available_at").alias("announced_at"),
        *sources,
    )
    counts = ["n_occurrences", "n_home"]
    made = {"is_blank": F.coalesce("n_occurrences", F.lit(0)) == 0}
    if listed:
        made["occurrence_ids"] = F.coalesce("occurrence_ids", F.array().cast(own.schema["occurrence_ids"].dataType))
    else:
        ids = F.col("occurrence_ids")
        own = own.withColumns({"n_ids": F.size(ids).cast("long"), "n_distinct_ids": F.size(F.array_distinct(ids)).cast("long")}).drop("occurrence_ids")
        counts += ["n_ids", "n_distinct_ids"]
    joined = snapshots.join(own, list(GROUP), "left")
    made |= {c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}
    if source:
        mine = F.filter(F.array(F.col(source)), lambda x: x.isNotNull())
        made["source_ids"] = F.array_sort(F.array_union(mine, F.coalesce("_sources", F.array().cast("array<string>"))))
    return joined.withColumns(made).drop("_sources")


def id_numbers(rows: DataFrame) -> tuple[Column, Column]:
    """How many ids a period row has, and how many different ones."""
    if "n_ids" in rows.columns:
        return F.col("n_ids"), F.col("n_distinct_ids")
    return F.size("occurrence_ids"), F.size(F.array_distinct("occurrence_ids"))


def row_violations(rows: DataFrame) -> DataFrame:
    """(rule, key) of period rows (with cutoff, captured_at, known_at, counts, ids or their numbers and, if they are there, all targets) that break an invariant."""
    n_ids, n_distinct = id_numbers(rows)
    made = set(targets(F.lit(0), F.lit(0)))
    present = made & set(rows.columns)
    same = F.col("is_blank").eqNullSafe(F.col("n_occurrences") == 0)
    rules = {
        "captured after the cutoff": ~(F.col("captured_at") < F.col("cutoff")),
        "known after the cutoff": ~(F.col("known_at") < F.col("cutoff")),
        "blank disagrees with the count": ~same,
        "ids disagree with the count": n_ids != F.col("n_occurrences"),
        "repeated ids": n_distinct != n_ids,
    }
    if present == made:
        exposure, outcome = F.col("y_exposure"), F.col("y_outcome")
        rules["negative exposure"] = ~F.coalesce(exposure >= 0, F.lit(False))
        rules |= {f"{name} disagrees": ~F.col(name).eqNullSafe(c.cast(rows.schema[name].dataType)) for name, c in targets(exposure, outcome).items() if name not in ("y_exposure", "y_outcome")}
        rules["blank with an outcome"] = F.col("is_blank") & ((exposure != 0) | (outcome != 0))
    elif present:
        rules["partial targets"] = F.lit(True)
    found = F.array(*(F.when(F.coalesce(c, F.lit(True)), n) for n, c in rules.items()))
    return rows.select(F.explode(found).alias("rule"), *KEY).where("rule IS NOT NULL")


def input_violations(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(rule, key) of period rows whose contexts disagree with them: in number, in home ones, in the cutoff or in one instant of knowledge."""
    own = contexts.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("side") == "home").alias("_home"), F.min("cutoff").alias("_low"), F.max("cutoff").alias("_high"), F.count_distinct("known_at").alias("_anchors"), F.max("known_at").alias("_known")
    )
    both = rows.join(own, list(KEY), "left")
    zero = F.lit(0).cast("long")
    found = F.array(
        F.when(F.col("n_occurrences") != F.coalesce("_n", zero), "other number of contexts"),
        F.when(F.col("n_home") != F.coalesce("_home", zero), "other number of home contexts"),
        F.when((F.col("_low") != F.col("cutoff")) | (F.col("_high") != F.col("cutoff")), "contexts of another cutoff"),
        F.when(F.col("_anchors") > 1, "several instants of knowledge"),
        F.when(F.col("_known") >= F.col("cutoff"), "known after the cutoff"),
    )
    return both.select(F.explode(found).alias("rule"), *KEY).where("rule IS NOT NULL")


def rolled_up(fact_rows: DataFrame) -> DataFrame:
    """Facts summed to entity and period."""
    return fact_rows.groupBy(*KEY).agg(F.sum("outcome").alias("outcome"), F.sum("exposure").alias("exposure"), F.array_sort(F.collect_list("occurrence_id")).alias("fact_ids"))


def labelled(rows: DataFrame, fact_rows: DataFrame) -> DataFrame:
    """Period rows with targets: no facts means zeros, and no outcome-if-played."""
    joined = rows.join(rolled_up(fact_rows), list(KEY), "left")
    zero = F.lit(0).cast("long")
    made = targets(F.coalesce("exposure", zero), F.coalesce("outcome", zero))
    return joined.select(*rows.columns, *(c.alias(n) for n, c in made.items()))


def label_violations(rows: DataFrame, fact_rows: DataFrame) -> DataFrame:
    """(rule, entity, period, occurrence_id): facts without a period row, and facts of occurrences that weren't known."""
    no_row = fact_rows.join(rows.select(*KEY), list(KEY), "left_anti").select(F.lit("fact without a row").alias("rule"), *KEY, "occurrence_id")
    known = rows.select(*KEY, F.explode("occurrence_ids").alias("occurrence_id"))
    unknown = fact_rows.join(rows.select(*KEY), list(KEY), "left_semi").join(known, [*KEY, "occurrence_id"], "left_anti")
    return no_row.unionByName(unknown.select(F.lit("occurrence wasn't known").alias("rule"), *KEY, "occurrence_id"))


def other_ids(fact_rows: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """(key, other_ids): whether a period row that has ids has others than its facts, each as often. ``known`` is what ``announced`` gives; facts meet it id by id, so no row carries its group's ids."""
    own = fact_rows.groupBy(*KEY, "occurrence_id").agg(F.count(F.lit(1)).alias("_f"))
    there = known.groupBy(*GROUP, "occurrence_id").agg(F.count(F.lit(1)).alias("_c"))
    met = own.join(rows.select(*KEY, "own_group", "cutoff").distinct(), list(KEY)).join(there, [*GROUP, "occurrence_id"], "left")
    matched = met.groupBy(*KEY, "own_group", "cutoff").agg(F.count(F.lit(1)).alias("_facts"), F.count_if(F.col("_c") == F.col("_f")).alias("_same"))
    same = (F.col("_same") == F.col("n_distinct_ids")) & (F.col("_facts") == F.col("n_distinct_ids"))
    both = rows.join(matched, [*KEY, "own_group", "cutoff"], "left")
    return both.groupBy(*KEY).agg(F.max((F.col("n_ids") > 0) & ~F.coalesce(same, F.lit(False))).alias("other_ids"))


def reconciled(fact_rows: DataFrame, labelled_rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row: how many rows and keys there are, how the totals compare, and how many keys differ.

    Each input is summed up once by its key; repeated facts are those that a key's ids hold more than once. Rows with the numbers of
    their ids instead of the ids (``listed=False``) need ``known``, what ``announced`` gives.
    """
    zero = F.lit(0).cast("long")
    up = rolled_up(fact_rows).select(*KEY, F.col("outcome").alias("f_outcome"), F.col("exposure").alias("f_exposure"), "fact_ids")
    n_ids, n_distinct = id_numbers(labelled_rows)
    ids = [F.first(F.array_sort("occurrence_ids")).alias("row_ids")] if known is None else []
    rows = labelled_rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("y_outcome").alias("y_outcome"),
        F.sum("y_exposure").alias("y_exposure"),
        F.count_if("is_blank").alias("n_blank"),
        F.count_if(F.col("n_occurrences") > 1).alias("n_multi"),
        F.count_if(n_distinct < n_ids).alias("n_listed"),
        *ids,
    )
    other = (F.size("row_ids") > 0) & ~F.col("row_ids").eqNullSafe(F.col("fact_ids"))
    if known is not None:
        rows, other = rows.join(other_ids(fact_rows, labelled_rows, known), list(KEY), "left"), F.col("other_ids")
    both = up.join(rows, list(KEY), "full_outer")
    repeated = F.size(F.filter(F.array_distinct("fact_ids"), lambda x: F.size(F.filter("fact_ids", lambda y: y == x)) > 1))

    def number(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    return both.agg(
        number(F.col("fact_ids").isNotNull()).alias("fact_keys"),
        number(F.col("n_rows").isNotNull()).alias("row_keys"),
        number(F.col("n_rows").isNull()).alias("facts_without_row"),
        F.sum(F.coalesce("n_blank", zero)).alias("blanks"),
        F.sum(F.coalesce("n_multi", zero)).alias("multis"),
        F.sum(F.coalesce("f_outcome", zero)).alias("fact_outcome"),
        F.sum(F.coalesce("y_outcome", zero)).alias("row_outcome"),
        F.sum(F.coalesce("f_exposure", zero)).alias("fact_exposure"),
        F.sum(F.coalesce("y_exposure", zero)).alias("row_exposure"),
        number(F.coalesce("f_outcome", zero) != F.coalesce("y_outcome", zero)).alias("keys_with_other_outcome"),
        number(other).alias("keys_with_other_ids"),
        F.sum(F.when(F.col("fact_ids").isNotNull(), repeated).otherwise(0).cast("long")).alias("repeated_facts"),
        number(F.col("n_rows") > 1).alias("repeated_rows"),
        F.sum(F.coalesce("n_listed", zero)).alias("rows_with_repeated_ids"),
    )


def anchor_violations(contexts: DataFrame, key: Sequence[str], anchors: Sequence[str]) -> DataFrame:
    """Keys with several rows in which an anchor has more than one value (NULL is a value)."""
    several = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c) for c in anchors]
    counts = contexts.groupBy(*key).agg(*several)
    bad = reduce(lambda a, b: a | b, (F.col(c) > 1 for c in anchors))
    return counts.where(bad).select(*key, F.concat_ws(",", *(F.when(F.col(c) > 1, F.lit(c)) for c in anchors)).alias("anchors"))
