"""The whole build of labelled period rows, closed on failure: a stage's violations stop all after it.

Inputs: outcomes (era, occurrence_id, alias, exposure, outcome, and any redundant fields), a schedule (see ``facts``), snapshots
(era, period, entity, own_group, cutoff, captured_at) and a registry of identities (era, alias, entity, own_group, valid_from, valid_to).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import facts

#: Fields that an outcome row may repeat; each has to agree with what schedule and registry say.
REDUNDANT = ("entity", "period", "kickoff", "own_group", "counter_group", "side")
FOREVER = 2_147_483_647


def resolved_facts(outcomes: DataFrame, schedule: DataFrame, registry: DataFrame) -> DataFrame:
    """A fact for each outcome, with the identity that its alias has in the occurrence's period and that version's group. ``problem`` names the first thing that doesn't fit, else NULL.

    The registry's versions meet outcomes by an equi-join on era and alias; one alias has few of them.
    """
    known = schedule.select("era", "occurrence_id", *(F.col(c).alias(f"s_{c}") for c in ("period", "kickoff", "home", "away")))
    versions = registry.select("era", "alias", *(F.col(c).alias(f"v_{c}") for c in ("entity", "own_group", "valid_from", "valid_to")))
    rows = outcomes.withColumn("_row", F.monotonically_increasing_id()).join(known, ["era", "occurrence_id"], "left").join(versions, ["era", "alias"], "left")
    then = F.col("v_entity").isNotNull() & (F.col("v_valid_from") <= F.col("s_period")) & (F.col("s_period") <= F.coalesce("v_valid_to", F.lit(FOREVER)))
    kept = [c for c in outcomes.columns if c not in ("era", "occurrence_id", "alias")]
    one = rows.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in ("era", "occurrence_id", "alias", "s_period", "s_kickoff", "s_home", "s_away", *kept)),
        F.count_if(then).alias("_n"), *(F.max(F.when(then, F.col(f"v_{c}"))).alias(f"v_{c}") for c in ("entity", "own_group")),
    )
    own = F.col("v_own_group")
    side = F.when(own == F.col("s_home"), "home").when(own == F.col("s_away"), "away")
    said = {"entity": F.col("v_entity"), "period": F.col("s_period"), "kickoff": F.col("s_kickoff"), "own_group": own, "counter_group": F.when(side == "home", F.col("s_away")).when(side == "away", F.col("s_home")), "side": side}
    problem = F.when(F.col("s_kickoff").isNull(), "unknown occurrence").when(F.col("_n") == 0, "no identity then").when(F.col("_n") > 1, "several identities then").when(side.isNull(), "group not in occurrence")
    for c in REDUNDANT:
        if c in kept:
            problem = problem.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(said[c]), f"{c} disagrees")
    return one.select("era", "occurrence_id", "alias", *(x.alias(c) for c, x in said.items()), "exposure", "outcome", problem.alias("problem"))


def snapshot_violations(snapshots: DataFrame) -> DataFrame:
    """(rule, key): captured too late, or a key that comes twice."""
    late = snapshots.where(~F.coalesce(F.col("captured_at") < F.col("cutoff"), F.lit(False))).select(F.lit("captured after the cutoff").alias("rule"), *facts.KEY)
    twice = snapshots.groupBy(*facts.KEY).count().where("count > 1").select(F.lit("repeated snapshot").alias("rule"), *facts.KEY)
    return late.unionByName(twice)


@dataclass(frozen=True)
class Built:
    """``rows`` if every stage held, else None; ``violations`` (stage, rule, subject) of the stage that didn't, else None."""

    rows: DataFrame | None
    facts: DataFrame | None
    report: DataFrame | None
    stopped_at: str | None
    violations: DataFrame | None


def _subjects(found: DataFrame, stage: str) -> DataFrame:
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in found.columns if c != "rule"))
    return found.select(F.lit(stage).alias("stage"), "rule", text.alias("subject"))


def reconciliation_violations(report: DataFrame) -> DataFrame:
    """(rule, count) of the counts of a reconciliation that have to be 0, and totals that have to agree."""
    zero = ("facts_without_row", "keys_with_other_outcome", "keys_with_other_ids", "repeated_facts", "repeated_rows", "rows_with_repeated_ids")
    pairs: list[tuple[str, Column]] = [(c, F.col(c)) for c in zero] + [(f"other {c}", F.col(f"fact_{c}") - F.col(f"row_{c}")) for c in ("outcome", "exposure")]
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), v.cast("long").alias("count")) for n, v in pairs))
    return report.select(F.explode(rows).alias("x")).select("x.*").where("count <> 0")


def build(outcomes: DataFrame, schedule: DataFrame, snapshots: DataFrame, registry: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> Built:
    """Schedule, snapshots, contexts, period rows, facts, labels, reconciliation, each checked before the next is made.

    ``keep(table, name)`` writes what several stages read (snapshots, facts and period rows) and gives it back. Asking whether a stage has
    violations is a job that ends with the first row found; nothing is collected.
    """
    made: dict[str, DataFrame] = {}
    snapshots = keep(snapshots, "snapshots")

    def rows_checked() -> DataFrame:
        made["rows"] = keep(facts.period_rows(snapshots, facts.announced(snapshots, schedule)), "period-rows")
        return facts.row_violations(made["rows"].withColumn("known_at", F.greatest("captured_at", "announced_at")))

    def facts_checked() -> DataFrame:
        found = keep(resolved_facts(outcomes, schedule, registry), "facts")
        made["facts"] = found.drop("problem")
        return found.where("problem IS NOT NULL").select(F.col("problem").alias("rule"), "era", "occurrence_id", "alias")

    def labels_checked() -> DataFrame:
        made["labelled"] = facts.labelled(made["rows"], made["facts"])
        return facts.label_violations(made["rows"], made["facts"])

    def totals_checked() -> DataFrame:
        made["report"] = keep(facts.reconciled(made["facts"], made["labelled"]), "report")
        return reconciliation_violations(made["report"])

    stages: list[tuple[str, Callable[[], DataFrame]]] = [
        ("schedule", lambda: facts.schedule_violations(schedule)),
        ("snapshots", lambda: snapshot_violations(snapshots)),
        ("contexts", lambda: facts.context_violations(snapshots, schedule)),
        ("period rows", rows_checked),
        ("facts", facts_checked),
        ("labels", labels_checked),
        ("reconciliation", totals_checked),
    ]
    for name, check in stages:
        found = check()
        if not found.isEmpty():
            return Built(None, made.get("facts"), made.get("report"), name, _subjects(found, name))
    return Built(made["labelled"], made["facts"], made["report"], None, None)


def outcome_columns(frame: DataFrame, targets: list[str] | None = None) -> list[str]:
    """Columns of a frame that carry an outcome of its own period, by name: ``y_*``, and raw ones, which may not be features."""
    raw = {"outcome", "exposure", "actual", "actual_outcome", "actual_exposure", "scored", "conceded", "fact_ids"} | set(targets or [])
    return [c for c in frame.columns if c.lower().startswith("y_") or c.lower() in raw]

