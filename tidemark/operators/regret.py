"""Hindsight back-test of decisions: substitutions, leads, the best line-up after the fact, regret by policy."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import RANGES, best_line_up, decided


def _legal(d: Column, m: Column, f: Column) -> Column:
    """A keeper is in place, so the outfield counts alone decide."""
    return d.between(*RANGES["D"]) & m.between(*RANGES["M"]) & f.between(*RANGES["F"])


def _is(position: Column, name: str) -> Column:
    return (position == name).cast("int")


def substituted(decisions: DataFrame, by: Sequence[str], order: str = "reserve_order") -> DataFrame:
    """(by, points): starters who played, with the reserve keeper for an absent one, and outfield reserves in turn.

    Each reserve who played takes the place of the first absent starter (by key) whose replacement keeps the formation
    legal; the counts change after each. The state runs through ``aggregate`` over one portfolio's few reserves.
    """
    played, keeper = F.col("actual_exposure") > 0, F.col("position") == "G"
    who = F.struct(F.col("entity").alias("entity"), F.col("position").alias("position"))
    own = decisions.groupBy(*by).agg(
        F.sum(F.when(F.col("starter") & played, F.col("actual")).otherwise(0.0)).alias("base"),
        F.max(F.when(F.col("starter") & keeper, ~played)).alias("keeper_absent"),
        F.sum(F.when(~F.col("starter") & keeper & played, F.col("actual")).otherwise(0.0)).alias("keeper_points"),
        F.array_sort(F.collect_list(F.when(F.col("starter") & ~keeper & ~played, who))).alias("absent"),
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("starter") & ~keeper & played, F.struct(F.col(order).alias("o"), F.col("position").alias("position"), F.col("actual").alias("actual"))))), lambda x: F.struct(x["position"].alias("position"), x["actual"].alias("actual"))
        ).alias("reserves"),
        *(F.count_if(F.col("starter") & (F.col("position") == p)).cast("int").alias(p) for p in "DMF"),
    )
    state = F.struct(F.col("absent").alias("absent"), F.col("D").alias("D"), F.col("M").alias("M"), F.col("F").alias("F"), F.lit(0.0).alias("points"))

    def step(s: Column, reserve: Column) -> Column:
        fits = F.filter(
            s["absent"], lambda a: _legal(*(s[p] - _is(a["position"], p) + _is(reserve["position"], p) for p in "DMF"))
        )
        first = F.get(fits, F.lit(0))
        made = F.struct(
            F.filter(s["absent"], lambda a: ~(a["entity"] == first["entity"])).alias("absent"),
            *((s[p] - _is(first["position"], p) + _is(reserve["position"], p)).alias(p) for p in "DMF"),
            (s["points"] + reserve["actual"]).alias("points"),
        )
        return F.when(F.size(fits) > 0, made).otherwise(s)

    swapped = F.aggregate("reserves", state, step, lambda s: s["points"])
    return own.select(*by, (F.col("base") + F.when(F.col("keeper_absent"), F.col("keeper_points")).otherwise(0.0) + swapped).alias("points"))


def best_reserve_order(decisions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, best_points): the most that any order of the three outfield reserves would have given."""
    orders = list(permutations((1, 2, 3)))
    option = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.array(*(F.lit(x) for x in o)).alias("o")) for k, o in enumerate(orders))))
    tried = decisions.select("*", option.alias("_p")).withColumn("_order", F.when(F.col("reserve_order") <= 3, F.get(F.col("_p.o"), F.col("reserve_order") - 1)).otherwise(F.col("reserve_order"))).withColumn("_k", F.col("_p.k"))
    return substituted(tried, [*by, "_k"], "_order").groupBy(*by).agg(F.max("points").alias("best_points"))


def lead_points(decisions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, lead_bonus, best_lead_bonus, deputy_needed, deputy_covered): the lead's points once more, the deputy's if the lead didn't play."""
    played = F.col("actual_exposure") > 0
    own = decisions.groupBy(*by).agg(
        F.max(F.when(F.col("lead") & played, F.col("actual"))).alias("_lead"),
        F.max(F.when(F.col("deputy") & played, F.col("actual"))).alias("_deputy"),
        F.max(F.when(F.col("starter") & played, F.col("actual"))).alias("_best"),
    )
    zero = F.lit(0.0)
    return own.select(
        *by,
        F.coalesce("_lead", "_deputy", zero).alias("lead_bonus"),
        F.coalesce("_best", zero).alias("best_lead_bonus"),
        F.col("_lead").isNull().alias("deputy_needed"),
        (F.col("_lead").isNull() & F.col("_deputy").isNotNull()).alias("deputy_covered"),
    )


def backtest(frame: DataFrame, by: Sequence[str], policies: dict[str, str]) -> DataFrame:
    """Per portfolio and policy (name: score column): points, hindsight best, regret of line-up, reserves and lead. All policies and portfolios in one plan."""
    keep = [*by, "entity", "position", "club", "p_played", "p_long", "exposure", "actual", "actual_exposure"]
    scores = frame.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), F.col(c).cast("double").alias("score")) for n, c in policies.items()))).alias("_s")).select(*keep, "_s.policy", "_s.score")
    group = [*by, "policy"]
    decisions = decided(scores, group)
    actual = best_line_up(frame.select(*keep), by, "actual").select(*by, F.col("line_up_score").alias("hindsight_points"))
    line_up = decisions.groupBy(*group).agg(F.sum(F.when(F.col("starter"), F.col("actual")).otherwise(0.0)).alias("line_up_points"))
    out = line_up.join(substituted(decisions, group), group).join(best_reserve_order(decisions, group), group).join(lead_points(decisions, group), group).join(actual, list(by))
    return out.select(
        *group, "line_up_points", "points", "best_points", "lead_bonus", "best_lead_bonus", "hindsight_points", "deputy_needed", "deputy_covered",
        (F.col("hindsight_points") - F.col("line_up_points")).alias("line_up_regret"),
        (F.col("best_points") - F.col("points")).alias("reserve_regret"),
        (F.col("best_lead_bonus") - F.col("lead_bonus")).alias("lead_regret"),
    )


def policy_summary(results: DataFrame) -> DataFrame:
    """Means by policy; how often the deputy covered when needed."""
    return results.groupBy("policy").agg(
        F.count(F.lit(1)).alias("decisions"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("points", "lead_bonus", "line_up_regret", "reserve_regret", "lead_regret")),
        F.avg(F.when(F.col("deputy_needed"), F.col("deputy_covered").cast("double"))).alias("deputy_coverage"),
    )


def paired_with_champion(results: DataFrame, by: Sequence[str], champion: str) -> DataFrame:
    """Per other policy and measure: the champion's mean less the policy's over the same portfolios."""
    measures = ("points", "line_up_regret", "reserve_regret", "lead_regret")
    own = results.where(F.col("policy") == champion).select(*by, *(F.col(c).alias(f"_{c}") for c in measures))
    joined = results.where(F.col("policy") != champion).join(own, list(by))
    gaps = joined.select("policy", *((F.col(f"_{c}") - F.col(c)).alias(c) for c in measures)).unpivot(["policy"], list(measures), "measure", "delta")
    return gaps.groupBy("policy", "measure").agg(F.count(F.lit(1)).alias("pairs"), F.avg("delta").alias("mean_delta"))
