"""Identities that change over time: versions over closed intervals of periods, and look-ups as of a period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import plain_name

OPEN = 2**31 - 1
#: Names whose candidates are texts are dealt to so many tasks at least, so that a file holds few of these texts.
NAME_TASKS = 128


def versions(observed: DataFrame, key: Sequence[str], period: str, attribute: str) -> DataFrame:
    """(key, attribute, valid_from, valid_to): a new version where the attribute differs from the observation before; the last is open (NULL)."""
    order = Window.partitionBy(*key).orderBy(period)
    before = observed.withColumns({"_before": F.lag(attribute).over(order), "_first": F.row_number().over(order) == 1})
    changes = before.where(F.col("_first") | ~F.col(attribute).eqNullSafe(F.col("_before")))
    return changes.select(*key, attribute, F.col(period).alias("valid_from"), (F.lead(period).over(order) - 1).alias("valid_to"))


def change_log(changes: DataFrame, key: Sequence[str], period: str, attribute: str) -> DataFrame:
    """Versions of an attribute from a feed of audited changes. A change to the value already held is no change; several in a period count as the last by ``sequence``."""
    last = changes.groupBy(*key, period).agg(F.max_by(attribute, "sequence").alias(attribute))
    return versions(last, key, period, attribute)


def conflicts(observed: DataFrame, key: str, others: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Ids that belong to several keys within a scope: (id_column, scope, id, n_keys)."""
    found = None
    for other in others:
        own = observed.where(F.col(other).isNotNull()).groupBy(*within, other).agg(F.countDistinct(key).alias("n_keys")).where("n_keys > 1")
        rows = own.select(F.lit(other).alias("id_column"), F.concat_ws("|", *within).alias("scope"), F.col(other).cast("string").alias("id"), "n_keys")
        found = rows if found is None else found.unionByName(rows)
    return found


def backfilled(observed: DataFrame, known: DataFrame, key: Sequence[str], period: str) -> DataFrame:
    """Observations before their key's first known period."""
    first = known.groupBy(*key).agg(F.min("valid_from").alias("first_period"))
    return observed.join(first, list(key)).where(F.col(period) < F.col("first_period"))


def as_of(rows: DataFrame, intervals: DataFrame, key: Sequence[str], period: str, wanted: Sequence[str]) -> DataFrame:
    """``rows`` with the wanted columns of the interval that covers their period, and ``matches``: how many did. More or less than one is an error for the caller.

    Each distinct key and period is looked up once, by an equi-join with the range as a condition (a key's versions are
    few), and joined back; so rows that repeat each stay, and only keys are shuffled for the look-up.
    """
    asked = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col(period).alias("_at")).distinct()
    spans = intervals.select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(key)), F.col("valid_from").alias("_from"), F.coalesce("valid_to", F.lit(OPEN)).alias("_to"), *(F.col(c).alias(f"_w{i}") for i, c in enumerate(wanted)))
    cover = (F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to"))
    met = asked.join(spans, [*(F.col(f"_k{i}").eqNullSafe(F.col(f"_s{i}")) for i in range(len(key))), cover])
    names = [*(f"_k{i}" for i in range(len(key))), "_at"]
    found = met.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), *(F.max(f"_w{i}").alias(f"_w{i}") for i in range(len(wanted))))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*key, period], names)]
    return rows.join(found, same, "left").select(*(F.col(c) for c in rows.columns), *(F.when(F.col("_n") == 1, F.col(f"_w{i}")).alias(c) for i, c in enumerate(wanted)), F.coalesce("_n", F.lit(0)).cast("long").alias("matches"))


def by_code(rows: DataFrame, registry: DataFrame, code: str, entity: str) -> DataFrame:
    """``rows`` with the entity of their code, and ``matches``: how many entities have it. NULL unless it is one."""
    known = registry.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("_code")).agg(F.count_distinct(entity).alias("_n"), F.min(entity).alias("_entity"))
    joined = rows.join(known, F.col(code) == F.col("_code"), "left")
    return joined.select(*(F.col(c) for c in rows.columns), F.when(F.col("_n") == 1, F.col("_entity")).alias(entity), F.coalesce("_n", F.lit(0)).cast("long").alias("matches"))


def resolved(rows: DataFrame, aliases: DataFrame, *, alias: str, supplied: str, period: str, entity: str) -> DataFrame:
    """``rows`` with the entity that they supply, or that their alias has in their period, and ``problem``: NULL if one of them is known and they agree."""
    found = as_of(rows, aliases.withColumnRenamed(entity, "_alias_entity"), [alias], period, ["_alias_entity"])
    by_alias = F.when(F.col(alias).isNotNull(), F.col("_alias_entity"))
    problem = (
        F.when(F.col(alias).isNull() & F.col(supplied).isNull(), "no identity")
        .when(F.col(alias).isNotNull() & (F.col("matches") != 1), "alias not known then")
        .when(F.col(alias).isNotNull() & (F.col(supplied) != by_alias), "alias of another entity")
    )
    return found.withColumn("problem", problem).select(*rows.columns, "problem", F.when(F.col("problem").isNull(), F.coalesce(supplied, by_alias)).alias(entity))


def match_proposals(left: DataFrame, right: DataFrame, *, left_id: str, left_name: str, right_id: str, right_name: str, separator: str | None = None) -> DataFrame:
    """(left_id, candidates, status): unmatched, candidate or ambiguous by normalised name. Nothing is accepted here.

    With a separator the candidates are one text of their ids, which is made once for each name and not for each row. A name's
    rows then lie in one task with few others: a file's dictionary holds each text once, where rows in the order of ``left`` would write it for each.
    """
    names = right.groupBy(plain_name(F.col(right_name)).alias("_name")).agg(F.array_sort(F.collect_set(right_id)).alias("_found")).withColumn("_n", F.size("_found"))
    if separator is not None:
        names = names.withColumn("_found", F.array_join(F.col("_found").cast("array<string>"), separator))
    rows = left.select(left_id, plain_name(F.col(left_name)).alias("_name"))
    if separator is not None:
        n = max(NAME_TASKS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(n, "_name")
    joined = rows.join(names, "_name", "left")
    none = F.array().cast(names.schema["_found"].dataType) if separator is None else F.lit("")
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 0, "unmatched").when(n == 1, "candidate").otherwise("ambiguous")
    return joined.select(left_id, F.coalesce("_found", none).alias("candidates"), status.alias("status"))


def registry_violations(registry: DataFrame, key: Sequence[str], *, foreign_id: str, audited: Sequence[str] = ("manual", "audited")) -> DataFrame:
    """(rule, key) of versions (method, confidence, note, a foreign id) that break a rule: inverted intervals, audited matches without a note, and unresolved ones that aren't so in all three."""
    unresolved = F.col("method") == "unresolved"
    rules = F.array(
        F.when(F.col("valid_to") < F.col("valid_from"), "inverted interval"),
        F.when(F.col("method").isin(*audited) & (F.coalesce("note", F.lit("")) == ""), "no audit note"),
        F.when(unresolved != (F.col("confidence") == "unresolved"), "method and confidence disagree"),
        F.when(unresolved != F.col(foreign_id).isNull(), "unresolved and the id disagree"),
    )
    return registry.select(F.explode(rules).alias("rule"), *key, "valid_from").where("rule IS NOT NULL")


def registry_dump(registry: DataFrame, era: str, key: str) -> DataFrame:
    return registry.orderBy(era, key, "valid_from")
