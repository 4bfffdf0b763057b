"""Table contracts. Every check returns the rows that break it, as (rule, key, detail); no rows means it holds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite, state_violation

KINDS = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "instant": "timestamp", "strings": "array<string>"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = False
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    """A table's columns, primary key and row rules (name and the condition that a row breaks it)."""

    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    rules: tuple[tuple[str, Callable[[], Column]], ...] = ()
    extra_allowed: bool = False


def _key(names: Sequence[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names))


def broken(df: DataFrame, rule: str, condition: Column, key: Sequence[str], detail: Column | None = None) -> DataFrame:
    """The rows where the condition is true."""
    return df.where(F.coalesce(condition, F.lit(False))).select(F.lit(rule).alias("rule"), _key(key).alias("key"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit("null"))).alias("detail"))


def union(found: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def column_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Missing columns, and extra ones where the contract has none. Needs the schema alone."""
    have, want = set(df.columns), {f.name for f in contract.fields}
    rows = [("missing column", contract.name, c) for c in sorted(want - have)]
    rows += [] if contract.extra_allowed else [("extra column", contract.name, c) for c in sorted(have - want)]
    return df.sparkSession.createDataFrame(rows, "rule string, key string, detail string")


def field_problem(field: Field) -> Column:
    """What is wrong with a field's value, or NULL."""
    value = F.col(field.name)
    problem = F.when(value.isNull(), F.lit(None if field.nullable else "is null"))
    if field.kind == "number":
        problem = problem.when(~is_finite(value.cast("double")), "isn't finite")
    if field.choices:
        problem = problem.when(~value.isin(*field.choices), "isn't a choice")
    return problem


def field_violations(df: DataFrame, fields: Sequence[Field], key: Sequence[str]) -> DataFrame:
    """Nulls, non-finite numbers and unknown choices, all fields in one pass over the table."""
    found = F.filter(F.array(*(F.struct(F.lit(f.name).alias("field"), field_problem(f).alias("problem")) for f in fields)), lambda x: x["problem"].isNotNull())
    return df.select(_key(key).alias("key"), F.explode(found).alias("x")).select(F.lit("field").alias("rule"), "key", F.concat_ws(" ", "x.field", "x.problem").alias("detail"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and keys with a null."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in key))
    return counts.where((F.col("n") > 1) | null).select(F.when(null, "null key").otherwise("duplicate key").alias("rule"), _key(key).alias("key"), F.col("n").cast("string").alias("detail"))


def negative_values(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    return union([broken(df, f"negative {c}", F.col(c) < 0, key, F.col(c)) for c in columns])


def not_before(df: DataFrame, early: str, late: str, key: Sequence[str]) -> DataFrame:
    """Rows whose first instant isn't strictly before the second: equality is late."""
    return broken(df, f"{early} not before {late}", F.col(early) >= F.col(late), key, F.col(early))


def outside(df: DataFrame, column: str, low: float, high: float, key: Sequence[str]) -> DataFrame:
    return broken(df, f"{column} outside", F.col(column).isNotNull() & (~is_finite(F.col(column).cast("double")) | ~F.col(column).between(low, high)), key, F.col(column))


def state_violations(df: DataFrame, value: str, state: str, key: Sequence[str]) -> DataFrame:
    problem = state_violation(F.col(value), F.col(state))
    return broken(df, f"state of {value}", problem.isNotNull(), key, problem)


def overlapping_intervals(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Neighbouring closed intervals of a group that overlap; an open end before another interval overlaps it."""
    order = Window.partitionBy(*by).orderBy(F.col(start), F.col(end).asc_nulls_last())
    after = df.where(" AND ".join(f"{c} IS NOT NULL" for c in by)).withColumn("_next", F.lead(start).over(order))
    clash = F.col("_next").isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col("_next")))
    return broken(after, "overlapping intervals", clash, [*by, start], F.col("_next"))


def not_one_to_one(df: DataFrame, left: str, right: str) -> DataFrame:
    """Values of either column that go with more than one of the other."""

    def several(a: str, b: str) -> DataFrame:
        return df.where(F.col(a).isNotNull()).groupBy(a).agg(F.countDistinct(b).alias("n")).where("n > 1").select(F.lit(f"{a} with several {b}").alias("rule"), F.col(a).cast("string").alias("key"), F.col("n").cast("string").alias("detail"))

    return several(left, right).unionByName(several(right, left))


def first_present(*aliases: str) -> Column:
    return F.coalesce(*(F.col(c) for c in aliases))


def disagreeing_aliases(df: DataFrame, aliases: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Rows where the aliases of one field that are present differ."""
    first = first_present(*aliases)
    differ = reduce(lambda a, b: a | b, (F.col(c).isNotNull() & (F.col(c) != first) for c in aliases))
    return broken(df, "aliases disagree", differ, key, F.concat_ws("/", *(F.col(c).cast("string") for c in aliases)))


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """All checks of a contract. Rows are only looked at if no column is missing."""
    found = [column_violations(df, contract)]
    if {f.name for f in contract.fields} <= set(df.columns):
        found += [field_violations(df, contract.fields, contract.key), duplicate_keys(df, contract.key)]
        found += [broken(df, rule, condition(), contract.key) for rule, condition in contract.rules]
    return union(found)


def conformed(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns, in its order, with its types."""
    return df.select(*(F.col(f.name).cast(KINDS[f.kind]).alias(f.name) for f in contract.fields))


def conforms(df: DataFrame, contract: Contract) -> bool:
    """Names, order and types are the contract's."""
    return [(n, t) for n, t in df.dtypes] == [(f.name, KINDS[f.kind]) for f in contract.fields]
