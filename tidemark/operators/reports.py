"""Reports as one nested document a row, put together from long tables in one plan.

The tables are results: a row a fold and model, a head and fold. Their maps have as many entries, whatever the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by_key(entries: Column) -> Column:
    """A map of the entries (k, v), in order of the key."""
    order = F.array_sort(entries, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return F.map_from_entries(order)


def mapped(table: DataFrame, key: str, value: str) -> DataFrame:
    """One row: {key: value}."""
    return table.agg(_by_key(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v")))).alias(value))


def nested(table: DataFrame, outer: str, inner: str, values: Sequence[str], digits: int = 4) -> DataFrame:
    """One row: {outer: {inner: {value: text}}}; numbers are written with so many digits, NULL stays null. A repeated pair of keys is an error."""
    one = F.struct(*(F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c) if c in values else F.col(c) for c in sorted(values)))
    shown = F.struct(*(F.when(F.col(c).isNotNull(), one[c]).alias(c) for c in sorted(values)))
    inside = table.groupBy(F.col(outer).cast("string").alias("k")).agg(_by_key(F.collect_list(F.struct(F.col(inner).cast("string").alias("k"), shown.alias("v")))).alias("v"))
    return inside.agg(_by_key(F.collect_list(F.struct("k", "v"))).alias(outer))


def document(name: str, parts: Mapping[str, DataFrame]) -> DataFrame:
    """(report, document): the parts, each one row of one column, as JSON in order of their names."""
    out = None
    for part in sorted(parts):
        own = parts[part].select(F.col(parts[part].columns[0]).alias(part))
        out = own if out is None else out.join(own)  # one row each
    return out.select(F.lit(name).alias("report"), F.to_json(F.struct(*sorted(parts)), {"ignoreNullFields": "false"}).alias("document"))
