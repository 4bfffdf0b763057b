"""Mixing sources to target weights by Poisson replication.

A source's target share of the mixture, over its share of the documents, is the mean number of times each
of its documents should occur (its rate). A document's number comes from inverting the Poisson
distribution of that mean at a uniform value hashed from the seed and its doc_id, so it doesn't depend on
how the data are laid out or on a task being run again. Each document is exploded by its number and the
copies are dealt out by a hash that also orders them: a global shuffle.

All of it is DataFrame functions. The counts of the sources are partial sums before their shuffle; one row
a source is broadcast only if there are at most ``MAX_BROADCAST_SOURCES`` of them, and else joined by
shuffling, where adaptive execution splits a large source.

Defined results: null is a source of its own; a source without a weight, or with a null or negative one,
has weight 0 and goes; a weight without documents doesn't count. A rate may be any number if the mixture is as
large as the input; a ``total`` may ask for any rate. Rows that repeat a doc_id get the same
number. A null doc_id counts as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, written

MAX_BROADCAST_SOURCES = 10_000
#: Up to this rate the terms start at exp(-rate), far from underflow; above it at the first number that matters.
#: It is also the most that a caller's own ``total`` may ask for.
MAX_RATE = 500.0


def uniform(*parts: Column) -> Column:
    """A value in [0, 1) with 52 random bits, from the MD5 of the parts joined by ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered_weights(docs: DataFrame, source: str = "source", power: float = 0.5) -> DataFrame:
    """(source, weight): each source's number of documents to a power; below 1 this lifts the small sources."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, *, source: str = "source", total: float | None = None) -> DataFrame:
    """(source, documents, rate): expected copies of each document for ``total`` rows in all (as many as there are, if None)."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    shares = weights.groupBy(F.col("source").alias("_source")).agg(F.max("weight").cast("double").alias("weight"))
    both = written(
        counts.join(shares, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "documents", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")),
        "source-weights",
    )
    sums = both.agg(F.sum("weight").alias("weight"), F.sum("documents").alias("documents")).first()
    if not sums["weight"]:
        return both.select("source", "documents", F.lit(0.0).alias("rate"))
    wanted = float(sums["documents"] if total is None else total)
    return both.select("source", "documents", (F.col("weight") / float(sums["weight"]) * wanted / F.col("documents")).alias("rate"))


def lowest(rate: Column) -> Column:
    """The first number whose probability counts: below it, at rates above MAX_RATE, lies less than a double can tell from 0."""
    return F.when(rate > MAX_RATE, F.floor(rate - 12 * F.sqrt(rate) - 30)).otherwise(F.lit(0)).cast("int")


def distribution(rate: Column) -> Column:
    """P(X <= k) of the Poisson distribution for k from ``lowest``, as far as a double can tell it from 1. At rates above MAX_RATE the terms are relative to the first one, and divided by their sum at the end."""
    low = lowest(rate)
    terms = F.sequence(low + 1, F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    first = F.when(rate > MAX_RATE, F.lit(1.0)).otherwise(F.exp(-rate))
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), (state["sum"] + p).alias("sum"), F.concat(state["all"], F.array(state["sum"] + p)).alias("all"))

    def finish(state: Column) -> Column:
        return F.when(rate > MAX_RATE, F.transform(state["all"], lambda c: c / state["sum"])).otherwise(state["all"])

    return F.aggregate(terms, start, step, finish)


def mixed(docs: DataFrame, weights: DataFrame, *, source: str = "source", doc_id: str = "doc_id", total: float | None = None, seed: int = 1) -> DataFrame:
    """The columns of ``docs`` and ``copy`` (1, 2, ...) and ``order_key`` (underscores before these if ``docs`` has such columns); partitions are in the order of the key."""
    copy, order_key, u, times, key, low, below = free_names(docs.columns, "copy", "order_key", "u", "times", "mix_source", "low", "below")
    found = rates(docs, weights, source=source, total=total)
    table = found.where("rate > 0").select(F.col("source").alias(key), lowest(F.col("rate")).alias(low), distribution(F.col("rate")).alias(below))
    if found.count() <= MAX_BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    placed = docs.join(table, F.col(source).eqNullSafe(F.col(key))).withColumn(u, uniform(F.lit(str(seed)), name))
    counted = placed.withColumn(times, F.col(low) + F.size(F.filter(below, lambda c: c <= F.col(u)))).where(F.col(times) > 0)
    copies = counted.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy))
    ordered = copies.withColumn(order_key, F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), name, F.col(copy).cast("string"))), 1, 16))
    return ordered.repartition(order_key).sortWithinPartitions(order_key)
