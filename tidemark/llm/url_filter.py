"""Temporal URL filter: which list entries were active when a page was fetched.

Dated entries for a pattern become validity intervals, each ending where the pattern's next entry begins.
A capture is evaluated as of its fetch time against every interval of the patterns that cover its URL: its
host and parent domains, and its path up to each slash. The most specific pattern decides (paths before
hosts, longer before shorter).

Only DataFrame functions are used. Captures are made distinct before they are spread over their possible
patterns, of which there are no more than the widest and deepest listed patterns allow, and only those that
are listed go on. No pattern is one group: windows cover one pattern in one hour of time, and what was in
force before that hour comes from a window over its hours alone. Each distinct time at which a pattern is
asked about is answered once and joined back by equality, where adaptive execution splits hot keys; the
best match is a partial aggregate.

Defined results: hosts are compared in lower case without user, port and final dot; the scheme, query and
fragment don't count, nor does a slash at the end. A null or empty URL matches nothing, and so does a null
fetch time: the decision is ``none`` and the page is kept. Of entries with the same pattern and time, the
greatest action in alphabetical order counts. Entries with a null pattern, time or action are left out. An
entry is active from its very time on. Repeated captures each get their row; empty tables give no rows, or
no matches. Hosts and paths may be of any length. Other columns of the captures stay, and the new ones get
underscores before their names where these are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, written


def host_of(url: Column) -> Column:
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""), r"\.$", ""))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def steps_of(path: Column) -> Column:
    """The non-empty parts of a path."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def domain(host: Column, labels: int) -> Column:
    """The last labels of a host name."""
    return F.substring_index(host, ".", -labels)


def _carried(last: DataFrame) -> DataFrame:
    """(pattern, hour, carried) of (pattern, hour, last): the latest value of the hours before."""
    before = Window.partitionBy("pattern").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("pattern", "hour", F.last("last", ignorenulls=True).over(before).alias("carried"))


def changes(entries: DataFrame) -> DataFrame:
    """(pattern, hour, action, valid_from) of entries (pattern, action, listed_at): where a pattern's action begins. A repeated action only goes on."""
    own = entries.where("pattern IS NOT NULL AND action IS NOT NULL AND listed_at IS NOT NULL").groupBy("pattern", "listed_at").agg(F.max("action").alias("action"))
    own = written(own.withColumn("hour", F.date_trunc("hour", "listed_at")), "list-entries")
    carried = _carried(own.groupBy("pattern", "hour").agg(F.max_by("action", "listed_at").alias("last")))
    within = Window.partitionBy("pattern", "hour").orderBy("listed_at")
    known = own.withColumn("before", F.lag("action").over(within)).join(carried, ["pattern", "hour"]).withColumn("before", F.coalesce("before", "carried"))
    return known.where("before IS NULL OR before != action").select("pattern", "hour", "action", F.col("listed_at").alias("valid_from"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of entries (pattern, action, listed_at); the last interval of a pattern is open (null)."""
    own = changes(entries)
    first = own.groupBy("pattern", "hour").agg(F.min("valid_from").alias("first"))
    following = first.select("pattern", "hour", F.lead("first").over(Window.partitionBy("pattern").orderBy("hour")).alias("following"))
    until = F.coalesce(F.lead("valid_from").over(Window.partitionBy("pattern", "hour").orderBy("valid_from")), "following")
    return own.join(following, ["pattern", "hour"]).select("pattern", "action", "valid_from", until.alias("valid_to"))


def as_of(points: DataFrame, begins: DataFrame) -> DataFrame:
    """(pattern, fetched_at, action, valid_from) of distinct (pattern, fetched_at): the interval of ``changes`` that the time lies in; no row if there is none."""
    entry = F.struct("action", "valid_from")
    asked = points.select("pattern", F.date_trunc("hour", "fetched_at").alias("hour"), F.col("fetched_at").alias("at"), F.lit(None).cast(begins.select(entry.alias("e")).schema["e"].dataType).alias("entry"))
    both = asked.union(begins.select("pattern", "hour", F.col("valid_from").alias("at"), entry.alias("entry")))
    last = both.groupBy("pattern", "hour").agg(F.max(F.when(F.col("entry").isNotNull(), F.struct("at", "entry"))).alias("last"))
    carried = _carried(last.select("pattern", "hour", F.col("last.entry").alias("last")))
    so_far = Window.partitionBy("pattern", "hour").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("own", F.last("entry", ignorenulls=True).over(so_far)).where("entry IS NULL").join(carried, ["pattern", "hour"])
    return found.select("pattern", F.col("at").alias("fetched_at"), F.coalesce("own", "carried").alias("active")).where("active IS NOT NULL").select("pattern", "fetched_at", "active.*")


def candidates(captures: DataFrame, widest: int, deepest: int) -> DataFrame:
    """(url, fetched_at, pattern, rank) of the patterns of at most ``widest`` labels, or ``deepest`` path steps, that would cover a capture."""
    parts = captures.select("url", "fetched_at", host_of(F.col("url")).alias("host"), F.slice(steps_of(path_of(F.col("url"))), 1, max(1, deepest)).alias("parts")).where("host != ''")
    labels = parts.withColumn("labels", F.size(F.split("host", "[.]")))
    hosts = F.transform(F.sequence(F.lit(1), F.least("labels", F.lit(max(1, widest)))), lambda k: F.struct(F.call_function("substring_index", F.col("host"), F.lit("."), -k).alias("pattern"), k.alias("rank")))
    below = F.transform(
        F.filter(F.sequence(F.lit(0), F.least(F.size("parts"), F.lit(deepest))), lambda k: k > 0),
        lambda k: F.struct(F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice("parts", 1, k), "/")).alias("pattern"), (k + (1 << 20)).alias("rank")),
    )
    return labels.select("url", "fetched_at", F.explode(F.concat(hosts, below)).alias("c")).select("url", "fetched_at", "c.pattern", "c.rank")


def evaluated(captures: DataFrame, entries: DataFrame, *, drops: tuple[str, ...] = ("block",)) -> DataFrame:
    """The captures with decision, pattern, valid_from and kept. ``captures`` has url and fetched_at, ``entries`` pattern, action and listed_at."""
    decision, pattern, valid_from, kept, best = free_names(captures.columns, "decision", "pattern", "valid_from", "kept", "best")
    begins = written(changes(entries), "list-changes")
    steps = F.size(F.split("pattern", "/")) - 1
    most = begins.agg(F.max(F.when(steps == 0, F.size(F.split("pattern", "[.]")))).alias("widest"), F.max(steps).alias("deepest")).first()
    asked = captures.select("url", "fetched_at").where("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    listed = candidates(asked, most["widest"] or 0, most["deepest"] or 0).join(begins.select("pattern").distinct(), "pattern", "left_semi")
    wanted = written(listed.select("url", "fetched_at", "pattern", "rank"), "captures-listed")
    known = as_of(wanted.select("pattern", "fetched_at").distinct(), begins)
    found = wanted.join(known, ["pattern", "fetched_at"]).groupBy("url", "fetched_at").agg(F.max(F.struct("rank", "action", "pattern", "valid_from")).alias(best))
    both = captures.join(found, ["url", "fetched_at"], "left")
    said = F.coalesce(F.col(f"{best}.action"), F.lit("none"))
    return both.select(*(F.col(c) for c in captures.columns), said.alias(decision), F.col(f"{best}.pattern").alias(pattern), F.col(f"{best}.valid_from").alias(valid_from), (~said.isin(*drops)).alias(kept))
