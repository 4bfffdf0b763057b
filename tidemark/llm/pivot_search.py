"""Exact top-k search by inner product through a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it, and lie sorted by that key in annuli of bounded size. For the
inner product to follow a distance, each vector x gets one more component, sqrt(M - |x|^2) with M the largest squared norm, and a query q
gets a zero there: then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the largest products are the nearest vectors. By the triangle
inequality a vector at distance r from a pivot is no nearer to q than | |q' - pivot| - r |, so an annulus bounds the products
of all its vectors.

A query starts in the annulus it lies in itself, goes on to the few with the best bounds, and then visits every other annulus whose bound is
not below its k-th product so far. Equal bounds are visited, so ties are decided by the id alone. The answer is exact (recall 1): products
are those of whole numbers, without rounding (below 2^53 in floating point, which is checked, else in whole numbers of 64 bits; products
have to fit these). Work is queries times the annuli that the bounds leave, dealt by annulus and by lots of queries.

Components become floor(256 x). Vectors that are null or hold a null or non-finite component take no part, nor do rows without vec_id. An
empty vector is one (its products are 0). Only vectors of equal length meet. A row is no candidate for itself; other rows of the same
vec_id are. Each row of a repeated query is answered. No rows: no answers. Other columns are not read.

Equal vectors, however many, are one entry of the index with the k + 1 smallest of their ids (as often as these repeat): no other of them
can be among the k best of any query, its own row left out. A third of all rows being one vector so makes no hot annulus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
#: Pivots a length of vectors, and the size of the sample of all vectors that they are fitted on.
PIVOTS, SAMPLE, ROUNDS = 64, 4096, 4
#: Vectors in an annulus (more only so that there are no more than MOST_ANNULI by this count).
ANNULUS, MOST_ANNULI = 1024, 1 << 16
#: Annuli that a query visits in the second round.
NEXT = 8
#: Queries that one task compares with one annulus.
LOT = 1 << 15
#: Bounds are floating-point; they are taken this much (relatively, and absolutely) higher.
SLACK = 1e-6

_KEYED = "ids array<long>, asked boolean, size int, pivot int, distance double, vector binary"
_ENTRY = "row long, size int, annulus long, kind int, least long, ids array<long>, vector binary"
_FOUND = "row long, entry long, vec_id long, score long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_LEAST = np.iinfo(np.int64).min


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers (as doubles) from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), width)


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, size, vector) of the vectors that take part, as whole numbers in doubles."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(finite).select("vec_id", F.size("x").alias("size"), F.transform("x", lambda v: F.floor(v * SCALE).cast("double")).alias("vector"))


def entries(rows: DataFrame, every: int, k: int) -> DataFrame:
    """(ids, asked, size, vector) of the distinct vectors: their k + 1 smallest ids, and whether one of their rows is a query."""
    by = Window.partitionBy("size", "vector").orderBy("vec_id")
    few = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1)  # cut before the shuffle, too
    own = few.groupBy("size", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.col("vec_id") % every == 0).select("size", "vector", F.lit(True).alias("asked")).distinct()
    return own.join(asked, ["size", "vector"], "left").select("ids", F.coalesce("asked", F.lit(False)).alias("asked"), "size", "vector")


def fitted_pivots(sample: list[tuple[int, list[float]]], largest: float) -> dict[int, np.ndarray]:
    """For each length, pivots among the sample's augmented vectors: spread out, then moved to the middle of those nearest to them."""
    found = {}
    for size in {n for n, _ in sample}:
        own = [v for n, v in sample if n == size]
        x = np.array(own, np.float64).reshape(len(own), size)
        x = np.hstack([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0))[:, None]])
        chosen = [x.mean(0)]
        gap = np.full(len(x), np.inf)
        while len(chosen) < min(PIVOTS, len(x)):
            gap = np.minimum(gap, ((x - chosen[-1]) ** 2).sum(1))
            if gap.max() <= 0:
                break
            chosen.append(x[int(gap.argmax())])
        pivots = np.array(chosen)
        for _ in range(ROUNDS):
            own = _squared(x, pivots).argmin(1)
            pivots = np.array([x[own == k].mean(0) if (own == k).any() else pivots[k] for k in range(len(pivots))])
        found[size] = pivots
    return found


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _augmented(x: np.ndarray, largest: float | None) -> np.ndarray:
    last = np.zeros(len(x)) if largest is None else np.sqrt(np.maximum(largest - (x * x).sum(1), 0))
    return np.hstack([x, last[:, None]])


def _keyed(pivots: dict[int, np.ndarray], largest: float):
    """Vectors with their nearest pivot and the distance to it. A length that the sample lacks has one pivot, the origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = part.column("vector").flatten().to_numpy().reshape(part.num_rows, size)
                near = pivots.get(int(size), np.zeros((1, size + 1)))
                squared = _squared(_augmented(x, largest), near)
                own = squared.argmin(1)
                away = np.sqrt(squared[np.arange(len(own)), own])
                arrays = [*(part.column(c) for c in ("ids", "asked", "size")), pa.array(own.astype(np.int32)), pa.array(away), pa.array([v.tobytes() for v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [c.split(" ")[0] for c in _KEYED.split(", ")])

    return run


def _visits(pivots: dict[int, np.ndarray], annuli: dict[int, tuple[np.ndarray, ...]], largest: float, most: int | None):
    """Annuli that each query has to visit next: the ``most`` best bounded (all, if None) of those whose bound isn't below its k-th product. Those visited before go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                ids, pivot, low, high = annuli[int(size)]
                step = max(1, (1 << 22) // max(1, len(ids)))
                for at in range(0, part.num_rows, step):
                    own = part.slice(at, step)
                    q = _vectors(own.column("vector"), size)
                    away = np.sqrt(_squared(_augmented(q, None), pivots.get(int(size), np.zeros((1, size + 1)))))[:, pivot]
                    gap = np.maximum(0, np.maximum(away - high, low - away))
                    norm = (q * q).sum(1)[:, None] + largest
                    bound = (norm - gap * gap) / 2 + SLACK * (norm + 1)
                    for k, (row, least, seen, vector) in enumerate(zip(*(own.column(c).to_pylist() for c in ("row", "least", "seen", "vector")))):
                        go = np.flatnonzero((bound[k] >= (-np.inf if least is None else least)) & ~np.isin(ids, seen))
                        if most is not None:
                            go = go[np.argsort(-bound[k][go], kind="stable")[:most]]
                        rows += [(row, int(size), int(i), 1, least, None, vector) for i in ids[go]]
                    if len(rows) > 4096:
                        yield _entries(rows)
                        rows = []
            yield _entries(rows)

    return run


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = [c.split(" ") for c in _ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[t]) for i, (_, t) in enumerate(columns)], [n for n, _ in columns])


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if most < 1 << 53:
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def _compared(k: int):
    """The k best rows of an annulus for each query that visits it. An annulus' entries (kind 0) come before its queries (kind 1)."""

    def best(own: pa.RecordBatch, entry: np.ndarray, counts: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        score = products(_vectors(own.column("vector"), vectors.shape[1]), vectors)
        bar = np.partition(score, -k, axis=1)[:, -k] if len(entry) > k else np.full(len(score), _LEAST)
        least = own.column("least").fill_null(int(_LEAST)).to_numpy(zero_copy_only=False)
        query, at = np.nonzero(score >= np.maximum(bar, least)[:, None])
        times = counts[at]
        first = np.concatenate([[0], np.cumsum(counts)])[at]
        query, at, first = (np.repeat(v, times) for v in (query, at, first))
        vec_id = ids[first + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
        found = score[query, at]
        order = np.lexsort((vec_id, -found, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[rank < k]
        return pa.RecordBatch.from_arrays([own.column("row").take(pa.array(query[order])), pa.array(entry[at[order]]), pa.array(vec_id[order]), pa.array(found[order])], [c.split(" ")[0] for c in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stored, ready = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("annulus", "lot", "kind"))))
            cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                part = batch.slice(a, b - a)
                if keys[a][:2] != place:
                    place, stored, ready = keys[a][:2], [], None
                if keys[a][2] == 0:
                    stored.append(part)
                    continue
                if ready is None:
                    whole = pa.Table.from_batches(stored).combine_chunks()
                    lists = whole.column("ids").combine_chunks()
                    vectors = _vectors(whole.column("vector"), whole.column("size")[0].as_py())
                    ready = whole.column("row").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), vectors
                step = max(1, (1 << 22) // len(ready[0]))
                for at in range(0, part.num_rows, step):
                    yield best(part.slice(at, step), *ready)

    return run


def indexed(embeddings: DataFrame, every: int, k: int) -> tuple[DataFrame, dict[int, np.ndarray], float]:
    """(ids, asked, size, pivot, distance, vector, row, annulus) of the distinct vectors, the pivots, and the largest squared norm.

    Annuli are cut from entries sorted by pivot and distance.
    """
    rows = written(entries(prepared(embeddings), every, k), "vectors")
    squared = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    n, largest = rows.agg(F.count(F.lit(1)), F.max(squared)).first()
    sample = rows.select("size", "vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    largest = float(largest or 0.0)
    pivots = fitted_pivots([tuple(r) for r in sample], largest)
    order = ["size", "pivot", "distance", F.element_at("ids", 1)]
    lies = rows.mapInArrow(_keyed(pivots, largest), _KEYED).repartitionByRange(*order).sortWithinPartitions(*order)
    lies = lies.withColumn("row", F.monotonically_increasing_id())  # the partition's number, then 33 bits of the row's in it
    long = max(ANNULUS, -(-n // MOST_ANNULI))
    piece = F.shiftright("row", 33) * (1 << 31) + F.floor(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) / long)
    return written(lies.withColumn("annulus", F.xxhash64("size", "pivot", piece)), "index"), pivots, largest


def nearest(embeddings: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """The k largest inner products of each query (vec_id divisible by ``every``): query_id, rank (from 1), vec_id, score; ties to the smaller vec_id."""
    index, pivots, largest = indexed(embeddings, every, k)
    ranges = index.groupBy("size", "annulus", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high")).collect()  # no more than MOST_ANNULI, and one a length, pivot and partition
    annuli = {}
    for size in {r["size"] for r in ranges}:
        own = [r for r in ranges if r["size"] == size]
        annuli[size] = tuple(np.array([r[c] for r in own]) for c in ("annulus", "pivot", "low", "high"))
    asked = index.where("asked")
    lots = max(1, -(-asked.count() // LOT))
    none = F.lit(None).cast("long").alias("least")
    stored = index.select("row", "size", "annulus", F.lit(0).alias("kind"), none, "ids", "vector", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))

    def compared(visits: DataFrame, name: str) -> DataFrame:
        both = stored.unionByName(visits.withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(lots)).cast("int")))
        both = both.repartition("annulus", "lot").sortWithinPartitions("annulus", "lot", "kind")
        return written(both.mapInArrow(_compared(k + 1), _FOUND), name)

    def best(found: DataFrame) -> DataFrame:
        by = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id", "entry")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1)

    home = asked.select("row", "size", "annulus", F.lit(1).alias("kind"), none, F.lit(None).cast("array<long>").alias("ids"), "vector")
    found = compared(home, "home")
    seen = asked.select("row", "size", "vector", F.array("annulus").alias("seen"))
    for name, most in (("next", NEXT), ("rest", None)):
        least = best(found).groupBy("row").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least"))
        visits = written(seen.join(least, "row", "left").mapInArrow(_visits(pivots, annuli, largest, most), _ENTRY), name)
        found = found.unionByName(compared(visits, f"{name}-found"))
        more = visits.groupBy("row").agg(F.collect_list("annulus").alias("more"))  # NEXT a query at most, as after the last round nothing reads it
        seen = seen.join(more, "row", "left").withColumn("seen", F.concat("seen", F.coalesce("more", F.array().cast("array<long>")))).drop("more")

    queries = prepared(embeddings).where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "size", "vector").agg(F.count(F.lit(1)).alias("times"))
    known = asked.mapInArrow(_as_arrays, "row long, size int, vector array<double>")
    answers = queries.join(known, ["size", "vector"]).select("query_id", "row", "times").join(best(found), "row")
    same = Window.partitionBy("query_id", "row")
    itself = F.min(F.when((F.col("entry") == F.col("row")) & (F.col("vec_id") == F.col("query_id")), F.col("rank"))).over(same)
    others = answers.withColumn("own", F.coalesce(itself, F.lit(k + 2))).where("rank <> own")
    ranked = others.withColumn("rank", F.col("rank") - (F.col("rank") > F.col("own")).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_")).drop("_")


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(v, np.float64) for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("size"), pa.array(lists, pa.list_(pa.float64()))], ["row", "size", "vector"])
