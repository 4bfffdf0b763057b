"""Ranking, error and probability metrics per group, and their mean over groups.

A group (``by``) is usually an era and period; with fold, seed, model or cohort added to it the same code
scores any number of models at once, in one plan. Summaries weigh groups alike, whatever their size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def ranked(frame: DataFrame, by: Sequence[str], value: str, key: Sequence[str], name: str) -> DataFrame:
    """Descending rank of a value, ties in order of the key."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), *(F.col(k).asc() for k in key))
    return frame.withColumn(name, F.row_number().over(order))


def average_rank(frame: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Ascending rank; equal values share the mean of theirs."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return frame.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


#: Parts of a group, by value, that are ranked apart from each other.
SLICES = 64


def average_ranks(frame: DataFrame, by: Sequence[str], value: str, slices: int = SLICES) -> DataFrame:
    """(by, value, rank, n): each distinct value's ascending rank, the mean of those of its rows, and how many rows have it.

    A group, however large, isn't sorted as one: it is cut at ``slices`` of its values (approximate quantiles do: any cut gives the same ranks), slices
    are sorted apart, and a slice's ranks begin after the rows of those before it.
    """
    counts = frame.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    cuts = frame.groupBy(*by).agg(F.percentile_approx(value, [k / slices for k in range(1, slices)], 1000).alias("_cuts"))
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    cuts = cuts.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), "_cuts")
    place = F.coalesce(F.aggregate("_cuts", F.lit(0), lambda t, x: t + (F.col(value) > x).cast("int")), F.lit(-1))  # nulls first
    placed = counts.join(cuts, same or F.lit(True)).withColumn("_slice", place).select(*by, value, "n", "_slice")
    over = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "_slice").agg(F.sum("n").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(over), F.lit(0)))
    sizes = sizes.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_slice").alias("_s"), "_before")
    within = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked_ = placed.withColumn("_upto", F.sum("n").over(within)).join(sizes, [*same, F.col("_slice") == F.col("_s")])
    return ranked_.select(*by, value, (F.col("_before") + F.col("_upto") - (F.col("n") - 1) / F.lit(2.0)).alias("rank"), "n")


#: Groups of at least so many rows are bounded before their first rows are sorted; a row for each of these groups is broadcast.
LARGE = 4_000
#: Parts of a large group, by key, whose first rows bound the group's.
PARTS = 64


def contenders(frame: DataFrame, by: Sequence[str], value: str, key: Sequence[str], k: int) -> DataFrame:
    """The rows that may be among a group's first k by a descending value, ties in order of the key: all of a small group, a few times k of a large one.

    A large group is cut into parts by its keys. Each part's largest value is that of another row, so the k-th largest of these is no larger
    than the group's k-th value. Of the rows with just that value, the k-th smallest of the parts' smallest keys bounds the keys. Nothing is sorted for it.
    """
    part = F.pmod(F.xxhash64(*key), F.lit(max(PARTS, 4 * k))).alias("_part")
    own = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    largest = frame.groupBy(*by, part).agg(F.max(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    least = largest.groupBy(*by).agg(F.sum("_n").alias("_n"), F.get(F.sort_array(F.collect_list("_v"), asc=False), F.lit(k - 1)).alias("_least")).where(F.col("_n") >= LARGE).drop("_n")
    near = _joined(frame, F.broadcast(least), by).where(F.coalesce(F.col(value) >= F.col("_least"), F.col("_least").isNull()))
    smallest = near.where(F.col(value) == F.col("_least")).groupBy(*by, part).agg(F.min(own).alias("_k"))
    last = smallest.groupBy(*by).agg(F.get(F.sort_array(F.collect_list("_k")), F.lit(k - 1)).alias("_last")).where("_last IS NOT NULL")
    # Null keys come first.
    kept = F.coalesce(F.col(value) > F.col("_least"), F.lit(True)) | F.coalesce(own <= F.col("_last"), F.lit(True))
    return _joined(near, F.broadcast(last), by).where(kept).select(*frame.columns)


def first_rows(frame: DataFrame, by: Sequence[str], value: str, key: Sequence[str], k: int, name: str) -> DataFrame:
    """Each group's first k rows by a descending value, ties in order of the key, with their rank."""
    return ranked(contenders(frame, by, value, key, k), by, value, key, name).where(F.col(name) <= k)


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right`` for the same group; null is a group like any other."""
    names = {c: f"_g{i}" for i, c in enumerate(by)}
    right = right.select(*(F.col(c).alias(n) for c, n in names.items()), *(c for c in right.columns if c not in by))
    return left.join(right, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()] or F.lit(True), "left").drop(*names.values())


def correlation(x: Column, y: Column) -> Column:
    """Pearson's; NULL where either is constant."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def key_hash(key: Sequence[str]) -> Column:
    """SHA-256 of a group's sorted keys, one a line."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in key))
    return F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256)


def ranking_metrics(frame: DataFrame, by: Sequence[str], actual: str, predicted: str, key: Sequence[str], *, k: int = 10, with_hash: bool = False) -> DataFrame:
    """Per group: rows, ndcg, spearman, mae, rmse, mean_bias, top_overlap, top1_hit."""
    own = frame.select(*by, *(c for c in key if c not in by), F.col(actual).cast("double").alias("_y"), F.col(predicted).cast("double").alias("_p"))
    error = F.col("_p") - F.col("_y")
    errors = [F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("mean_bias")]
    whole = own.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *errors, *([key_hash(key).alias("key_hash")] if with_hash else []))
    # Only a group's first k rows by prediction and by actual count for these: twice k rows a group. A row is named by its key, value for value.
    gain = F.greatest(F.col("_y"), F.lit(0.0)) / F.log2(F.col("_r") + 1.0)
    row = F.struct(*key, "_y", "_p").alias("row")
    first, best = (first_rows(own, by, c, key, k, "_r").groupBy(*by).agg(F.sum(gain).alias(g), F.collect_list(row).alias(rows), F.min_by(row, "_r").alias(f"{rows}_one")) for c, g, rows in (("_p", "_dcg", "_first"), ("_y", "_ideal", "_best")))
    out = _joined(_joined(whole, first, by), best, by)
    hit = F.when(F.array_contains("_best", F.col("_first_one")), 1.0).otherwise(0.0)
    out = out.withColumns({
        "ndcg": F.when(F.col("_ideal") > 0, F.col("_dcg") / F.nullif(F.col("_ideal"), F.lit(0.0))).otherwise(0.0),
        "top_overlap": F.size(F.filter("_first", lambda x: F.array_contains(F.col("_best"), x))) / F.least("rows", F.lit(k)).cast("double"),
        "top1_hit": hit,
    })
    out = _joined(out, rank_correlation(own, by), by)
    return out.select(*by, "rows", "ndcg", "spearman", "mae", "rmse", "mean_bias", "top_overlap", "top1_hit", *(["key_hash"] if with_hash else []))


def rank_correlation(own: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, spearman) of ``_p`` and ``_y``, whose ranks come from their distinct values."""
    pairs = own.groupBy(*by, "_p", "_y").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    for value, name in (("_p", "_ap"), ("_y", "_aa")):
        pairs = _joined(pairs, average_ranks(own, by, value).select(*by, value, F.col("rank").alias(name)), [*by, value])
    # Ranks are halves, so their sums are exact as far as doubles are; around the middle rank, which both have as their mean, they stay small.
    n = F.sum("_n")
    x, y, w = F.col("_ap"), F.col("_aa"), F.col("_n")
    middle = _joined(pairs, own.groupBy(*by).agg(((F.count(F.lit(1)) + 1) / F.lit(2.0)).alias("_m")), by)
    x, y = x - F.col("_m"), y - F.col("_m")
    varies = (F.min("_ap") < F.max("_ap")) & (F.min("_aa") < F.max("_aa"))
    r = (F.sum(w * x * y) / n) / F.nullif(F.sqrt(F.sum(w * x * x) / n) * F.sqrt(F.sum(w * y * y) / n), F.lit(0.0))
    return middle.groupBy(*by).agg(F.when(varies, r).alias("spearman"))


def ndcg_scores(frame: DataFrame, truth: DataFrame, by: Sequence[str], shared: Sequence[str], actual: str, predicted: str, key: Sequence[str], *, k: int = 10) -> DataFrame:
    """(by, ndcg) alone, for many variants of predictions of the same rows: only each group's first k rows are ranked, and the ideal comes from ``truth`` once for each of ``shared``."""

    def gains(rows: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
        top = first_rows(rows, groups, value, key, k, "_rank")
        return top.groupBy(*groups).agg(F.sum(F.greatest(F.col(actual).cast("double"), F.lit(0.0)) / F.log2(F.col("_rank") + 1.0)).alias(name))

    both = gains(frame, by, predicted, "_dcg").join(gains(truth, shared, actual, "_ideal"), list(shared))
    return both.select(*by, F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def mean_over_groups(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Unweighted mean of each metric over the groups that have it."""
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), *(F.avg(c).alias(c) for c in columns))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def probability_metrics(frame: DataFrame, by: Sequence[str], target: str, probability: str, key: Sequence[str]) -> DataFrame:
    """Per group: rows, positives, brier, log_loss, roc_auc, pr_auc, precision and lift at 5, 10, 20, recall at 10, 20. NULL where a metric has no meaning."""
    own = frame.select(*by, *(c for c in key if c not in by), F.col(target).cast("double").alias("_y"), F.col(probability).cast("double").alias("_p"))
    y, p = F.col("_y"), F.col("_p")
    whole = own.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positives"), brier(y, p).alias("brier"), log_loss(y, p).alias("log_loss"))
    top = first_rows(own, by, "_p", key, 20, "_r").groupBy(*by).agg(*(F.sum(F.when(F.col("_r") <= k, y).otherwise(0.0)).alias(f"_hits_{k}") for k in (5, 10, 20)))
    ones = own.where(y == 1).groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_ones"))
    summed = _joined(ones, average_ranks(own, by, "_p").select(*by, "_p", "rank"), [*by, "_p"]).groupBy(*by).agg(F.sum(F.col("_ones") * F.col("rank")).alias("_ranks"))
    out = _joined(_joined(whole, top, by), summed, by)
    n, positives = F.col("rows").cast("double"), F.col("positives")
    pairs = F.nullif(positives * (n - positives), F.lit(0.0))
    columns = [*by, "rows", "positives", "brier", "log_loss", ((F.col("_ranks") - positives * (positives + 1) / 2) / pairs).alias("roc_auc")]
    for k in (5, 10, 20):
        hits = F.col(f"_hits_{k}")
        share = hits / F.least(n, F.lit(float(k)))
        columns += [share.alias(f"precision_{k}"), (share / F.nullif(positives / n, F.lit(0.0))).alias(f"lift_{k}")]
        if k > 5:
            columns.append((hits / F.nullif(positives, F.lit(0.0))).alias(f"recall_{k}"))
    return out.select(*columns).join(average_precision(frame, by, target, probability), list(by))


def average_precision(frame: DataFrame, by: Sequence[str], target: str, probability: str) -> DataFrame:
    """Area under precision and recall, a step for each distinct score; NULL without positives."""
    steps = frame.groupBy(*by, F.col(probability).cast("double").alias("_p")).agg(F.sum(F.col(target).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_n"))
    down = Window.partitionBy(*by).orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_y").over(Window.partitionBy(*by))
    running = steps.withColumns({"_precision": F.sum("_y").over(down) / F.sum("_n").over(down), "_gain": F.col("_y") / F.nullif(total, F.lit(0.0))})
    return running.groupBy(*by).agg(F.sum(F.col("_gain") * F.col("_precision")).alias("pr_auc"))


def linspace(bins: int) -> list[float]:
    """The edges as binary floating point has them, so 3 / 10 isn't what 3 * 0.1 is."""
    return [k * (1.0 / bins) for k in range(bins)] + [1.0]


def calibration_table(frame: DataFrame, by: Sequence[str], target: str, probability: str, *, bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_probability, observed): equal widths, the last bin closed on the right; empty bins are absent."""
    edges = linspace(bins)
    p = F.col(probability).cast("double")
    place = reduce(lambda a, k: F.when(p >= edges[k], k).otherwise(a), range(1, bins), F.lit(0))
    return frame.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg(F.col(target).cast("double")).alias("observed"))


def calibration_error(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected calibration error of a calibration table."""
    n = F.col("n").cast("double")
    return table.groupBy(*by).agg((F.sum(n * F.abs(F.col("observed") - F.col("mean_probability"))) / F.sum(n)).alias("calibration_error"))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.ln(q / (1 - q))


def calibration_line(frame: DataFrame, target: str, probability: str) -> tuple[float, float] | None:
    """(intercept, slope) of the unpenalised logistic regression on the logit; None with one class only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = frame.select(F.col(target).cast("double").alias("label"), logit(F.col(probability).cast("double")).alias("x"))
    if rows.select("label").distinct().limit(2).count() < 2:
        return None
    fitted = LogisticRegression(regParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    return float(fitted.intercept), float(fitted.coefficients[0])


def monotonicity_violation_rate(low: Column, high: Column, tolerance: float = 1e-12) -> Column:
    """How often the probability of the rarer event exceeds that of the more common one."""
    return F.avg((low > high + tolerance).cast("double"))
