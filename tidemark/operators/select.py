"""Constrained selection for many portfolios in one plan: the best legal line-up, reserves, lead and deputy.

A portfolio has 15 entities: 2 of position G, 5 D, 5 M, 3 F, at most 3 of one club. Columns: ``portfolio``
(any number of grouping columns), entity, position, club, score, p_played, p_long, exposure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many of each position a portfolio holds, and how many may be in the line-up of 11.
SIZES = {"G": 2, "D": 5, "M": 5, "F": 3}
RANGES = {"G": (1, 1), "D": (3, 5), "M": (2, 5), "F": (1, 3)}
CLUB_LIMIT, LINE_UP = 3, 11
FORMATIONS = [(1, d, m, f) for d in range(3, 6) for m in range(2, 6) for f in range(1, 4) if d + m + f == LINE_UP - 1]
# Other names of the positions.
POSITION_NAMES = {"1": "G", "2": "D", "3": "M", "4": "F", "GK": "G", "GKP": "G", "DEF": "D", "MID": "M", "FWD": "F", "G": "G", "D": "D", "M": "M", "F": "F"}


def position_of(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in POSITION_NAMES.items() for x in pair))
    return table[F.upper(F.trim(name.cast("string")))]


def portfolio_violations(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, problem) of portfolios that can't be decided, from one aggregation by portfolio and one by club."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("entity").alias("distinct"),
        *(F.count_if(F.col("position") == p).alias(p) for p in SIZES),
        F.count_if(~finite).alias("unscored"),
        F.count_if(~F.coalesce(F.col("p_played").between(0, 1) & F.col("p_long").between(0, 1), F.lit(False))).alias("outside"),
        F.count_if(F.col("p_long") > F.col("p_played") + 1e-12).alias("incoherent"),
        F.count_if(F.col("exposure") < 0).alias("negative"),
    )
    crowded = rows.groupBy(*by, "club").count().where(F.col("count") > CLUB_LIMIT).select(*by, F.lit("club limit").alias("problem")).distinct()
    rules = {
        "not 15": F.col("n") != sum(SIZES.values()),
        "repeated entity": F.col("distinct") != F.col("n"),
        "positions": ~((F.col("G") == 2) & (F.col("D") == 5) & (F.col("M") == 5) & (F.col("F") == 3)),
        "no finite score": F.col("unscored") > 0,
        "probability outside 0..1": F.col("outside") > 0,
        "p_long above p_played": F.col("incoherent") > 0,
        "negative exposure": F.col("negative") > 0,
    }
    found = F.explode(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))
    return counts.select(*by, found.alias("problem")).unionByName(crowded)


def best_line_up(rows: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """(by, formation, line_up_score, line_up): the legal 11 with the largest sum; on a tie the smallest sorted keys.

    Within a formation the best are the first of each position, so eight sums decide where there are 1,365 subsets.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "position").orderBy(F.col(score).desc(), "entity")))
    options = F.explode(F.array(*(F.struct(F.lit(f"{d}-{m}-{f}").alias("formation"), F.lit(g).alias("G"), F.lit(d).alias("D"), F.lit(m).alias("M"), F.lit(f).alias("F")) for g, d, m, f in FORMATIONS)))
    tried = ranked.select("*", options.alias("_o")).where(F.col("_rank") <= F.when(F.col("position") == "G", F.col("_o.G")).when(F.col("position") == "D", F.col("_o.D")).when(F.col("position") == "M", F.col("_o.M")).otherwise(F.col("_o.F")))
    sums = tried.groupBy(*by, F.col("_o.formation").alias("formation")).agg(F.round(F.sum(score), 9).alias("line_up_score"), F.array_sort(F.collect_list("entity")).alias("line_up"))
    best = F.min_by(F.struct("formation", "line_up_score", "line_up"), F.struct(-F.col("line_up_score"), F.col("line_up")))
    return sums.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def risk_flags(*, p_played: Column, p_long: Column, exposure: Column, status: Column, n_occurrences: Column, chance: Column, quality: Column, low_played: float = 0.6, low_long: float = 0.5, low_exposure: float = 45.0) -> Column:
    """The flags that apply, ``|`` between them, or NONE. What isn't known (NULL) raises none but that of the data's quality."""
    flags = F.concat_ws(
        "|",
        F.when(n_occurrences == 0, "BLANK"),
        F.when(F.lower(status) != "a", F.concat(F.lit("STATUS_"), F.upper(status))),
        F.when(chance < 100, "CHANCE_BELOW_100"),
        F.when(p_played < low_played, "MAY_NOT_PLAY"),
        F.when(p_long < low_long, "MAY_BE_SHORT"),
        F.when(exposure < low_exposure, "LOW_EXPOSURE"),
        F.when(~F.coalesce(F.upper(quality).isin("OK", "COMPLETE"), F.lit(False)), "DATA_QUALITY"),
    )
    return F.when(flags == "", "NONE").otherwise(flags)


def data_quality(*states: Column) -> Column:
    """The worst of the value states, in any case; those that are NULL say nothing."""
    every = F.array(*(F.lower(c) for c in states))
    return F.when(F.exists(every, lambda x: x == "acquisition_failure"), "ACQUISITION_FAILURE").when(F.exists(every, lambda x: x == "source_unavailable"), "SOURCE_UNAVAILABLE").otherwise("OK")


def decided(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row with its role: starter and line-up rank, reserve order (the keeper last), lead and deputy."""
    chosen = best_line_up(rows, by)
    marked = rows.join(chosen, list(by)).withColumn("starter", F.array_contains("line_up", F.col("entity"))).drop("line_up")
    within = Window.partitionBy(*by, "starter")
    by_score = within.orderBy(F.col("score").desc(), F.col("p_long").desc(), F.col("p_played").desc(), "entity")
    reserve = within.orderBy((F.col("position") == "G").cast("int"), (F.col("score") * F.col("p_played")).desc(), F.col("score").desc(), F.col("p_played").desc(), "entity")
    placed = marked.withColumns({"_place": F.row_number().over(by_score), "_order": F.row_number().over(reserve)})
    lead = F.col("starter") & (F.col("_place") == 1)
    everyone = Window.partitionBy(*by)
    risk = 1 - F.max(F.when(lead, F.col("p_played"))).over(everyone)
    ready = placed.withColumns({"lead": lead, "_deputy_value": risk * F.col("p_played") * F.col("score")})
    second = Window.partitionBy(*by).orderBy((F.col("starter") & ~F.col("lead")).desc(), F.col("_deputy_value").desc(), F.col("score").desc(), F.col("p_played").desc(), F.col("p_long").desc(), "entity")
    return ready.withColumns(
        {"line_up_rank": F.when(F.col("starter"), F.col("_place")), "reserve_order": F.when(~F.col("starter"), F.col("_order")), "deputy": F.row_number().over(second) == 1}
    ).drop("_place", "_order", "_deputy_value")


def reasons(rows: DataFrame) -> DataFrame:
    """A sentence for each row's role."""
    score = F.format_string("%.3f", F.col("score"))
    text = (
        F.when(F.col("lead"), F.concat(F.lit("lead: largest score "), score))
        .when(F.col("deputy"), F.concat(F.lit("deputy: covers the lead, score "), score))
        .when(F.col("starter"), F.concat(F.lit("starts in "), F.col("formation"), F.lit(", score "), score))
        .otherwise(F.concat(F.lit("reserve "), F.col("reserve_order").cast("string"), F.lit(", score "), score))
    )
    return rows.withColumn("reason", text)


def summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """What one shows of a decision."""
    role = F.when(F.col("lead"), "LEAD").when(F.col("deputy"), "DEPUTY").when(F.col("starter"), "STARTER").otherwise("RESERVE")
    return rows.select(*by, "entity", "position", "club", role.alias("role"), F.coalesce("line_up_rank", F.lit(LINE_UP) + F.col("reserve_order")).alias("place"), "formation", F.round("score", 3).alias("score"))
