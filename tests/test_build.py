"""The whole build on small tables: a transfer, and every stage that can stop it."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import build

T0 = datetime(2025, 1, 10)


def tables(spark, kept=None, **change):
    rows = {
        "schedule": [(2024, 9, 901, T0 + timedelta(1), T0 - timedelta(5), 1, 2, 2.0, 3.0), (2024, 10, 902, T0 + timedelta(8), T0 - timedelta(4), 8, 3, 2.0, 4.0)],
        "snapshots": [(2024, 9, 7, 1, T0, T0 - timedelta(hours=2)), (2024, 10, 7, 8, T0 + timedelta(7), T0 + timedelta(6))],
        "registry": [(2024, 70, 7, 1, 1, 9), (2024, 70, 7, 8, 10, None)],
        "outcomes": [(2024, 901, 70, 90, 5, 9, "home"), (2024, 902, 70, 60, 2, 10, None)],
    } | change
    schemas = {
        "schedule": "era int, period int, occurrence_id long, kickoff timestamp_ntz, available_at timestamp_ntz, home long, away long, home_difficulty double, away_difficulty double",
        "snapshots": "era int, period int, entity long, own_group long, cutoff timestamp_ntz, captured_at timestamp_ntz",
        "registry": "era int, alias long, entity long, own_group long, valid_from int, valid_to int",
        "outcomes": "era int, occurrence_id long, alias long, exposure long, outcome long, period int, side string",
    }
    made = {n: spark.createDataFrame(rows[n], schemas[n]) for n in rows}
    return build.build(made["outcomes"], made["schedule"], made["snapshots"], made["registry"], lambda df, name: ([] if kept is None else kept).append(name) or df.cache())


def test_what_stages_share_is_written_once(spark):
    kept = []
    tables(spark, kept)
    assert "snapshots" in kept and len(set(kept)) == len(kept)


def test_a_transfer_gives_each_period_its_group(spark):
    made = tables(spark)
    assert made.stopped_at is None and made.violations is None
    assert sorted(map(tuple, made.facts.select("period", "own_group", "counter_group").collect())) == [(9, 1, 2), (10, 8, 3)]
    assert sorted(map(tuple, made.rows.select("period", "n_occurrences", "y_outcome", "y_exposure", "y_long").collect())) == [(9, 1, 5, 90, 1), (10, 1, 2, 60, 1)]
    assert made.report.first()["fact_outcome"] == made.report.first()["row_outcome"] == 7


S, N, R, O = (2024, 9, 901, T0 + timedelta(1), T0 - timedelta(5), 1, 2, 2.0, 3.0), (2024, 9, 7, 1, T0, T0 - timedelta(hours=2)), (2024, 70, 7, 1, 1, 99), (2024, 901, 70, 90, 5, 9, "home")


@pytest.mark.parametrize(
    "change,stage,rule",
    [
        ({"schedule": [(*S[:6], 1, *S[7:])]}, "schedule", "same group on both sides"),
        ({"snapshots": [N, N]}, "snapshots", "repeated snapshot"),
        ({"snapshots": [(*N[:5], T0)]}, "snapshots", "captured after the cutoff"),
        ({"schedule": [(*S[:4], T0, *S[5:])]}, "contexts", "not announced before the cutoff"),
        ({"outcomes": [(2024, 999, *O[2:])]}, "facts", "unknown occurrence"),
        ({"registry": [(2024, 70, 7, 1, 10, None)]}, "facts", "no identity then"),
        ({"registry": [R, R]}, "facts", "several identities then"),
        ({"registry": [(2024, 70, 7, 5, 1, None)]}, "facts", "group not in occurrence"),
        ({"outcomes": [(*O[:6], "away")]}, "facts", "side disagrees"),
        ({"outcomes": [(*O[:5], 8, None)]}, "facts", "period disagrees"),
        ({"outcomes": [O, O]}, "reconciliation", "repeated_facts"),
        ({"outcomes": []}, "reconciliation", "keys_with_other_ids"),
        ({"registry": [(2024, 70, 6, 1, 1, None)]}, "labels", "fact without a row"),
    ],
)
def test_a_violation_stops_the_build(spark, change, stage, rule):
    made = tables(spark, **({"schedule": [S], "snapshots": [N], "registry": [R], "outcomes": [O]} | change))
    assert made.rows is None and made.stopped_at == stage
    assert rule in {r["rule"] for r in made.violations.collect()}


def test_outcome_columns(spark):
    frame = spark.range(1).select(F.lit(1).alias("y_outcome"), F.lit(1).alias("price"), F.lit(1).alias("Actual"), F.lit(1).alias("returned"))
    assert build.outcome_columns(frame, ["returned"]) == ["y_outcome", "Actual", "returned"]
