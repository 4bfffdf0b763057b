"""The feature frame on small histories with known values."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts, features, frame

CUTOFF = datetime(2025, 3, 1)
ROWS = "era int, period int, entity long, own_group long, cutoff timestamp_ntz, captured_at timestamp_ntz, position string, price long, status string, status_state string, chance double, chance_state string, forecast double, forecast_state string, foreign_id long, source_id string"
HISTORY = "era int, entity long, occurrence_id long, kickoff timestamp_ntz, side string, exposure double, outcome double, goals double, xg string, available_at timestamp_ntz, source_id string"
RESULTS = "era int, occurrence_id long, kickoff timestamp_ntz, home long, away long, home_scored int, away_scored int, home_expected double, available_at timestamp_ntz"
SCHEDULE = "era int, period int, occurrence_id long, kickoff timestamp_ntz, available_at timestamp_ntz, home long, away long, home_difficulty double, away_difficulty double, source_id string"
EXPOSURE = (30.0, 60.0, 90.0, 0.0, 90.0, 45.0)


def day(n):
    return CUTOFF + timedelta(days=n)


def history_rows(entity=1):
    return [(2024, entity, 10 + k, day(7 * (k - 6)), ("home", "away")[k % 2], x, k + 1.0, k % 2 * 1.0, f"{k}.5", None, f"h{k}") for k, x in enumerate(EXPOSURE)]


def result_rows():
    """Groups 1 to 4 in six rounds: 1 against 2 and 3 against 4; a group scores its number, less one in even rounds."""
    return [(2024, 100 * a + k, day(7 * (k - 6)), a, a + 1, a - k % 2, a + 1, a / 2.0, None) for k in range(6) for a in (1, 3)]


def built(spark, *, history=None, results=None, foreign=7, chance=(None, "source_unavailable")):
    snapshots = spark.createDataFrame(
        [(2024, 20, e, g, CUTOFF, day(-0.1), "M", 55, "d", "value", chance[0], chance[1], None, "source_unavailable", foreign, "snap") for e, g in ((1, 1), (2, 4), (3, 9))], ROWS
    )
    schedule = spark.createDataFrame([(2024, 20, 901, day(1), day(-3), 1, 2, 2.0, 3.0, "s1"), (2024, 20, 902, day(3), day(-2), 3, 1, 4.0, 3.0, "s2"), (2024, 20, 903, day(4), day(0), 1, 4, 1.0, 1.0, "late")], SCHEDULE)
    known = facts.announced(snapshots, schedule)
    rows = facts.period_rows(snapshots, known, source="source_id")
    own = frame.entity_history(spark.createDataFrame(history if history is not None else history_rows(), HISTORY))
    both = frame.two_sided(spark.createDataFrame(results if results is not None else result_rows(), RESULTS))
    return frame.feature_frame(rows, known, own, both), rows


def by_entity(made):
    return {r["entity"]: r for r in made.collect()}


def test_values(spark):
    made, rows = built(spark)
    assert frame.contract_problems(made) == [] and len(frame.NAMES) == len(set(frame.NAMES)) == 46
    got = by_entity(made)
    one = got[1]
    assert (one["exposure_mean_last3"], one["exposure_mean_last5"], one["played_rate_last5"], one["appearances"]) == (45.0, 57.0, 0.8, 5)
    assert one["side_outcome_mean_last5"] == 3.5 and one["exposure_last_appearance"] == 45.0 and one["outcome_last_appearance"] == 6.0
    assert (one["n_occurrences"], one["n_home"], one["difficulty_mean"], one["difficulty_min"]) == (2, 1, 2.5, 2.0)
    assert one["outcome_per90_last5"] == pytest.approx(90 * 20 / (285 + 1e-6)) and one["scored_per90_last5"] == pytest.approx(90 * 3 / (285 + 1e-6))
    assert one["expected_scored_per90_last5"] == pytest.approx(90 * 17.5 / (285 + 1e-6)) and one["attempts_per90_last5"] is None
    assert one["own_scored_mean_last5"] == pytest.approx(0.4) and one["own_conceded_mean_last5"] == 2.0 and one["own_win_rate_last5"] == 0.0
    # counter-groups 2 (scores 2, concedes 0.4) and 3 (scores 2.4, concedes 4)
    assert one["counter_scored_mean_last5"] == pytest.approx(2.2) and one["counter_conceded_mean_last5"] == pytest.approx(2.2) and one["counter_loss_rate_last5"] == pytest.approx(0.5)
    assert one["attack_matchup"] == pytest.approx(0.4 * 2.2) and one["clean_matchup"] == 0.0
    assert one["own_expected_mean_last5"] == 0.5 and one["counter_expected_mean_last5"] is None  # the away side's isn't known
    assert one["rest_days"] == 8.0 and one["idle_days"] == 8.0 and one["status_ordinal"] == 1 and one["price"] == 5.5 and one["chance"] is None
    assert one["source_ids"] == sorted([*(f"h{k}" for k in range(6)), "s1", "s2", "snap"])
    assert one["known_at"] < CUTOFF
    blank = got[3]  # no history, no group, no occurrence
    assert (blank["n_occurrences"], blank["appearances"]) == (0, 0)
    assert all(blank[f.name] is None for f in frame.CONTRACT if "blank" in f.missing or "no row" in f.missing or "never played" in f.missing)
    assert frame.frame_violations(made, rows).count() == 0


def test_nothing_after_the_cutoff_changes_the_frame(spark):
    later = [(2024, 1, 90 + k, day(k), "home", 90.0, 999.0, 9.0, "99", None, "future") for k in range(3)]
    hidden = [(2024, 1, 80, day(-2), "home", 90.0, 999.0, 9.0, "99", day(0), "future")]  # known exactly at the cutoff
    other = [(2025, 1, 95, day(-30), "home", 90.0, 999.0, 9.0, "99", None, "other era")]
    results = [(2024, 990 + k, day(k - 0.05), 1, 2, 9, 9, 9.0, None) for k in range(3)]
    before, _ = built(spark)
    after, _ = built(spark, history=[*later, *hidden, *other, *reversed(history_rows())], results=[*results, *result_rows()])
    assert before.exceptAll(after).count() == after.exceptAll(before).count() == 0


def test_a_row_known_at_the_cutoff_is_late(spark):
    rows = history_rows()
    rows[-1] = (*rows[-1][:9], CUTOFF, rows[-1][10])
    made, _ = built(spark, history=rows)
    assert by_entity(made)[1]["exposure_mean_last3"] == 60.0


def test_missing_is_not_zero(spark):
    made, _ = built(spark, foreign=None, chance=(0.0, "genuine_zero"))
    one = by_entity(made)[1]
    assert one["chance"] == 0.0 and one["scored_per90_last5"] > 0
    assert all(one[f"{c}_per90_last5"] is None for c in frame.FOREIGN)


def test_contract_problems(spark):
    made, _ = built(spark)
    assert frame.contract_problems(made.drop("price"))
    assert frame.contract_problems(made.withColumn("clean_matchup", F.col("clean_matchup").cast("string"))) == ["clean_matchup is string instead of double"]
    turned = made.select(*made.columns[:-2], made.columns[-1], made.columns[-2])
    assert frame.contract_problems(turned) == ["column 45 is clean_matchup instead of attack_matchup", "column 46 is attack_matchup instead of clean_matchup"]


def test_histories(spark):
    with pytest.raises(ValueError, match="lacks side"):
        frame.entity_history(spark.createDataFrame(history_rows(), HISTORY).drop("side"))
    bad = spark.createDataFrame([(*history_rows()[0][:8], "a lot", None, "h"), (2024, None, 5, CUTOFF, "home", 1.0, None, 1.0, "", None, "h")], HISTORY)
    got = {(r["rule"], r["occurrence_id"]) for r in frame.history_violations(bad).collect()}
    assert got == {("xg isn't a number", 10), ("entity is missing", 5), ("outcome is missing", 5)}
    assert [r["expected_scored"] for r in frame.entity_history(bad).collect()] == [None, None]
    one_sided = spark.createDataFrame([(2024, 1, CUTOFF, 5, 2, 1, "0.5")], "era int, occurrence_id long, kickoff timestamp_ntz, own_group long, scored int, conceded int, expected string")
    row = frame.two_sided(one_sided).first()
    assert (row["scored"], row["conceded"], row["expected"], row["expected_conceded"], row["available_at"]) == (2.0, 1.0, 0.5, None, CUTOFF + timedelta(hours=3))
    two = {r["own_group"]: (r["scored"], r["conceded"], r["expected"], r["expected_conceded"]) for r in frame.two_sided(spark.createDataFrame(result_rows()[:1], RESULTS)).collect()}
    assert two == {1: (1.0, 2.0, 0.5, None), 2: (2.0, 1.0, None, 0.5)}


def test_numbers_are_not_read_as_text(spark):
    text, number = (spark.createDataFrame([(2024, 1, 1, CUTOFF, "home", x, 1.0)], f"era int, entity long, occurrence_id long, kickoff timestamp_ntz, side string, exposure {t}, outcome double") for t, x in (("string", "90"), ("double", 90.0)))
    plans = [frame.entity_history(rows)._jdf.queryExecution().toString().lower() for rows in (text, number)]
    assert ["rlike" in p for p in plans] == [True, False]
    odd = [float("nan"), float("inf"), float("-inf"), None, -0.0, 1e300, 5e-324, 2.5]
    rows = spark.createDataFrame([(2024, 1, k, CUTOFF, "home", x, 1.0) for k, x in enumerate(odd)], number.schema)
    assert [r["exposure"] for r in frame.entity_history(rows).orderBy("occurrence_id").collect()] == [None] * 4 + odd[4:]


@pytest.mark.parametrize("most", [1, 5])
def test_last_rows_of_a_long_history_are_bounded_before_they_meet_the_cutoffs(spark, most):
    rng = random.Random(11)
    rows = [(rng.choice([2024, 2025]), g, k, day(rng.randint(-30, 10)), day(rng.randint(-30, 10)), rng.choice([None, day(rng.randint(-30, 12))])) for g in (1, 2, None) for k in range(300)]
    history = spark.createDataFrame(rows, "era int, own_group long, occurrence_id long, kickoff timestamp_ntz, completed_at timestamp_ntz, available_at timestamp_ntz")
    marks = spark.createDataFrame([(2024, g, day(d)) for g in (1, 2, 3) for d in range(-28, 12, 4)] + [(2025, 1, day(0)), (2025, 1, None)], "era int, own_group long, cutoff timestamp_ntz")
    by, order = ["own_group", "era", "cutoff"], ["kickoff", "occurrence_id"]
    columns = [*by, "occurrence_id", "recency"]
    want = features.last_rows(features.eligible(history, marks, entity="own_group"), by, order, most).select(columns).collect()
    got = features.last_known(history, marks, order, most, entity="own_group").select(columns).collect()
    assert len(got) > 15 and sorted(got) == sorted(want)
