"""Contracts, snapshots, identities, facts, features and audits on hand-computed cases."""

import datetime as dt
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import contracts, facts, features, identity, leakage, snapshots
from tidemark.sources import files

T0 = dt.datetime(2026, 8, 15, 10)
MICRO = dt.timedelta(microseconds=1)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_strict_scalars(spark):
    df = spark.createDataFrame([("+5",), ("5.0",), ("-7",), ("05",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(scalars.strict_integer(F.col("v"))).collect()]
    assert got == [5, None, -7, None, None, None]
    flags = spark.createDataFrame([("True",), ("0",), ("yes",)], "v string").select(scalars.strict_boolean(F.col("v"))).collect()
    assert [r[0] for r in flags] == [True, False, None]
    names = spark.createDataFrame([("João  Pedro-Ñ",)], "v string").select(scalars.plain_name(F.col("v"))).first()[0]
    assert names == "joao pedro n"
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    ids = spark.createDataFrame([(f"customer:{k}",) for k in range(40)], "v string")
    for r in ids.select("v", scalars.uuid5(space, F.col("v")).alias("u")).collect():
        assert r["u"] == str(uuid.uuid5(space, r["v"]))


def test_instants(spark):
    df = spark.createDataFrame([("2026-08-15T10:00:00Z",), ("2026-08-15T12:00:00+02:00",), ("2026-08-15T10:00:00",)], "v string")
    assert [r[0] for r in df.select(scalars.utc_instant(F.col("v"))).collect()] == [T0, None, None]
    assert [r[0] for r in df.select(scalars.utc_instant(F.col("v"), convert=True)).collect()] == [T0, T0, None]


def test_states(spark):
    df = spark.createDataFrame([(None, "source_unavailable"), (1.0, "source_unavailable"), (0.0, "value"), (0.0, "genuine_zero"), (None, "value"), (2.0, "odd")], "v double, s string")
    got = [r[0] for r in df.select(scalars.state_violation(F.col("v"), F.col("s"))).collect()]
    assert got == [None, "missing state with a value", "zero must be genuine_zero", None, "value is missing", "unknown state"]


def test_contract(spark):
    field = contracts.Field
    contract = contracts.Contract("t", (field("k", "integer"), field("x", "number"), field("c", "string", choices=("a",))), ("k",))
    df = spark.createDataFrame([(1, 1.0, "a"), (1, float("nan"), "b"), (None, None, "a")], "k long, x double, c string")
    found = {(r["rule"], r["detail"]) for r in contracts.violations(df, contract).collect()}
    assert found == {("field", "x isn't finite"), ("field", "c isn't a choice"), ("field", "k is null"), ("field", "x is null"), ("duplicate key", "2"), ("null key", "1")}
    assert contracts.violations(df.drop("c"), contract).first()["rule"] == "missing column"
    assert contracts.conforms(contracts.conformed(df, contract), contract)


def test_interval_that_starts_where_another_ends_overlaps(spark):
    df = spark.createDataFrame([(1, 1, 20), (1, 20, None), (2, 1, None), (2, 5, 6), (3, 1, 4), (3, 5, 9)], "k int, a int, b int")
    assert {r["key"] for r in contracts.overlapping_intervals(df, ["k"], "a", "b").collect()} == {"1|1", "2|1"}


@pytest.mark.parametrize("late,reason", [(-MICRO, None), (dt.timedelta(0), "captured late"), (dt.timedelta(seconds=1), "captured late")])
def test_gate_boundary(spark, late, reason):
    calendar = spark.createDataFrame([(2026, 1, T0), (2026, 2, T0 + dt.timedelta(days=7))], "era int, period int, cutoff timestamp")
    snapshot = spark.createDataFrame([(2026, 1, T0 + late, [(1, True, T0), (2, False, None)])], "era int, target int, captured_at timestamp, events array<struct<period:int,is_next:boolean,cutoff:timestamp>>")
    assert snapshots.gated(snapshot, calendar).first()["reject_reason"] == reason


def test_gate_wrong_next_and_latest(spark):
    calendar = spark.createDataFrame([(2026, 1, T0), (2026, 2, T0 + dt.timedelta(days=7))], "era int, period int, cutoff timestamp")
    kind = "era int, target int, captured_at timestamp, events array<struct<period:int,is_next:boolean,cutoff:timestamp>>"
    early = T0 - dt.timedelta(hours=1)
    bad = spark.createDataFrame([(2026, 1, early, [(2, True, T0)]), (2026, 1, early, [(1, True, T0 + dt.timedelta(minutes=1))]), (2026, 1, early, [(1, True, T0), (2, True, T0)])], kind)
    assert {r["reject_reason"] for r in snapshots.gated(bad, calendar).collect()} == {"next event isn't the target", "embedded cutoff differs", "not exactly one next event"}
    accepted = spark.createDataFrame([(2026, 1, early, "old"), (2026, 1, early + MICRO, "new")], "era int, period int, captured_at timestamp, id string")
    assert [r["id"] for r in snapshots.latest_accepted(calendar, accepted).orderBy("period").collect()] == ["new", None]
    assert snapshots.calendar_violations(calendar).count() == 0


def test_versions_and_as_of(spark):
    seen = spark.createDataFrame([("p", 1, "a"), ("p", 4, "a"), ("p", 10, "b"), ("p", 12, "a"), ("q", 3, None)], "entity string, gp int, grp string")
    v = identity.versions(seen, ["entity"], "gp", "grp")
    assert rows(v) == sorted([("p", "a", 1, 9), ("p", "b", 10, 11), ("p", "a", 12, None), ("q", None, 3, None)], key=str)
    ask = spark.createDataFrame([("p", 9), ("p", 10), ("p", 99), ("p", 0)], "entity string, gp int")
    found = {r["gp"]: (r["grp"], r["matches"]) for r in identity.as_of(ask, v, ["entity"], "gp", ["grp"]).collect()}
    assert found == {9: ("a", 1), 10: ("b", 1), 99: ("a", 1), 0: (None, 0)}
    back = spark.createDataFrame([("p", 0, "z")], "entity string, gp int, grp string")
    assert identity.backfilled(back, v, ["entity"], "gp").count() == 1


def test_matches_are_never_accepted(spark):
    left = spark.createDataFrame([(1, "Joao Pedro"), (2, "Nobody")], "id int, name string")
    right = spark.createDataFrame([(7, "João Pedro"), (8, "JOAO  PEDRO")], "rid int, rname string")
    got = {r["id"]: (r["candidates"], r["status"]) for r in identity.match_proposals(left, right, left_id="id", left_name="name", right_id="rid", right_name="rname").collect()}
    assert got == {1: ([7, 8], "ambiguous"), 2: ([], "unmatched")}


def test_matches_as_text(spark):
    left = spark.createDataFrame([(1, "Joao Pedro"), (2, "Nobody"), (3, None), (4, "x")], "id int, name string")
    right = spark.createDataFrame([(10, "João Pedro"), (9, "JOAO  PEDRO"), (None, "x"), (5, None)], "rid int, rname string")
    ids = {"left_id": "id", "left_name": "name", "right_id": "rid", "right_name": "rname"}
    got = {r["id"]: (r["candidates"], r["status"]) for r in identity.match_proposals(left, right, **ids, separator=",").collect()}
    assert got == {1: ("9,10", "ambiguous"), 2: ("", "unmatched"), 3: ("", "unmatched"), 4: ("", "unmatched")}
    lists = {r["id"]: (",".join(map(str, r["candidates"])), r["status"]) for r in identity.match_proposals(left, right, **ids).collect()}
    assert got == lists


def test_matches_as_text(spark):
    left = spark.createDataFrame([(1, "Joao Pedro"), (2, "Nobody"), (3, None), (4, "x")], "id int, name string")
    right = spark.createDataFrame([(10, "João Pedro"), (9, "JOAO  PEDRO"), (None, "x"), (5, None)], "rid int, rname string")
    ids = {"left_id": "id", "left_name": "name", "right_id": "rid", "right_name": "rname"}
    got = {r["id"]: (r["candidates"], r["status"]) for r in identity.match_proposals(left, right, **ids, separator=",").collect()}
    assert got == {1: ("9,10", "ambiguous"), 2: ("", "unmatched"), 3: ("", "unmatched"), 4: ("", "unmatched")}
    lists = {r["id"]: (",".join(map(str, r["candidates"])), r["status"]) for r in identity.match_proposals(left, right, **ids).collect()}
    assert got == lists


def make_facts(spark):
    s = spark.createDataFrame(
        [(1, 9, 3, T0 + dt.timedelta(hours=2), 1, 2, 2.0, 4.0, T0 - dt.timedelta(days=1)), (2, 9, 3, T0 + dt.timedelta(hours=9), 3, 1, 5.0, 3.0, T0 - dt.timedelta(days=2)), (3, 9, 3, T0 + dt.timedelta(hours=9), 1, 4, 1.0, 1.0, T0)],
        "occurrence_id int, era int, period int, kickoff timestamp, home int, away int, home_difficulty double, away_difficulty double, available_at timestamp",
    )
    snaps = spark.createDataFrame([(9, 3, "p", 1, T0, T0 - dt.timedelta(hours=2)), (9, 3, "q", 7, T0, T0 - dt.timedelta(hours=2))], "era int, period int, entity string, own_group int, cutoff timestamp, captured_at timestamp")
    outs = spark.createDataFrame([(9, 1, "p", 1, 90, 5), (9, 2, "p", 1, 60, 7)], "era int, occurrence_id int, entity string, own_group int, exposure int, outcome int")
    return s, snaps, outs


def test_multi_and_blank(spark):
    s, snaps, outs = make_facts(spark)
    f = facts.facts(outs, s)
    assert [(r["side"], r["counter_group"], r["problem"]) for r in f.orderBy("occurrence_id").collect()] == [("home", 2, None), ("away", 3, None)]
    c = facts.context(snaps, s)
    assert c.count() == 2  # the third was announced exactly at the cutoff
    assert {r["known_at"] for r in c.collect()} == {T0 - dt.timedelta(hours=2)}
    labelled = facts.labelled(facts.period_rows(snaps, facts.announced(snaps, s)), f)
    got = {r["entity"]: r for r in labelled.collect()}
    assert (got["p"]["y_outcome"], got["p"]["y_exposure"], got["p"]["n_occurrences"], got["p"]["difficulty_mean"], got["p"]["occurrence_ids"]) == (12, 150, 2, 2.5, [1, 2])
    assert (got["q"]["is_blank"], got["q"]["y_outcome"], got["q"]["y_outcome_if_played"], got["q"]["y_played"]) == (True, 0, None, 0)
    one = facts.reconciled(f, labelled).first()
    assert (one["fact_outcome"], one["row_outcome"], one["blanks"], one["multis"], one["keys_with_other_ids"]) == (12, 12, 1, 1, 0)
    assert facts.label_violations(facts.period_rows(snaps, facts.announced(snaps, s)), f).count() == 0
    stray = spark.createDataFrame([(9, 3, "p", 1, 1, 1)], "era int, occurrence_id int, entity string, own_group int, exposure int, outcome int")
    assert facts.label_violations(facts.period_rows(snaps, facts.announced(snaps, s)), facts.facts(stray, s)).first()["rule"] == "occurrence wasn't known"


HISTORY = "entity string, era int, occurrence_id int, kickoff timestamp, completed_at timestamp, available_at timestamp, exposure int, outcome int, stat double"


def make_history(spark, extra=(), late_last=None):
    start = T0 - dt.timedelta(days=30)
    made = []
    for i, (minutes, points) in enumerate(zip((30, 60, 90, 0, 90, 45), range(1, 7))):
        kick = start + dt.timedelta(days=i)
        done = kick + dt.timedelta(hours=3)
        made.append(("p", 1, i, kick, done, late_last if late_last and i == 5 else done, minutes, points, 1.0))
    return spark.createDataFrame([*made, *extra], HISTORY)


def test_last_n(spark):
    cut = spark.createDataFrame([("p", 1, T0), ("debutant", 1, T0)], "entity string, era int, cutoff timestamp")
    got = {r["entity"]: r for r in features.entity_features(make_history(spark), cut, stats=["stat"]).collect()}
    p = got["p"]
    assert (p["exposure_mean_last3"], p["exposure_mean_last5"], p["played_rate_last5"], p["appearances"]) == (45.0, 57.0, 0.8, 5)
    assert (p["outcome_last_appearance"], p["exposure_last_appearance"]) == (6, 45)
    assert p["stat_per90_last5"] == pytest.approx(90 * 5 / (285 + 1e-6))
    assert (got["debutant"]["appearances"], got["debutant"]["exposure_mean_last3"]) == (0, None)


def test_known_exactly_at_the_cutoff_is_late(spark):
    cut = spark.createDataFrame([("p", 1, T0)], "entity string, era int, cutoff timestamp")
    at = features.entity_features(make_history(spark, late_last=T0), cut).first()
    before = features.entity_features(make_history(spark, late_last=T0 - MICRO), cut).first()
    assert (at["exposure_mean_last3"], before["exposure_mean_last3"]) == (60.0, 45.0)


def test_the_future_changes_nothing(spark):
    cut = spark.createDataFrame([("p", 1, T0)], "entity string, era int, cutoff timestamp")
    base = features.entity_features(make_history(spark), cut, stats=["stat"]).collect()
    later = T0 + dt.timedelta(days=1)
    extra = [("p", 1, 50, later, later, later, 90, 99, 9.0), ("p", 2, 51, T0 - dt.timedelta(days=2), T0 - dt.timedelta(days=2), T0 - dt.timedelta(days=2), 90, 99, 9.0)]
    assert features.entity_features(make_history(spark, extra), cut, stats=["stat"]).collect() == base


def test_missing_value_makes_the_frame_missing(spark):
    kick = T0 - dt.timedelta(days=1)
    cut = spark.createDataFrame([("p", 1, T0)], "entity string, era int, cutoff timestamp")
    got = features.entity_features(make_history(spark, [("p", 1, 9, kick, kick, kick, 90, 2, None)]), cut, stats=["stat"]).first()
    assert (got["stat_mean_last5"], got["stat_per90_last5"]) == (None, None) and got["exposure_mean_last3"] == 75.0


def test_trailing_pick_equals_the_join(spark):
    cut = spark.createDataFrame([("p", 1, T0 - dt.timedelta(days=d)) for d in (0, 24, 26, 27, 29, 40)], "entity string, era int, cutoff timestamp")
    fast = {r["cutoff"]: r["exposure_mean_last5"] for r in features.trailing_pick(make_history(spark), cut, "exposure").collect()}
    slow = {r["cutoff"]: r["exposure_mean_last5"] for r in features.entity_features(make_history(spark), cut).collect()}
    assert fast == slow


def test_leaks_are_found(spark):
    late = spark.createDataFrame([(1, T0, T0 - MICRO), (2, T0, T0), (3, T0, None)], "k int, cutoff timestamp, snapshot_captured_at timestamp")
    found = rows(leakage.late_provenance(late, ["k"], ["snapshot_captured_at"], "cutoff"))
    assert found == [(2, "snapshot_captured_at", "not before the cutoff"), (3, "snapshot_captured_at", "is null")]
    assert leakage.forbidden_features(["minutes_mean_last5", "y_points", "actual_points_period"]) == ["y_points", "actual_points_period"]
    proxy = spark.createDataFrame([(float(i), 2.0 * i + 1, float(i % 3), 5.0) for i in range(12)], "t double, copy double, other double, same double")
    assert [(r["feature"], r["target"]) for r in leakage.suspicious_features(proxy, ["copy", "other", "same"], ["t"]).collect()] == [("copy", "t")]
    keys = spark.range(6)
    assert rows(leakage.fit_violations(keys.where("id < 3"), keys.where("id in (0, 1, 4)"), keys.where("id >= 3"), ["id"])) == [(2, "in training but not fitted"), (4, "fitted but not in training"), (4, "held out but fitted")]


def plain_by_force(value):
    base = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w]+", " ", base.casefold()).split())


def test_plain_names(spark):
    names = ["Čech Şükrü Žižek Ğ", "Ødegård-Smith_2", "Straße ẞ", "Kovačić  ő", "ﬁn Ĳ ǆ", "Ǻ ệ İ", "Ｆｕｌｌ １２", "Ζωή Ή", "Ёж", "o'Neil", "Jośe"]
    got = spark.createDataFrame([(n,) for n in names], "v string").select("v", scalars.plain_name(F.col("v")).alias("p")).collect()
    assert {r["v"]: r["p"] for r in got} == {n: plain_by_force(n) for n in names}


def test_plain_names_are_looked_up_by_hash(spark):
    # A pattern of a thousand letters is tried letter by letter: it took 0.2 ms a name.
    plan = spark.range(1).select(scalars.plain_name(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan


def test_as_of_keeps_rows_that_repeat(spark):
    spans = spark.createDataFrame([("a", 1, 5, "x"), ("a", 6, None, "y"), ("b", 1, None, "z"), ("b", 3, None, "w"), (None, 1, None, "n")], "k string, valid_from int, valid_to int, v string")
    asked = spark.createDataFrame([("a", 2, 1), ("a", 2, 1), ("a", 6, 1), ("b", 1, 1), ("b", 3, 1), ("c", 1, 1), (None, 1, 1), ("a", None, 1)], "k string, period int, _n int")
    got = identity.as_of(asked.select("k", "period"), spans, ["k"], "period", ["v"])
    assert rows(got) == sorted([("a", 2, "x", 1), ("a", 2, "x", 1), ("a", 6, "y", 1), ("b", 1, "z", 1), ("b", 3, None, 2), ("c", 1, None, 0), (None, 1, "n", 1), ("a", None, None, 0)], key=str)


def test_resolved_entities(spark):
    aliases = spark.createDataFrame([(1, 1, 5, "a"), (1, 6, None, "b"), (2, 1, None, "c"), (2, 4, None, "d")], "alias int, valid_from int, valid_to int, entity string")
    cases = [(None, None, 1), (1, None, 5), (1, None, 6), (1, "b", 5), (1, "a", 5), (2, None, 4), (3, "z", 1), (None, "z", 1)]
    got = identity.resolved(spark.createDataFrame(cases, "alias int, supplied string, period int"), aliases, alias="alias", supplied="supplied", period="period", entity="entity")
    want = [("no identity", None), (None, "a"), (None, "b"), ("alias of another entity", None), (None, "a"), ("alias not known then", None), ("alias not known then", None), (None, "z")]
    assert rows(got) == sorted([(*c, *w) for c, w in zip(cases, want)], key=str)
    registry = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "a"), ("q", "b"), (None, "c")], "code string, entity string")
    asked = spark.createDataFrame([("p",), ("q",), ("r",), (None,)], "code string")
    assert rows(identity.by_code(asked, registry, "code", "entity")) == sorted([("p", "a", 1), ("q", None, 2), ("r", None, 0), (None, None, 0)], key=str)


def test_registry_violations(spark):
    made = [(1, 5, 4, "code", "exact", None, "x"), (2, 1, None, "manual", "exact", "", "x"), (3, 1, None, "unresolved", "exact", None, None), (4, 1, None, "code", "exact", None, None), (5, 1, 1, "unresolved", "unresolved", None, None)]
    frame = spark.createDataFrame(made, "k int, valid_from int, valid_to int, method string, confidence string, note string, other string")
    got = {(r["k"], r["rule"]) for r in identity.registry_violations(frame, ["k"], foreign_id="other").collect()}
    assert got == {(1, "inverted interval"), (2, "no audit note"), (3, "method and confidence disagree"), (4, "unresolved and the id disagree")}


def test_what_contexts_leave_out_is_reported(spark):
    hour = dt.timedelta(hours=1)
    made = [(1, 1, 1, T0 + hour, 7, 8, T0 - hour, 2, 2), (2, 1, 1, T0, 7, 9, T0 - MICRO, 2, 2), (3, 1, 1, T0 + hour, 9, 7, T0, 2, 2)]
    schedule = spark.createDataFrame(made, "occurrence_id int, era int, period int, kickoff timestamp, home int, away int, available_at timestamp, home_difficulty int, away_difficulty int")
    snapshot = spark.createDataFrame([(1, 1, "e", 7, T0, T0 - hour)], "era int, period int, entity string, own_group int, cutoff timestamp, captured_at timestamp")
    got = {(r["occurrence_id"], r["rule"]) for r in facts.context_violations(snapshot, schedule).collect()}
    assert got == {(2, "starts before the cutoff"), (3, "not announced before the cutoff")}
    assert [r["occurrence_id"] for r in facts.context(snapshot, schedule).collect()] == [1]


def test_row_invariants(spark):
    base = {"era": 1, "period": 1, "cutoff": T0, "captured_at": T0 - MICRO, "known_at": T0 - MICRO, "n_occurrences": 2, "n_home": 1, "occurrence_ids": [1, 2], "is_blank": False}
    made = {"y_outcome": 7, "y_exposure": 60, "y_played": 1, "y_long": 1, "y_high5": 1, "y_high10": 0, "y_outcome_if_played": 7}
    changes = [
        ({}, None),
        ({"captured_at": T0}, "captured after the cutoff"),
        ({"known_at": T0}, "known after the cutoff"),
        ({"occurrence_ids": [1, 1]}, "repeated ids"),
        ({"n_occurrences": 3}, "ids disagree with the count"),
        ({"y_long": 0}, "y_long disagrees"),
        ({"y_high10": 1}, "y_high10 disagrees"),
        ({"y_outcome_if_played": None}, "y_outcome_if_played disagrees"),
    ]
    kind = "entity int, era int, period int, cutoff timestamp, captured_at timestamp, known_at timestamp, n_occurrences long, n_home long, occurrence_ids array<int>, is_blank boolean"
    targets = ", y_outcome long, y_exposure long, y_played int, y_long int, y_high5 int, y_high10 int, y_outcome_if_played long"
    frame = spark.createDataFrame([{"entity": k} | base | made | change for k, (change, _) in enumerate(changes)], kind + targets)
    assert {(r["entity"], r["rule"]) for r in facts.row_violations(frame).collect()} == {(k, rule) for k, (_, rule) in enumerate(changes) if rule}
    empty = {"n_occurrences": 0, "occurrence_ids": [], "is_blank": True}
    blank = spark.createDataFrame([{"entity": 0} | base | made | empty], kind + targets)
    assert {r["rule"] for r in facts.row_violations(blank).collect()} == {"blank with an outcome"}
    assert {r["rule"] for r in facts.row_violations(frame.limit(1).drop("y_played")).collect()} == {"partial targets"}
    assert facts.row_violations(frame.limit(1).select(*(c for c in frame.columns if not c.startswith("y_")))).count() == 0
    contexts = spark.createDataFrame([(1, 1, k, T0 + (MICRO if k == 2 else MICRO * 0), "home", T0 - MICRO * (1 + j * (k == 1))) for k in range(3) for j in range(2 if k < 2 else 1)], "era int, period int, entity int, cutoff timestamp, side string, known_at timestamp")
    got = {(r["entity"], r["rule"]) for r in facts.input_violations(frame.where("entity < 3").withColumn("n_occurrences", F.lit(2)), contexts).collect()}
    home = {(k, "other number of home contexts") for k in (0, 1)}
    assert got == home | {(1, "several instants of knowledge"), (2, "other number of contexts"), (2, "contexts of another cutoff")}


def test_digest_sees_nulls_and_not_order(spark):
    kind = "a string, b string"
    digest = lambda made: files.table_digest(spark.createDataFrame(made, kind)).first()["digest"]
    assert digest([(None, "a")]) != digest([("a", None)]) and digest([("a", "b"), ("c", None)]) == digest([("c", None), ("a", "b")])
    assert digest([("a", "b")]) != digest([("a", "b"), ("a", "b")]) and digest([]) == "0-0-0-0"


@pytest.mark.parametrize("name", ["e_context", "e_context_violations", "e_reconciled", "b_model_rows"])
def test_contexts_of_whole_nations(name):
    from tidemark import plans

    assert "600" not in plans.ORACLE_SQL[name] and "600" in plans.ORACLE_SQL["e_labelled"]


def test_groups_of_a_nation_are_one(spark):
    from tidemark.plans import histories

    groups = [r[0] for r in histories._snapshots(spark, "/root/testdata/sf0.01", nations=True).select("own_group").distinct().collect()]
    assert sorted(groups) == list(range(25))  # 1,500 customers: 75 groups if they were in blocks of 600


def test_reconciled_without_carrying_ids(spark):
    """Ids that are missing, more than the facts, repeated, or those of nobody: the numbers are those of the lists."""
    day, hour = dt.timedelta(days=1), dt.timedelta(hours=1)
    snaps = spark.createDataFrame([(2026, p, e, g, T0, T0 - hour) for p in (1, 2) for e, g in ((1, 5), (2, 6), (3, 7), (4, 8))], "era int, period int, entity long, own_group long, cutoff timestamp_ntz, captured_at timestamp_ntz")
    games = [(2026, 1, k, T0 + k * day, h, a, 1.0, 2.0, T0 - day) for k, h, a in ((1, 5, 6), (2, 5, 7), (3, 7, 7), (4, 6, 5))]
    s = spark.createDataFrame(games, "era int, period int, occurrence_id long, kickoff timestamp_ntz, home long, away long, home_difficulty double, away_difficulty double, available_at timestamp_ntz")
    outs = [(2026, 1, 1, 5), (2026, 2, 1, 5), (2026, 4, 1, 5), (2026, 1, 2, 6), (2026, 1, 2, 6), (2026, 3, 3, 7), (2026, 4, 9, 6)]
    f = facts.facts(spark.createDataFrame([(e, o, k, g, 30, 3) for e, o, k, g in outs], "era int, occurrence_id long, entity long, own_group long, exposure long, outcome long"), s)
    known = facts.announced(snaps, s)
    whole, short = (facts.labelled(facts.period_rows(snaps, known, listed=listed), f) for listed in (True, False))
    one, two = facts.reconciled(f, whole).first(), facts.reconciled(f, short, known).first()
    assert "occurrence_ids" not in short.columns and one == two
    assert (one["keys_with_other_ids"], one["rows_with_repeated_ids"], one["facts_without_row"]) == (2, 1, 1)


def _whole_group(spark, n, m):
    """n snapshots of a group, the first captured at its cutoff, and m occurrences, the first announced then."""
    day, hour = dt.timedelta(days=1), dt.timedelta(hours=1)
    made = [(k, 1, 1, T0 + day, 7, 8, T0 - (day if k else dt.timedelta(0)), 2, 2) for k in range(m)]
    schedule = spark.createDataFrame(made, "occurrence_id int, era int, period int, kickoff timestamp, home int, away int, available_at timestamp, home_difficulty int, away_difficulty int")
    return spark.createDataFrame([(1, 1, e, 7, T0, T0 - (hour if e else dt.timedelta(0))) for e in range(n)], "era int, period int, entity int, own_group int, cutoff timestamp, captured_at timestamp"), schedule


def test_only_what_breaks_a_rule_is_paired(spark):
    def joined(plan):
        own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
        return own + [n for k in range(plan.children().size()) for n in joined(plan.children().apply(k))]

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = facts.context_violations(*_whole_group(spark, 20, 30))
        got = sorted((r["rule"], r["entity"], r["occurrence_id"]) for r in found.collect())
        made = joined(found._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == sorted([("not announced before the cutoff", e, 0) for e in range(20)] + [("captured after the cutoff", 0, k) for k in range(30)])
    assert len(made) == 2 and max(made) == 50  # not the 600 pairs of the group


def test_contexts_come_occurrence_by_occurrence(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = facts.context(*_whole_group(spark, 20, 30)).select("occurrence_id", F.spark_partition_id().alias("task"))
        ids = [r["occurrence_id"] for r in found.collect()]
        assert found.rdd.getNumPartitions() == 4  # as many as the session's shuffles have, however few rows they read
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(ids) == 20 * 29 and sum(a != b for a, b in zip(ids, ids[1:])) == 28


def test_candidates_as_text_are_written_once_a_name(spark, tmp_path):
    """More text than a dictionary of Parquet holds (1 MB), if all names are in one file; far less if they aren't."""
    parts = spark.range(9600).selectExpr("id", "CAST(id % 32 AS STRING) AS name", "id + 1000000000000000000 AS other")
    found = identity.match_proposals(parts, parts, left_id="id", left_name="name", right_id="other", right_name="name", separator=99 * ",")
    texts = {r["n"] for r in found.select(F.length("candidates").alias("n")).collect()}
    found.write.parquet(f"{tmp_path}/out")
    assert len(texts) == 1 and texts.pop() * 32 > 2**20
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 4e6
