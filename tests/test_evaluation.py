"""Folds, metrics, comparisons, baselines, heads, gates, selection, back-test and files."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import baselines, compare, folds, gates, heads, metrics, regret, select
from tidemark.plans import common
from tidemark.sources import files


def test_period_first_mean(spark):
    made = [(1, 1, k, 0.0, 0.0 if i else 8.0) for i, k in enumerate("a")] + [(1, 2, k, 0.0, 0.0) for k in "abc"]
    df = spark.createDataFrame(made, "era int, period int, entity string, y double, p double")
    own = metrics.ranking_metrics(df, ["era", "period"], "y", "p", ["entity"])
    assert metrics.mean_over_groups(own, [], ["mae"]).first()["mae"] == 4.0


def test_ranking_against_brute_force(spark):
    rng = random.Random(3)
    made = [(g, f"e{k:02d}", float(rng.randint(-2, 9)), float(rng.randint(0, 5))) for g in range(3) for k in range(14)]
    df = spark.createDataFrame(made, "g int, entity string, y double, p double")
    for r in metrics.ranking_metrics(df, ["g"], "y", "p", ["entity"]).collect():
        own = [x for x in made if x[0] == r["g"]]
        by_p, by_y = (sorted(own, key=lambda x: (-x[c], x[1])) for c in (3, 2))
        dcg, ideal = (sum(max(x[2], 0) / np.log2(i + 2) for i, x in enumerate(o[:10])) for o in (by_p, by_y))
        assert r["ndcg"] == pytest.approx(dcg / ideal)
        assert r["top_overlap"] == len({x[1] for x in by_p[:10]} & {x[1] for x in by_y[:10]}) / 10


def test_probabilities(spark):
    made = [(1, "a", 1, 0.9), (1, "b", 0, 0.2), (2, "a", 0, 0.3), (2, "b", 0, 0.1)]
    df = spark.createDataFrame(made, "period int, entity string, y int, p double")
    got = {r["period"]: r for r in metrics.probability_metrics(df, ["period"], "y", "p", ["entity"]).collect()}
    assert np.mean([got[k]["brier"] for k in (1, 2)]) == pytest.approx(0.0375)
    assert (got[1]["roc_auc"], got[2]["roc_auc"], got[1]["pr_auc"], got[2]["pr_auc"]) == (1.0, None, 1.0, None)
    assert sum(r["n"] for r in metrics.calibration_table(df, [], "y", "p").collect()) == 4
    edge = spark.createDataFrame([(1, 0.3), (1, 1.0), (0, 0.30000000000000004)], "y int, p double")
    assert {r["bin"]: r["n"] for r in metrics.calibration_table(edge, [], "y", "p").collect()} == {2: 1, 3: 1, 9: 1}


def test_calibration_line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = rng.random(400) < 1 / (1 + np.exp(-(0.5 + 0.7 * x)))
    df = spark.createDataFrame([(int(b), float(1 / (1 + np.exp(-a)))) for a, b in zip(x, y)], "y int, p double")
    intercept, slope = metrics.calibration_line(df, "y", "p")
    w = np.zeros(2)
    X = np.stack([np.ones(400), x], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-X @ w))
        w -= np.linalg.solve((X * (q * (1 - q))[:, None]).T @ X, X.T @ (q - y))
    assert (intercept, slope) == pytest.approx(tuple(w), abs=1e-4)


def test_folds_never_see_later_rows(spark):
    windows = [folds.EvalWindow(f"w{k}", 2 * k, 2 * k + 1) for k in range(4)]
    df = spark.range(10).withColumnRenamed("id", "ord")  # 8 and 9 lie in no window
    got = folds.expanding_folds(df, windows, "ord")
    for fold in ("w2", "w3"):
        parts = {p: {r["ord"] for r in got.where((F.col("fold") == fold) & (F.col("part") == p)).collect()} for p in ("train", "calibration", "test")}
        assert max(parts["train"]) < min(parts["calibration"]) and max(parts["calibration"]) < min(parts["test"]) and 8 not in parts["test"]
    assert folds.empty_parts(got, windows).count() == 0
    with pytest.raises(ValueError):
        folds.assert_may_select([folds.EvalWindow("c", 0, 1, "confirmation")], ["c"])


def test_walk_forward_hides_targets(spark):
    windows = [folds.EvalWindow(f"w{k}", k, k) for k in range(3)]
    df = spark.createDataFrame([(k, k % 3, float(k), float(2 * k)) for k in range(12)], "entity int, ord int, x double, y double")
    seen = []

    def predictor(train, calibration, test, seed):
        seen.append((train.count(), calibration.count(), test.columns))
        return test.select("entity", (F.col("x") * 2).alias("p"))

    kept = folds.walk_forward(folds.expanding_folds(df, windows, "ord"), predictor, key=["entity"], features=["x"], targets=["y"], retained=["ord"], names=["w2"], seeds=[1, 2])
    assert seen == [(4, 4, ["entity", "x"])] * 2 and kept.count() == 8 and kept.where("p != y").count() == 0


def test_same_rows_and_bootstrap(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, y double")
    b = spark.createDataFrame([(1, 1.0), (2, 5.0), (4, 1.0)], "k int, y double")
    assert sorted(map(tuple, compare.row_differences(a, b, ["k"], ["y"]).collect())) == [(2, "differs"), (3, "extra"), (4, "missing")]
    deltas = spark.createDataFrame([(k, float(k)) for k in range(20)], "period int, delta double")
    r = compare.bootstrap(deltas, ["period"], samples=300).first()
    assert r["mean"] == 9.5 and r["low"] < 9.5 < r["high"] and r["deviation"] == pytest.approx(5.77 / 20**0.5, rel=0.2)


def test_ridge_and_logistic_closed_forms(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(5)
    X = rng.normal(size=(150, 2))
    y = X @ [1.0, -2.0] + 0.3 + rng.normal(size=150)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(c > 0)) for (a, b), c in zip(X, y)], "a double, b double, y double, z double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    got = np.array([r["p"] for r in baselines.ridge(df, df, "y", "p").collect()])
    C = X - X.mean(0)
    w = np.linalg.solve(C.T @ C + 10 * np.eye(2), C.T @ (y - y.mean()))
    assert np.abs(got - (C @ w + y.mean())).max() < 1e-5
    p = np.array([r["q"] for r in baselines.logistic(df, df, "z", "q").collect()])
    z, w, A = (y > 0).astype(float), np.zeros(3), np.c_[X, np.ones(150)]
    R = np.diag([1.0, 1.0, 0.0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-A @ w))
        w -= np.linalg.solve((A * (q * (1 - q))[:, None]).T @ A + R, A.T @ (q - z) + R @ w)
    assert np.abs(p - 1 / (1 + np.exp(-A @ w))).max() < 1e-4
    one = baselines.logistic(df.withColumn("z", F.lit(1.0)), df, "z", "q").select("q").distinct().collect()
    assert [r[0] for r in one] == [1.0]


def test_coherence(spark):
    df = spark.createDataFrame([(0.8, 0.9, 1), (0.5, 0.2, 0), (0.9, 0.5, 2)], "p double, q double, k int")
    made = heads.coherent(p_played=F.col("p"), p_long=F.col("q"), exposure_if_played=F.lit(200.0), outcome_if_played=F.lit(2.0), n_occurrences=F.col("k"), most=F.lit(90))
    got = df.select("k", *(c.alias(n) for n, c in made.items()))
    bad = got.agg(*heads.coherence_counts(p_played=F.col("p_played"), p_long=F.col("p_long"), exposure=F.col("expected_exposure"), n_occurrences=F.col("k"))).first()
    assert sum(bad) == 0


REPORT = "fold string, role string, model string, ndcg double, spearman double, mae double, mean_bias double"


def checks_of(spark, rows, noise=0.01, **options):
    """``fold_checks`` of model a against b; a row is (fold, role, gain, spearman gain, error change, a's bias)."""
    report = [x for f, r, g, s, m, bias in rows for x in ((f, r, "a", 0.5 + g, 0.5 + s, 1.0 + m, bias), (f, r, "b", 0.5, 0.5, 1.0, -0.2))]
    ranges = spark.createDataFrame([(f, m, noise) for f, *_ in rows for m in "ab"], "fold string, model string, range double")
    return gates.fold_checks(spark.createDataFrame(report, REPORT), ranges, "b", ["a"], **options)


GOOD, WITHIN = (0.1, 0.0, 0.0, 0.2), (0.005, 0.0, 0.0, 0.2)


@pytest.mark.parametrize(
    "bad,condition",
    [((0.0, 0.0, 0.0, 0.2), "gains"), (WITHIN, "above_noise"), ((0.1, -0.01, 0.0, 0.2), "spearman_holds"), ((0.1, 0.0, 0.01, 0.2), "error_holds"), ((0.1, 0.0, 0.0, -0.3), "bias_holds")],
)
def test_each_condition_of_a_fold(spark, bad, condition):
    r = checks_of(spark, [("f", "discovery", *bad)]).first()
    assert not r["passed"] and not r[condition]
    assert checks_of(spark, [("f", "discovery", *GOOD)]).first()["passed"]


def test_what_is_missing_passes_nothing(spark):
    rows = [("f", "discovery", *GOOD)]
    assert not checks_of(spark, rows, noise=None).first()["passed"]
    assert checks_of(spark, rows, noise=None, unknown_noise=0.0).first()["passed"]
    low = spark.createDataFrame([("f", "a", -0.1)], "fold string, model string, low double")
    assert not checks_of(spark, rows, intervals=low).first()["interval_holds"] and not checks_of(spark, rows, intervals=low.limit(0)).first()["passed"]
    assert checks_of(spark, rows, intervals=low.withColumn("low", F.lit(0.0))).first()["passed"]
    one = spark.createDataFrame([("f", "discovery", "a", 0.9, None, 1.0, 0.0)], REPORT)
    noise = spark.createDataFrame([("f", "a", 0.0)], "fold string, model string, range double")
    assert not gates.fold_checks(one, noise, "b", ["a"]).first()["passed"]
    assert not gates.fold_checks(one, noise, "b", ["a"], noise_of_both=True).first()["above_noise"]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("f1", "discovery", *GOOD), ("f2", "confirmation", *GOOD)], (True, "passed", "KEEP")),
        ([("f1", "discovery", *GOOD), ("f2", "confirmation", *WITHIN)], (True, "failed", "REJECT")),
        ([("f1", "discovery", *WITHIN), ("f2", "confirmation", *GOOD)], (False, "passed", "REJECT")),
        ([("f1", "discovery", *WITHIN)], (False, "not_available", "REJECT")),
        ([("f1", "discovery", *GOOD)], (True, "not_available", "INCONCLUSIVE")),
        ([("f2", "confirmation", *GOOD)], (False, "passed", "INCONCLUSIVE")),
    ],
)
def test_promotion(spark, rows, want):
    assert tuple(gates.promotion(checks_of(spark, rows)).first()) == want


def test_head_decisions(spark):
    rows = [("k", "f1", "discovery", True), ("k", "f2", "confirmation", True), ("r", "f1", "discovery", True), ("r", "f2", "confirmation", False), ("i", "f1", "discovery", True)]
    got = gates.head_decisions(spark.createDataFrame(rows, "head string, fold string, role string, passed boolean"))
    assert dict(map(tuple, got.collect())) == {"k": "KEEP", "r": "REJECT", "i": "INCONCLUSIVE"}


def test_confirmed_selection(spark):
    kind = "model string, fold string, role string, ndcg_gain double, passed boolean"
    def of(*rows):
        return tuple(gates.confirmed_selection(spark.createDataFrame(list(rows), kind)).first())

    x, y = ("x", "f1", "discovery", 0.2, True), ("y", "f1", "discovery", 0.2, True)
    assert of(x, y, ("y", "f2", "confirmation", 0.1, True)) == ("y", 0.2, "passed", "PROMOTE_Y")  # the larger name on a tie
    assert of(x, ("x", "f2", "confirmation", 0.1, False)) == ("x", 0.2, "failed", "KEEP_BASE")
    assert of(x) == ("x", 0.2, "not_available", "KEEP_BASE")
    assert of(("x", "f1", "discovery", 0.2, False), ("x", "f2", "confirmation", 0.1, True)) == (None, None, "not_applicable", "KEEP_BASE")


def test_arm_gates(spark):
    rows = [(m, f, g, 1.0, p) for m, g, p in (("x", 2.0, True), ("y", 2.0, True), ("z", -1.0, False), ("v", 0.1, False)) for f in ("f1", "f2")]
    checks = spark.createDataFrame(rows, "model string, fold string, ndcg_gain double, noise_floor double, passed boolean")
    gate = gates.candidate_gate(checks)
    chosen = gates.selected_arm(gate, "base")
    assert chosen.first()["selected"] == "y"
    verdicts = gates.ablation_verdicts(gate, chosen)
    assert {r["arm"]: r["verdict"] for r in verdicts.collect()} == {"x": "NOT_SELECTED", "y": "SELECTED", "z": "REJECT", "v": "INCONCLUSIVE"}
    assert gates.negative_results(verdicts).count() == 3
    exact = spark.createDataFrame([("y", 0.1), ("y", -0.1), ("x", -0.1), ("z", None)], "arm string, delta double")
    assert {r["arm"] for r in gates.candidate_gate(checks, exact).where("passed").collect()} == {"x"}
    assert gates.selected_arm(gate.where("arm = 'z'"), "base").first()["selected"] == "base"
    assert not gates.base_gate(checks.limit(0)).first()["passed"] and gates.base_gate(checks.where("passed")).first()["passed"]


def test_confirmation_needs_all_nine(spark):
    low = spark.createDataFrame([("f", "a", 0.0)], "fold string, model string, low double")
    checks = checks_of(spark, [("f", "confirmation", *GOOD)], intervals=low)
    yes, no = (spark.createDataFrame([(v,)], "passed boolean") for v in (True, False))
    observed = yes.select((~F.col("passed")).alias("confirmation_observed"))

    def decided(**other):
        parts = {"selection": observed, "discovery": yes, "calibration": yes, "audit": yes} | other
        return gates.confirmation_gate(gates.confirmation_checks(parts.pop("checks", checks), **parts)).first()

    assert decided()["decision"] == "PROMOTE" and len(decided()) == 11
    for name, failed in (("discovery", "discovery_passed"), ("calibration", "calibrated"), ("audit", "reproducible")):
        for bad in (no, no.limit(0)):
            assert (decided(**{name: bad})["decision"], decided(**{name: bad})["failed"]) == ("HOLD", [failed])
    assert decided(selection=observed.withColumn("confirmation_observed", F.lit(True)))["failed"] == ["selected_on_discovery_only"]
    assert decided(checks=checks_of(spark, [("f", "confirmation", 0.1, -0.1, 0.1, 0.3)], intervals=low))["failed"] == ["confirmation_spearman_holds", "confirmation_error_holds", "confirmation_bias_holds"]


def test_bootstrap_by_group(spark):
    rows = spark.createDataFrame([(g, k, float(k * (1 if g == "a" else 3))) for g in "ab" for k in range(6)], "g string, k int, delta double")
    both = {r["g"]: r for r in compare.bootstrap(rows, ["k"], by=["g"], samples=200).collect()}
    alone = compare.bootstrap(rows.where("g = 'a'"), ["k"], samples=200).first()
    assert all(both["a"][c] == alone[c] for c in ("mean", "groups", "low", "high")) and abs(both["b"]["low"] - 3 * both["a"]["low"]) < 1e-9
    assert compare.bootstrap(rows.limit(0), ["k"]).first()["groups"] == 0


KIND = "portfolio int, entity string, position string, club int, score double, p_played double, p_long double, exposure double, actual double, actual_exposure double"


def squads(n=25, seed=2):
    rng = random.Random(seed)
    for s in range(n):
        for i in range(15):
            position = "G" if i < 2 else "D" if i < 7 else "M" if i < 12 else "F"
            yield s, f"p{i + 1:02d}", position, i % 5, float(rng.randint(0, 6)), 0.9, 0.8, 72.0, float(rng.randint(0, 9)), rng.choice([0.0, 90.0, 90.0])


def legal(names):
    count = {p: sum(x == p for x in names) for p in "GDMF"}
    return all(low <= count[p] <= high for p, (low, high) in select.RANGES.items())


def test_line_up_is_the_best_of_all(spark):
    made = list(squads())
    got = {r["portfolio"]: r for r in select.best_line_up(spark.createDataFrame(made, KIND), ["portfolio"]).collect()}
    for s in got:
        own = [x for x in made if x[0] == s]
        best = min((-sum(x[4] for x in c), sorted(x[1] for x in c)) for c in itertools.combinations(own, 11) if legal([x[2] for x in c]))
        assert (-got[s]["line_up_score"], got[s]["line_up"]) == best


def test_roles(spark):
    made = [(1, f"p{i + 1:02d}", "G" if i < 2 else "D" if i < 7 else "M" if i < 12 else "F", i % 5, float(i + 1), 0.9, 0.8, 72.0, 0.0, 90.0) for i in range(15)]
    for shuffled in (made, made[::-1]):
        got = select.decided(spark.createDataFrame(shuffled, KIND), ["portfolio"]).collect()
        assert {r["formation"] for r in got} == {"3-4-3"} and sum(r["score"] for r in got if r["starter"]) == 104.0
        assert [r["entity"] for r in sorted((x for x in got if not x["starter"]), key=lambda x: x["reserve_order"])] == ["p08", "p04", "p03", "p01"]
        assert [r["entity"] for r in got if r["lead"]] == ["p15"] and [r["entity"] for r in got if r["deputy"]] == ["p14"]
    even = [(*x[:4], 5.0, *x[5:]) for x in made]
    got = select.decided(spark.createDataFrame(even, KIND), ["portfolio"]).collect()
    assert [r["entity"] for r in got if r["lead"]] == ["p01"] and [r["entity"] for r in got if r["deputy"]] == ["p03"]
    assert select.portfolio_violations(spark.createDataFrame(made, KIND), ["portfolio"]).count() == 0


def by_the_rules(own, order="reserve_order"):
    points = sum(r["actual"] for r in own if r["starter"] and r["actual_exposure"] > 0)
    keeper = next(r for r in own if r["starter"] and r["position"] == "G")
    second = next(r for r in own if not r["starter"] and r["position"] == "G")
    if keeper["actual_exposure"] == 0 and second["actual_exposure"] > 0:
        points += second["actual"]
    field = [r["position"] for r in own if r["starter"] and r["position"] != "G"]
    absent = sorted((r["entity"], r["position"]) for r in own if r["starter"] and r["position"] != "G" and r["actual_exposure"] == 0)
    for r in sorted((x for x in own if not x["starter"] and x["position"] != "G" and x["actual_exposure"] > 0), key=lambda x: x[order]):
        for a in absent:
            after = list(field)
            after.remove(a[1])
            after.append(r["position"])
            if legal(["G", *after]):
                field, points = after, points + r["actual"]
                absent.remove(a)
                break
    return points


def test_substitutions_follow_the_rules(spark):
    rows = spark.createDataFrame(list(squads(60, 9)), KIND)
    decisions = select.decided(rows, ["portfolio"]).cache()
    got = {r["portfolio"]: r["points"] for r in regret.substituted(decisions, ["portfolio"]).collect()}
    own = {}
    for r in decisions.collect():
        own.setdefault(r["portfolio"], []).append(r)
    assert got == {s: by_the_rules(x) for s, x in own.items()}
    best = {r["portfolio"]: r["best_points"] for r in regret.best_reserve_order(decisions, ["portfolio"]).collect()}
    assert all(best[s] >= got[s] for s in got)


def test_perfect_forecast_has_no_regret(spark):
    made = [(*x[:4], x[8], *x[5:9], 90.0) for x in squads(5, 4)]
    for r in regret.backtest(spark.createDataFrame(made, KIND), ["portfolio"], {"perfect": "score"}).collect():
        assert r["line_up_regret"] == 0 and r["lead_regret"] == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,n\nx,1\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), ["name", "n"]).collect()[0]["name"] == "x"
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["name", "gone"])
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('{"events": [{"id": 1}]}')
    (tmp_path / "j" / "2.json").write_text("nonsense")
    (tmp_path / "j" / "3.json").write_text('{"teams": []}')
    got = sorted(r["problem"] or "" for r in files.read_json(spark, str(tmp_path / "j"), "events array<struct<id:int>>", ["events"]).collect())
    assert got == ["", "isn't JSON of this form", "no list events"]
    frame = spark.range(5).toDF("k")
    files.write_once(frame, str(tmp_path / "t"))
    assert files.read_checked(spark, str(tmp_path / "t")).count() == 5
    with pytest.raises(Exception):
        files.write_once(frame, str(tmp_path / "t"))
    frame.write.mode("append").parquet(str(tmp_path / "t" / "data"))
    with pytest.raises(ValueError):
        files.read_checked(spark, str(tmp_path / "t"))
    found = files.manifest(spark, str(tmp_path / "j" / "*.json"), {"source": "s"})
    assert found.count() == 3 and files.manifest_violations(found, found).count() == 0
    files.write_report(frame, str(tmp_path / "r.csv"), order=["k"])
    with pytest.raises(Exception):
        files.write_report(frame, str(tmp_path / "r.csv"))


def test_fits_cover_all_folds(spark, monkeypatch):
    from tidemark.plans import QUERIES, evaluation

    data = "/root/testdata/sf0.001"
    tested = sorted(r["entity"] for r in evaluation.folded(spark, data).where("part = 'test'").select("entity").collect())
    assert sorted(r["entity"] for r in QUERIES["l_linear_models"](spark, data).collect()) == tested
    options = []

    def regressor(train, calibration, test, label, name, **own):
        options.append(own)
        return test.withColumn(name, F.col(label))

    def classifier(train, frames, label, name, **own):
        options.append(own)
        return [x.withColumn(name, F.lit(0.5)) for x in frames]

    monkeypatch.setattr(evaluation.heads, "boosted_regressor", regressor)
    monkeypatch.setattr(evaluation.heads, "boosted_classifier", classifier)
    assert sorted(r["entity"] for r in QUERIES["m_boosted_heads"](spark, data).collect()) == tested
    assert sorted(x["seed"] for x in options) == [7] * 8 + [42] * 8 and all(x["config"] == evaluation.CONFIG for x in options)


@pytest.mark.parametrize("slices", [2, 7, 64])
def test_ranks_of_slices_are_those_of_the_group(spark, slices):
    import random

    from tidemark.operators import metrics

    rng = random.Random(slices)
    data = [(g, float(rng.choice([1, 2, 3, rng.randrange(90), rng.random()]))) for g in ("a", "b", None) for _ in range(120)] + [("one", 1.0)] * 5
    got = {(r["g"], r["v"]): (r["rank"], r["n"]) for r in metrics.average_ranks(spark.createDataFrame(data, "g string, v double"), ["g"], "v", slices).collect()}
    want = {}
    for g in {x[0] for x in data}:
        own = sorted(v for h, v in data if h == g)
        want |= {(g, v): (own.index(v) + (own.count(v) + 1) / 2, own.count(v)) for v in own}
    assert got == want


def test_no_window_holds_all_rows_of_a_group(spark):
    from tidemark.operators import heads, metrics

    rows = spark.range(50).selectExpr("int(2000 + id % 2) AS era", "int(id % 3) AS period", "id AS entity", "double(id % 7) AS y", "double(id % 5) AS p", "double(id % 3) AS q", "int(id % 2) AS z")
    by = ["era", "period"]
    for frame in (metrics.ranking_metrics(rows, by, "y", "p", ["entity"]), metrics.probability_metrics(rows, by, "z", "p", ["entity"]), heads.blend_weight(rows, ["era"], ["entity"], "y", "p", "q")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        ranks = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
        assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") == len(ranks) and "Window [rank(" not in plan


def test_walk_forward_joins_orders_once(spark):
    from tidemark import plans

    plan = plans.QUERIES["h_walk_forward"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "l_orderkey" not in plan  # eight fits read a written table


@pytest.mark.parametrize("key", [["id"], ["id", "half"]])
def test_first_rows_of_large_groups(spark, key, monkeypatch):
    """No group's rows are sorted to find its first ones, and ties, nulls and NaN stand where a sort puts them."""
    monkeypatch.setattr(metrics, "LARGE", 100)
    n = F.col("n")
    rows = spark.range(30_000).withColumnRenamed("id", "n").select(
        F.when(n < 29_000, n % 3).otherwise(F.when(n < 29_990, F.lit(None)).otherwise(7)).alias("g"),  # two groups of all sizes, a null one, a small one
        F.when(n % 3 == 0, F.lit(0.5)).when(n % 3 == 1, (n * 7919 % 10_007) / 100).when(n % 3 == 2, F.when(n < 400, 2.0).when(n % 2 == 0, 1.0)).alias("v"),
        F.when(n % 9_001 != 0, n * 104_729 % 30_011).alias("id"), (n % 2).alias("half"),
    )
    rows = rows.withColumn("v", F.when(F.col("id") % 9_999 == 5, float("nan")).otherwise(F.col("v")))
    for k in (1, 10, 20):
        got = metrics.first_rows(rows, ["g"], "v", key, k, "r").collect()
        want = metrics.ranked(rows, ["g"], "v", key, "r").where(F.col("r") <= k).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    large = metrics.contenders(rows, ["g"], "v", key, 10)
    assert 40 <= large.count() < 600
    assert metrics.first_rows(rows.drop("g"), [], "v", key, 3, "r").count() == 3


def test_tasks_grow_in_number_with_the_lines(spark, monkeypatch):
    data = "/root/testdata/sf0.001"

    def rows(made):
        return {(r["era"], r["period"], r["entity"]): (r["y"], r["p"], r["q"]) for r in made.collect()}

    made = (common.scored, common.chances)
    want = [rows(f(spark, data)) for f in made]
    assert common.tasks(spark.read.parquet(f"{data}/lineitem.parquet")) is None  # a small table stays as it is
    monkeypatch.setattr(common, "TASK_ROWS", 500)
    n = -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 500)
    for f, own in zip(made, want):
        dealt = f(spark, data)
        assert dealt.rdd.getNumPartitions() == n > 4
        got = rows(dealt)
        assert got.keys() == own.keys() and all(got[k] == pytest.approx(own[k]) for k in own)
