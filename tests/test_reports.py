"""Nested documents, NDCG of variants, and decisions of the gate queries."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, reports
from tidemark.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def test_nested_documents(spark):
    rows = spark.createDataFrame([("w2", "b", 1.5, None), ("w2", "a", -0.00004, 2.0), ("w1", "a", 3.0, 4.0)], "fold string, model string, mae double, ndcg double")
    one = reports.document("r", {"folds": reports.nested(rows, "fold", "model", ["mae", "ndcg"]), "best": reports.mapped(rows.where("fold = 'w2'"), "model", "fold"), "n": rows.agg(F.count(F.lit(1)).alias("n"))}).first()
    assert one["report"] == "r"
    assert one["document"] == (
        '{"best":{"a":"w2","b":"w2"},"folds":{"w1":{"a":{"mae":"3.0000","ndcg":"4.0000"}},"w2":{"a":{"mae":"-0.0000","ndcg":"2.0000"},"b":{"mae":"1.5000","ndcg":null}}},"n":3}'
    )
    empty = reports.document("r", {"folds": reports.nested(rows.limit(0), "fold", "model", ["mae"])}).first()
    assert json.loads(empty["document"]) == {"folds": {}}
    with pytest.raises(Exception, match="(?i)duplicate"):
        reports.nested(rows.unionByName(rows), "fold", "model", ["mae"]).collect()


def test_ndcg_of_variants_is_that_of_the_metrics(spark):
    rows = spark.range(300).select((F.col("id") % 4).alias("g"), F.col("id").alias("entity"), (F.col("id") * 7919 % 23 - 3).cast("double").alias("y"), (F.col("id") * 31 % 17).cast("double").alias("p"))
    every = rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("seed")).withColumn("p", F.col("p") * (F.col("seed") - F.col("entity") % 3))
    want = {(r["g"], r["seed"]): r["ndcg"] for r in metrics.ranking_metrics(every, ["g", "seed"], "y", "p", ["entity"]).collect()}
    got = {(r["g"], r["seed"]): r["ndcg"] for r in metrics.ndcg_scores(every, rows, ["g", "seed"], ["g"], "y", "p", ["entity"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_a_model_wins_and_others_do_not(spark):
    decisions = {r["model"]: r["decision"] for r in QUERIES["n_promotion"](spark, DATA).collect()}
    assert decisions["near"] == "KEEP" and "REJECT" in decisions.values()
    assert {r["arm"]: r["verdict"] for r in QUERIES["o_verdicts"](spark, DATA).collect()}["near"] == "SELECTED"
    assert QUERIES["n_confirmed"](spark, DATA).first()["decision"] == "PROMOTE_NEAR"
    assert json.loads(QUERIES["n_direct_report"](spark, DATA).first()["document"])["decision"] == "GO"
