"""Sets with an index, elements of payloads, flags, spot checks, and evidence on probabilities."""

import glob
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, gates
from tidemark.sources import files, scratch


def test_a_damaged_part_is_named(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = spark.range(60).select("id", (F.col("id") % 4).cast("int").alias("arm"), F.when(F.col("id") % 7 != 0, F.col("id") * 2).alias("x"))
    index = files.write_set(rows, path, "arm")
    assert {r["arm"]: r["rows"] for r in index.collect()} == {k: 15 for k in range(4)}
    back = files.read_set(spark, path, "arm")
    assert back.columns == rows.columns and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_set(rows, path, "arm")

    def part(frame, arm, mode):
        frame.where(F.col("arm") == arm).drop("arm").write.mode(mode).parquet(f"{path}/data/arm={arm}")

    kept = rows.cache()
    kept.count()
    part(kept.withColumn("x", F.col("x") + (F.col("id") == 5).cast("int")), 1, "overwrite")  # one value
    part(kept.where("id <> 6"), 2, "overwrite")  # one row
    shutil.rmtree(glob.glob(f"{path}/data/arm=3")[0])
    part(kept.withColumn("arm", F.lit(9)), 9, "overwrite")
    got = {r["arm"]: r["problem"] for r in files.set_violations(spark, path, "arm").collect()}
    assert got == {1: "other content", 2: "other number of rows", 3: "missing", 9: "not in the index"}
    with pytest.raises(ValueError, match="1 has other content; 2 has other number of rows; 3 is missing; 9 is not in the index"):
        files.read_set(spark, path, "arm")


def test_elements(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"events": [{"id": 1, "name": "x"}, {"id": 2}, null, {"name": "y"}], "teams": []}')
    (tmp_path / "b.json").write_text("{")
    parsed = files.read_json(spark, str(tmp_path), "events array<struct<id:int,name:string>>, teams array<struct<id:int>>", ["events", "teams"])
    assert sorted(r["problem"] or "" for r in parsed.collect()) == ["", "isn't JSON of this form"]
    got = sorted((r["list"], r["ordinal"], r["problem"]) for r in files.element_violations(parsed, {"events": ["id", "name"], "teams": ["id"]}).collect())
    assert got == [("events", 2, "no name"), ("events", 3, "no id"), ("events", 3, "no name"), ("events", 4, "no id")]


def test_flags(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, True), (2, None, 1.0, True), (3, 1.0, 1.0, False), (4, None, None, False), (5, 1.0, 1.0, None)], "entity int, a double, b double, flag boolean")
    got = {r["entity"]: r["problem"] for r in gates.flag_violations(rows, ["entity"], ["a", "b"], "flag").collect()}
    assert got == {2: "flagged though a signal is missing", 3: "not flagged though all signals are there", 5: "no flag"}


def test_spot_checks(spark):
    frame = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "entity int, v string")
    cases = spark.createDataFrame([("single", 1), ("multi", 2), ("new", 3)], "case string, entity int")
    got = {r["case"]: r["problem"] for r in features.spot_check_violations(features.spot_checks(frame, cases, ["entity"])).collect()}
    assert got == {"multi": "several rows", "new": "no row", "flagged": "absent", "moved": "absent"}


def test_probability_evidence(spark):
    rows = spark.range(400).select(F.col("id").alias("entity"), F.lit(2000).alias("era"), (F.col("id") % 4).alias("period"), (F.col("id") % 10 < 3).cast("int").alias("y"), F.when(F.col("id") % 10 < 3, 0.6).otherwise(0.2).alias("p"), F.lit(0.3).alias("base"), F.lit(1).alias("always"))
    one, two = gates.probability_evidence(rows, {"a": ("y", "p", "base"), "b": ("always", "p", "base")}, ["entity"]).orderBy("head").collect()
    assert one["passed"] and one["delta"] == pytest.approx(one["brier"] - one["base_brier"]) and one["slope"] > 0
    assert one["brier"] == pytest.approx(0.3 * 0.16 + 0.7 * 0.04) and one["calibration_error"] == pytest.approx(0.3 * 0.4 + 0.7 * 0.2)
    assert two["intercept"] is None and two["slope"] is None


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://x"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Cluster()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda name, other: other)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.shared_root(Session())
    assert scratch.stored(spark.range(3), "x").count() == 3
