"""Scans with a minimum contract, sinks that never overwrite, and manifests of what was stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """All columns as text. A required column that is missing is an error before anything is read or stored; a byte order mark doesn't count."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    frame = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    missing = sorted(set(required) - set(frame.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def read_json(spark: SparkSession, path: str, schema: str, lists: Sequence[str] = ()) -> DataFrame:
    """(path, payload, problem): whole files parsed by a schema; unreadable ones and those without a required list have a problem."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    kind = T._parse_datatype_string(schema)
    kind.add("_corrupt_record", "string")
    parsed = raw.withColumn("payload", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("path", "payload", payload_problem(F.col("payload"), lists).alias("problem"))


def payload_problem(payload: Column, lists: Sequence[str]) -> Column:
    problem = F.when(payload["_corrupt_record"].isNotNull(), "isn't JSON of this form")
    for name in lists:
        problem = problem.when(payload[name].isNull(), f"no list {name}")
    return problem


def element_violations(parsed: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """(path, list, ordinal, problem) of elements of a payload's lists that lack one of their fields; ordinals count from 1, and an element that isn't an object lacks all."""
    found = []
    for name, wanted in fields.items():
        each = parsed.select("path", F.posexplode(F.col("payload")[name]).alias("ordinal", "x"))
        lacks = F.array(*(F.when(F.col("x").isNull() | F.col("x")[f].isNull(), f"no {f}") for f in wanted))
        found.append(each.select("path", F.lit(name).alias("list"), (F.col("ordinal") + 1).alias("ordinal"), F.explode(lacks).alias("problem")).where("problem IS NOT NULL"))
    return reduce(DataFrame.unionByName, found)


def picks_violations(squads: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, problem) of payloads (picks: array of element, position, is_lead, is_deputy): 15 different elements in slots 1..15, one lead, another deputy."""
    picks = squads.select(*by, F.explode_outer("picks").alias("p")).select(*by, "p.*")
    own = picks.groupBy(*by).agg(
        F.count("element").alias("n"),
        F.count_distinct("element").alias("distinct"),
        F.array_sort(F.collect_list("position")).alias("slots"),
        F.count_if(F.col("is_lead")).alias("leads"),
        F.count_if(F.col("is_deputy")).alias("deputies"),
        F.count_if(F.col("is_lead") & F.col("is_deputy")).alias("both"),
    )
    rules = {
        "not 15 picks": F.col("n") != 15,
        "repeated element": F.col("distinct") != F.col("n"),
        "slots aren't 1..15": ~F.transform("slots", lambda x: x.cast("int")).eqNullSafe(F.sequence(F.lit(1), F.lit(15))),
        "not one lead": F.col("leads") != 1,
        "not one deputy": F.col("deputies") != 1,
        "lead is deputy": F.col("both") > 0,
    }
    return own.select(*by, F.explode(F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules.items())))).alias("problem"))


def manifest(spark: SparkSession, path: str, identity: dict[str, str]) -> DataFrame:
    """(path, sha256, n_bytes, artifact_id) of stored files; the artifact id is the digest of the sorted identity and the content's digest."""
    files = spark.read.format("binaryFile").load(path)
    return with_artifact_id(files.select("path", F.sha2("content", 256).alias("sha256"), "length"), identity)


def with_artifact_id(contents: DataFrame, identity: dict[str, str]) -> DataFrame:
    fields = sorted([*identity, "sha256"])
    text = F.to_json(F.struct(*(F.col("sha256") if f == "sha256" else F.lit(identity[f]).alias(f) for f in fields)))
    return contents.select("path", "sha256", F.col("length").cast("long").alias("n_bytes"), F.sha2(text, 256).alias("artifact_id"))


def manifest_violations(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): files that are gone or differ from the manifest."""
    now = found.select("path", F.col("sha256").alias("_sha"), F.col("n_bytes").alias("_n"))
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("n_bytes") != F.col("_n"), "other size").when(F.col("sha256") != F.col("_sha"), "other content")
    return stored.join(now, "path", "left").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def new_artifacts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows to append: a known artifact isn't stored again."""
    return new.dropDuplicates(["artifact_id"]).join(existing, "artifact_id", "left_anti")


def collisions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Artifacts of the same id with another content."""
    old = existing.select("artifact_id", F.col("sha256").alias("_sha"))
    return new.join(old, "artifact_id").where(F.col("sha256") != F.col("_sha")).drop("_sha")


def table_digest(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each ``by``): the number of rows, the column names, and a digest that doesn't depend on the order of rows: the sums, modulo 2^64, of the four parts of every row's SHA-256. A row is its columns as JSON, NULLs included."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in frame.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = [F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) % F.lit(str(1 << 64)).cast("decimal(38,0)") for x in parts]
    counts = [F.count(F.lit(1)).alias("rows"), F.lit(",".join(frame.columns)).alias("columns"), F.concat_ws("-", *(x.cast("decimal(20,0)").cast("string") for x in sums)).alias("digest")]
    return frame.groupBy(*by).agg(*counts) if by else frame.agg(*counts)


def write_set(frame: DataFrame, path: str, by: str) -> DataFrame:
    """One folder for each value of ``by`` (a study's arms, say), and an index of them with rows and digest, made of what was written. An existing set is an error. Gives the index."""
    frame.write.mode("errorifexists").partitionBy(by).parquet(f"{path}/data")
    index = table_digest(_set_rows(frame.sparkSession, path, frame.columns, frame.schema[by].dataType, by), [by])
    index.coalesce(1).write.mode("errorifexists").parquet(f"{path}/index")
    return frame.sparkSession.read.parquet(f"{path}/index")


def _set_rows(spark: SparkSession, path: str, columns: Sequence[str], kind: T.DataType, by: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data").withColumn(by, F.col(by).cast(kind)).select(*columns)


def set_violations(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(by, problem) of a set's parts: missing, not in the index, or with other rows than when they were written."""
    index = spark.read.parquet(f"{path}/index")
    columns = index.first()["columns"].split(",")
    now = table_digest(_set_rows(spark, path, columns, index.schema[by].dataType, by), [by])
    both = index.select(by, F.col("rows").alias("_rows"), F.col("digest").alias("_digest")).join(now, by, "full_outer")
    problem = F.when(F.col("rows").isNull(), "missing").when(F.col("_rows").isNull(), "not in the index").when(F.col("rows") != F.col("_rows"), "other number of rows").when(F.col("digest") != F.col("_digest"), "other content")
    return both.select(by, problem.alias("problem")).where("problem IS NOT NULL")


def read_set(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The whole set, after each part was compared with the index."""
    bad = set_violations(spark, path, by).orderBy(by).take(5)
    if bad:
        raise ValueError(f"{path} isn't what was written: " + "; ".join(f"{r[0]} is {r[1]}" if r[1] in ("missing", "not in the index") else f"{r[0]} has {r[1]}" for r in bad))
    index = spark.read.parquet(f"{path}/index")
    return _set_rows(spark, path, index.first()["columns"].split(","), index.schema[by].dataType, by)


def write_once(frame: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """A Parquet table and its digest beside it; an existing table is an error."""
    writer = frame.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
    table_digest(frame.sparkSession.read.parquet(f"{path}/data").select(*frame.columns)).coalesce(1).write.mode("errorifexists").json(f"{path}/meta")


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """The table, after its rows, columns and digest were compared with what was written."""
    meta = spark.read.json(f"{path}/meta").first()
    frame = spark.read.parquet(f"{path}/data").select(*meta["columns"].split(","))
    now = table_digest(frame).first()
    if (now["rows"], now["digest"]) != (meta["rows"], meta["digest"]):
        raise ValueError(f"{path} isn't what was written")
    return frame


def write_report(frame: DataFrame, path: str, *, order: Sequence[str] = ()) -> None:
    """CSV or JSON by the path's suffix, in order; never over an existing report."""
    out = frame.orderBy(*order) if order else frame
    if path.endswith(".csv"):
        out.write.mode("errorifexists").option("header", True).csv(path)
    elif path.endswith(".json"):
        out.write.mode("errorifexists").json(path)
    else:
        raise ValueError("a report is .csv or .json")
