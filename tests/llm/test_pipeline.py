"""The registered queries against their SQL, and each stage of the pipeline against brute force on its own input."""

import hashlib
import importlib.util
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidemark.llm import queries

HERE = Path(__file__).parent
DATA = "/root/testdata/sf0.001"


def helpers(name):
    spec = importlib.util.spec_from_file_location(name, HERE / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "benchmark", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def canonical(frame):
        return sorted(tuple(str(x) if x == x and x is not None else "-" for x in row) for row in frame[columns].itertuples(index=False))

    assert canonical(got) == canonical(want)


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm import mixing, quality
    from tokenizers import Tokenizer

    dedup = helpers("test_dedup")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
        if k < 4:
            assert docs.columns == seen[0].columns
    rows = [{r["doc_id"]: r for r in x.collect()} for x in seen[:4]]

    scores = quality.quality(seen[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert set(rows[1]) == {r["doc_id"] for r in scores.collect() if r["predicted"]}

    groups = dedup.near_by_force([(i, r["text"]) for i, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {i for i, (_, c) in groups.items() if i == c}

    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for i, r in rows[2].items():
        n, hit, _ = dedup.leaks_by_force(r["text"], items)
        assert (i in rows[3]) == (2 * hit <= n)
        if not hit:
            assert rows[3][i]["text"] == r["text"]
        elif i in rows[3]:
            assert len(rows[3][i]["text"]) < len(r["text"]) and rows[3][i]["n_chars"] == len(rows[3][i]["text"])

    rate = {r["source"]: r["rate"] for r in mixing.rates(seen[3], mixing.tempered_weights(seen[3])).collect()}
    want = []
    for i, r in rows[3].items():
        u = int(hashlib.md5(f"1|{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = below = np.exp(-rate[r["source"]])
        times = 0
        while below <= u:
            times += 1
            p *= rate[r["source"]] / times
            below += p
        want += [i] * times
    assert sorted(r["doc_id"] for r in seen[4].collect()) == sorted(want)

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    at = 0
    texts = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    for r, i in zip(sorted(seen[5].collect(), key=lambda r: r["start"]), sorted(want)):
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_run_applies_the_stages_in_order(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows_and_names(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with names that the stages use."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    long = " ".join(f"w{k % 977} w{k % 1013}" for k in range(100_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, long, None, None, len(long)), (-3, "same text", "en", "s", 9), (-3, "same text", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).select(odd.columns).unionByName(odd)
    names = ["copy", "order_key", "u", "times", "spans", "items", "n_words", "dropped_id", "labelled_id", "label", "vector", "score", "node"]
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, docs.limit(0), DATA)
        assert none.count() == 0
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns == none.columns
            kept = {n: {r[0] for r in out.select(n).distinct().collect()} for n in names}
            assert all(v <= {n} for n, v in kept.items())
    near = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert near.where("doc_id is null").count() == 1 and near.where("doc_id = -3").count() == 2 and near.where("doc_id = -2").first()["text"] == long
    cut = corpus_pipeline.remove_benchmark(spark, docs, DATA)
    assert cut.where("doc_id is null and text is null").count() == 1 and cut.where("doc_id = -2").first()["text"] == long
    tokens = corpus_pipeline.write_tokens(spark, docs, DATA)
    assert tokens.count() == docs.count() and tokens.where("doc_id is null").first()["n_tokens"] == 1
