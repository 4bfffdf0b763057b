"""Held-out accuracy of the classifiers, and their defined results for odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality, toxicity
from tidemark.llm.labelled import fit_sigmoid

DATA = "/root/testdata/sf0.01"
ODD = [(None, None), (-1, ""), (-2, "   "), (-3, "12 34"), (-4, "word " * 40_000), (-5, "\n\n"), (-5, "\n\n")]


def with_odd(spark, frame):
    odd = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.unionByName(odd).withColumn("score", F.lit("clash"))


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def accuracy(got, labels, column):
    both = got.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    return np.mean([a == b for a, b in both])


def test_toxicity(spark):
    docs = with_odd(spark, read(spark, "documents"))
    got = toxicity.toxicity(docs, read(spark, "labels")).cache()
    assert got.count() == 1007 and got.where("score is null or score < 0 or score > 1").count() == 0
    for r in got.sample(0.1, 1).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
    bad = ["idiot", "moron", "loser", "stupid", "scum"]
    rng = random.Random(0)
    words = [f"{a}{b}" for a in ("th", "er", "on", "an") for b in ("in", "ed", "at", "es", "ou")]
    made = [(k, " ".join(rng.choice(words) if rng.random() > 0.05 * (k % 2) else rng.choice(bad) for _ in range(120))) for k in range(600)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, toxic int")
    assert accuracy(toxicity.toxicity(df, labels), labels, "toxic") > 0.95


def naive_ratio(texts, labels):
    """Log-ratio a character of each text, from the definitions: Counters of every sequence, no hashing, no joins."""
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    spelt = lambda w: [f" {w} "[max(0, j - 3) : j + 1] for j in range(1, len(w) + 2)]
    types, own = Counter(), (Counter(), Counter())
    for w in {w for ws in words for w in ws}:
        types.update(spelt(w))
    for ws, label in zip(words, labels):
        for w in set(ws) if label is not None else ():
            for g in spelt(w):
                own[label][g] += round(1024 * min(1, 200 / len(set(ws)))) / 1024
    level = []
    for k in (1, 2, 3):
        n = Counter()
        for g, t in types.items():
            if len(g) >= k:
                n[g[-k:]] += t
        level.append(n)

    def shared(g):
        if not g:
            return 1 / len(level[0])
        found = level[len(g) - 1]
        after = {x: c for x, c in found.items() if x[:-1] == g[:-1]}
        return (found[g] - 0.75 + 0.75 * len(after) * shared(g[1:])) / sum(after.values())

    def p(g, label):
        after = {x: c for x, c in own[label].items() if x[:-1] == g[:-1]}
        if not after:
            return shared(g[-3:])
        return (max(own[label][g] - 0.75, 0) + sum(min(c, 0.75) for c in after.values()) * shared(g[-3:])) / sum(after.values())

    ratio = {g: math.log(p(g, 1) / p(g, 0)) for g in types}
    out = []
    for ws in words:
        all_ = [g for w in ws for g in spelt(w)]
        out.append(sum(ratio[g] for g in all_) / len(all_) if all_ else 0.0)
    return out


def test_toxicity_against_the_definitions(spark):
    rng = random.Random(3)
    letters = ["ab", "ba", "é", "ж", "語", "𝒳", "x1"]
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(rng.choice([1, 5, 400]))) for _ in range(60)] + [None, "", "?!"]
    labels = {k: int(rng.random() < 0.4) for k in range(60)}
    learned = {k for k in labels if zlib.crc32(str(k).encode()) % 5}
    ids = spark.createDataFrame([(k,) for k in learned], "doc_id long").where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0)
    learned = {r[0] for r in ids.collect()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    want = naive_ratio(texts, [labels[k] if k in learned else None for k in range(len(texts))])
    for most in (0, 1 << 20):  # by joins, and by the broadcast table
        got = {r["doc_id"]: r["log_ratio"] for r in toxicity.toxicity(docs, marked, max_broadcast=most).collect()}
        assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-9)


def test_toxicity_reads_long_texts_in_pieces():
    text = "Aa-bb " * (toxicity.PIECE // 4)
    assert toxicity.spelled(text) == {"aa": toxicity.PIECE // 4, "bb": toxicity.PIECE // 4}
    assert toxicity.spelled("語" * 150 + " ok") == {"語" * 64: 2, "語" * 22: 1, "ok": 1}


def test_toxicity_without_labels(spark):
    none = read(spark, "labels").limit(0)
    got = toxicity.toxicity(read(spark, "documents").limit(20), none)
    assert got.count() == 20 and got.select("score").distinct().count() == 1
    assert toxicity.toxicity(read(spark, "documents").limit(0), none).count() == 0


def plain_vector(text):
    """FEATURES of one text by the definitions, byte by byte."""
    raw = (text or "").encode()
    kinds = [sum(c in own for c in raw) for own in (range(65, 91), range(48, 58))]
    stop, space, other = (sum(c in own for c in raw) for own in (b".,;:'\"()-?", b"\t\n\x0b\x0c\r ", range(128, 256)))
    small = sum(97 <= c <= 122 for c in raw)
    symbol = len(raw) - sum(kinds) - stop - space - other - small
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    w, n = len(words), len(raw)
    marks = [bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:'\"()-?"]
    root = math.sqrt
    return [
        *(root(k / (n + 60)) for k in (*kinds, symbol, stop, space, other)),
        math.log(n + 1), math.log(w + 1), math.log((n + 60) / (w + 10)), math.log((w + 10) / (len(lines) + 1)),
        root((w - len(set(words))) / (w + 10)),
        root(max(0, w - 1 - len({(a, b) for a, b in zip(words, words[1:])})) / (w + 10)),
        root(sum(a == b for a, b in zip(words, words[1:])) / (w + 10)),
        root((len(lines) - len(set(lines))) / (len(lines) + 3)),
        root(sum(any(x.endswith(m) for m in marks) for x in words) / (w + 10)),
    ]


def test_quality_vectors_against_the_definitions(spark):
    texts = [None, "", " ", "One two, TWO two.\nline 3\nline 3\n\n$$$ x% y& z*", "é語 ab\tcd " * 50, *(r["text"] for r in read(spark, "documents").limit(40).collect())]
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = quality.vectors(np.frombuffer(b"".join(raw), np.uint8), off)
    assert np.allclose(got, [plain_vector(t) for t in texts])


def test_quality_of_no_documents(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    assert quality.quality(docs.limit(0), labels).count() == 0 and quality.accepted(docs.limit(0), labels).count() == 0
    clash = docs.limit(50).withColumn("label", F.lit("x")).withColumn("vector", F.lit(1)).withColumn("labelled_id", F.lit(2))
    assert quality.accepted(clash, labels).columns == clash.columns and quality.accepted(clash, labels.limit(0)).count() == 50


def test_quality(spark):
    docs, labels = with_odd(spark, read(spark, "documents")), read(spark, "labels")
    got = quality.quality(docs, labels).cache()
    assert got.count() == 1007 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert accuracy(got, labels, "quality") > 0.95
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 1").count()
    assert quality.accepted(docs, labels.limit(0)).count() == 1007


def test_discriminant_is_the_gaussian_ratio():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    own = [rng.normal(k, 1 + k, (500, d)) for k in (0, 1)]
    model = quality.Discriminant(np.stack([np.concatenate([[len(x)], x.sum(0), (x.T @ x).reshape(-1)]) for x in own]))
    x = rng.normal(size=(20, d))
    pooled = sum((y - y.mean(0)).T @ (y - y.mean(0)) for y in own) / 1000
    logs = []
    for y in own:
        cov = 0.9 * np.cov(y.T, bias=True) + 0.1 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(pooled) + 1e-4) + 1e-6 * np.eye(d)
        z = x - y.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(x), logs[1] - logs[0])


def test_languages(spark):
    docs = with_odd(spark, read(spark, "documents"))
    got = langid.languages(docs).cache()
    assert got.count() == 1007 and got.where("score is null or score < 0 or score > 1").count() == 0
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (None, -1, -2, -3, -5)) and rows[-4]["lang_pred"] != "und"
    both = got.join(read(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in both]) > 0.97
    nothing = langid.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.where("lang_pred != 'und'").count() == 0
    assert langid.languages(docs.limit(0)).count() == 0


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(2)
    members = [rng.integers(0, 1 << 62, 5000).astype(np.uint64) for _ in range(3)]
    rows, wrong = langid.build_filter(members)
    for k, codes in enumerate(members):
        mask = np.bitwise_and.reduce([rows[p] for p in langid.places(codes)])
        assert ((mask >> np.uint64(k)) & np.uint64(1)).all()
    other = rng.integers(0, 1 << 62, 200_000).astype(np.uint64)
    mask = np.bitwise_and.reduce([rows[p] for p in langid.places(other)])
    assert abs((mask & np.uint64(1)).mean() - wrong[0]) < 1e-3


def learned_ids(count, held_out):
    return [i for i in range(20 * count) if (zlib.crc32(str(i).encode()) % langid.MOD == langid.HELD_OUT) == held_out][:count]


def test_every_language_is_learned(spark):
    texts = [" ".join("".join(chr(0x4E00 + 40 * k + (i * j + j) % 40) for j in range(1, 7)) for i in range(1, 12)) for k in range(70)]
    rows = [(i, texts[n // 2], f"l{n // 2:02}") for n, i in enumerate(learned_ids(140, False))] + [(i, texts[n], None) for n, i in enumerate(learned_ids(70, True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.languages(df).where("held_out").collect()}
    assert [got[i] for i in learned_ids(70, True)] == [f"l{n:02}" for n in range(70)]


def test_every_gram_is_learned(spark):
    rng = random.Random(7)
    text = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(70_000))
    rows = [(i, text, "zh") for i in learned_ids(2, False)] + [(learned_ids(1, True)[0], text, None)]
    (got,) = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert got["lang_pred"] == "zh" and got["score"] > 0.999


def test_filter_grows_and_is_the_same_in_spark(spark):
    assert langid.filter_size(0) == langid.filter_size(149_000) == langid.ROWS and langid.filter_size(1_000_000) == 1 << 24
    rng = np.random.default_rng(8)
    members = [rng.integers(0, 1 << 62, 300).astype(np.uint64) for _ in range(64)]
    df = spark.createDataFrame([(k, c) for k, own in enumerate(members) for c in own.tolist()], "k long, code long")
    rows, wrong = langid.build_filter(members)
    filled, found = langid.summed_filter(df, 64, langid.ROWS)
    assert (filled[0] == rows).all() and np.allclose(found, wrong)


def test_languages_against_plain_sets(spark):
    """The decision without any filter: sets of n-grams by the definition, in plain Python."""
    rng = random.Random(21)
    syllables = {lang: ["".join(rng.choices(letters, k=2)) for _ in range(9)] for lang, letters in (("aa", "abcde"), ("bb", "abcfg"), ("cc", "жзи語"))}
    ids = sorted(learned_ids(90, False) + learned_ids(60, True))
    rows = []
    for k, i in enumerate(ids):
        lang = "aabbcc"[2 * (k % 3) :][:2]
        other = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang if rng.random() < 0.8 else other], k=3)) for _ in range(12)), lang if rng.random() < 0.9 else None))
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2}

    def grams(text):
        own = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
        return Counter(own[k : k + n] for n in (2, 3, 4) for k in range(len(own) - n + 1))

    counts = {lang: Counter() for lang in syllables}
    for i, text, lang in rows:
        if i not in held and lang:
            counts[lang] += grams(text)
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = {lang: {g: n / total[lang] for g, n in c.items()} for lang, c in counts.items()}
    members = {lang: {g for g, n in c.items() if n >= 2 and share[lang][g] >= 0.5 * max(s.get(g, 0) for s in share.values())} for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, text, _ in rows:
        own = grams(text)
        found = {lang: sum(n for g, n in own.items() if g in members[lang]) for lang in members}
        best = min(found, key=lambda lang: (-found[lang], lang))
        assert got[i]["held_out"] == (i in held) and got[i]["lang_pred"] == best and abs(got[i]["score"] - found[best] / sum(own.values())) < 1e-3


@pytest.mark.parametrize("slope", [0.5, 4.0])
def test_calibration_fit(slope):
    rng = np.random.default_rng(3)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(slope * x - 1)))).astype(float)
    a, b = fit_sigmoid(x, y, np.ones(20_000))
    assert abs(a - slope) < 0.25 and abs(b + 1) < 0.15


def test_a_filter_kept_as_a_table_decides_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(900001, None, "en"), (900002, "", None), (900003, "123 !?", "de"), (900004, "a", None), (900005, "word " * 50_000, "en"), (None, "the river and the town", "fr"), (900005, "x", "zz")], docs.schema)
    both = docs.unionByName(odd)
    many = both.unionByName(docs.where("doc_id < 70").selectExpr("doc_id + 800000 AS doc_id", "text", "concat('l', doc_id) AS lang"))  # more than 64 languages
    for table in (both, many, docs.where("lang IS NULL"), docs.limit(0)):
        one, two = (sorted(map(tuple, langid.languages(table, min_count=1, max_words=w).collect()), key=str) for w in (1 << 24, 1))
        assert [r[:3] for r in one] == [r[:3] for r in two]
        assert np.allclose([r[3] for r in one], [r[3] for r in two], atol=1e-12)
