"""Exact and near duplicates, and decontamination, against brute force on small tables."""

import hashlib
import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, near_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


@pytest.mark.parametrize("limit", [1, 3000, 1 << 20])
def test_exact_groups(spark, limit):
    rng = random.Random(1)
    texts = [(i, rng.choice(["", None, "Hello", "hELLO", "É", "é", "x" * 500, *map(str, range(40))])) for i in range(300)]
    got = exact_dedup.exact_groups(table(spark, texts).repartition(5), local_bytes=limit, table_bytes=limit).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    assert len(got) == 300
    for r in got:
        key = (dict(texts)[r["doc_id"]] or "").translate(UPPER)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(groups[key]), len(groups[key]), r["doc_id"] == max(groups[key]))
        assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()


def test_exact_odd_rows(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "A", 2), (3, "b", 3), (None, "b", 4), (5, "c", 5), (5, "c", 6)], "doc_id long, text string, kept int")
    got = sorted(map(tuple, exact_dedup.exact_groups(df).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, None, 2, True)] * 2 + [(3, 3, 2, True), (None, 3, 2, False)] + [(5, 5, 2, True)] * 2, key=str)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
    assert exact_dedup.deduplicated(df.where("doc_id > 2")).columns == ["doc_id", "text", "kept"]


def test_table_compares_contents():
    table_ = exact_dedup.ContentTable(1 << 20)
    same = b"\0" * 32  # every digest collides
    for k in range(3000):
        assert table_.add(same, str(k % 1500).encode(), k, 1)
    assert len(table_.contents) == 1500 and set(table_.counts) == {2}


def near_by_force(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    at = {i: i for i, _ in texts}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(at)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_groups(spark, size, percent):
    rng = random.Random(size)
    texts = [None, "", " ", "one", "One", "two words", "two  WORDS"]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 160))]
        texts += [edited(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(1, 6))]
    base = [f"t{k}" for k in range(140)]
    texts += [edited(rng, base, rng.randint(0, 7)) for _ in range(90)]  # a group too large to pair up
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in near_dedup.near_groups(table(spark, rows).repartition(3), shingle=size, percent=percent).collect()}
    for i, (n, component) in near_by_force(rows, size, percent).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, component == i)


def test_members_that_only_meet_at_a_hub(spark):
    core = [f"w0x{j}" for j in range(90)]  # the third text is in each list of the other two, and linked with neither
    rows = [(k, " ".join(core + [f"{name}0y{j}" for j in range(n)])) for k, (name, n) in enumerate((("a", 10), ("b", 10), ("h", 15)))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(table(spark, rows), shingle=1).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_links_that_no_hub_has(spark):
    """Trios whose hub shares the lists of the other two but is linked with neither; in half of them the other two are linked."""
    rng = random.Random(11)
    rows = []
    for k in range(340):
        cut, extra = (94, 12) if k % 2 else (rng.randrange(60, 120), rng.randrange(6, 20))
        z, b, c, e = ([f"{name}{k}x{j}" for j in range(n)] for name, n in (("z", 189), ("b", extra), ("c", extra), ("e", 27)))
        split = z[:cut] + b + z[cut:]
        rows += [(3 * k + 1, " ".join(split + c + e)), (3 * k + 2, " ".join(split)), (3 * k + 3, " ".join(z + c))]
    want = {}
    for k in range(0, len(rows), 3):
        want |= near_by_force(rows[k : k + 3], 3, 85)
    assert len({c for _, c in want.values()}) not in (340, 1020)
    got = near_dedup.near_groups(table(spark, rows), shingle=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    one = rows[:3]
    got = near_dedup.near_groups(table(spark, one), shingle=3, percent=85).collect()  # no pair of the table is found by a hub
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_by_force(one, 3, 85)


def test_templates_below_the_threshold(spark):
    """Many texts share most of a page with one hub and differ in places of their own; some of them are linked."""
    rng = random.Random(12)
    page = [f"t{k}" for k in range(300)]
    rows = []
    for k in range(60):
        own, at = [f"o{k}x{j}" for j in range(rng.choice([20, 45, 80]))], rng.randrange(250)
        text = page[:at] + own + page[at:]
        rows += [(4 * k + j, " ".join(text[: len(text) - drop])) for j, drop in enumerate(rng.sample([0, 10, 30, 55], rng.randint(1, 3)))]
    rows.append((-1, " ".join(page)))
    got = near_dedup.near_groups(table(spark, rows), shingle=3, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_by_force(rows, 3, 85)


def test_sets_with_one_first_half_are_told_apart(spark):
    signed = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 1), (5, None, None)], "doc_id long, node long, half long")
    clashes = near_dedup._clashes(signed)
    got = {r["doc_id"]: r["node"] for r in near_dedup._told_apart(signed, clashes).collect()}
    assert got[1] == got[3] and len({got[1], got[2], got[4]}) == 3 and got[4] == 8 and got[5] is None
    assert near_dedup._clashes(signed.where("half = 1")) is None


def test_near_groups_of_long_texts(spark):
    rng = random.Random(13)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, edited(rng, long, 50)), (3, " ".join(long[:150_000]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(table(spark, rows), shingle=3, percent=85).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_near_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, text, 1), (4, text, 2), (2, text.upper(), 3), (2, text, 4), (9, None, 5)], "doc_id long, text string, kept int")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(df).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 2, False), (2, 2, True), (2, 2, True), (9, 9, True)], key=str)
    assert near_dedup.near_groups(df.limit(0)).count() == 0
    kept = near_dedup.distinct_documents(df)
    assert kept.columns == df.columns and kept.count() == 4


def test_threshold_misses_less_than_promised():
    for percent in (80, 85):
        t = near_dedup.match_threshold(percent)
        rng = random.Random(4)
        assert all(sum(rng.random() < percent / 100 for _ in range(near_dedup.COORDINATES)) >= t for _ in range(20_000))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks_by_force(text, items, window=10):
    words = WORD.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for name, item in items:
        own = WORD.findall((item or "").translate(UPPER))
        n = min(window, len(own))
        wins = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1):
            if wins and tuple(words[k : k + n]) in wins:
                found.add(name)
                hit |= set(range(k, k + n))
    return len(words), len(hit), sorted(found)


def test_contamination(spark):
    rng = random.Random(8)
    items = [("7", " ".join(rng.choice("abcde") for _ in range(30))), ("10", "A b; c d e a b c d e, a b"), ("3", "z"), ("5", "q r s"), ("6", ""), ("8", None), ("9", "Élan vital 3 4")]
    items += [(str(20 + k), " ".join(f"v{rng.randrange(60)}" for _ in range(rng.randint(1, 25)))) for k in range(20)]
    texts = [None, "", "...", "z", "Q R  s and élan Vital 3 4"]
    for _ in range(60):
        made = [rng.choice("abcdezx") if rng.random() < 0.5 else f"v{rng.randrange(60)}" for _ in range(rng.randint(1, 60))]
        item = rng.choice(items)[1] or ""
        made.insert(rng.randrange(len(made)), item)
        texts.append(", ".join(made))
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = list(enumerate(texts))
    for block in (1 << 20, 300):  # one automaton, and several
        got = {r["doc_id"]: r for r in decontaminate.contamination(table(spark, rows), bench, block_bytes=block).collect()}
        for i, t in rows:
            assert (got[i]["n_words"], got[i]["n_hit"], list(got[i]["items"])) == leaks_by_force(t, items)


def test_automaton_is_small():
    rng = random.Random(9)
    items = [(str(k), [f"w{rng.randrange(3000)}".encode() for _ in range(50)]) for k in range(400)]
    tracemalloc.start()
    automaton = decontaminate.SuffixAutomaton(items, 10)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 60 * sum(len(w) + 1 for _, own in items for w in own) and len(automaton.link) > 20_000


def test_decontaminated_text(spark):
    item = " ".join(f"i{k}" for k in range(12))
    around = " ".join(f"o{k}" for k in range(40))
    df = table(spark, [(1, f"{around}. {item.upper()}! {around}"), (2, item), (3, around), (4, None)]).withColumn("spans", F.lit(1))
    out = decontaminate.decontaminated(df, spark.createDataFrame([(1, item)], "item_id int, text string"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == df.columns and set(got) == {1, 3, 4}
    assert got[1]["text"] == f"{around}. ! {around}" and got[1]["n_chars"] == len(got[1]["text"]) and got[3]["text"] == around and got[4]["text"] is None
    several = decontaminate.decontaminated(df, spark.createDataFrame([(1, item), (2, "x y z " * 9), (3, "p q " * 9)], "item_id int, text string"), block_bytes=60)
    assert {r["doc_id"]: r["text"] for r in several.collect()} == {i: r["text"] for i, r in got.items()} and several.columns == df.columns
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.decontaminated(df, none).count() == 4
    assert decontaminate.decontaminated(df.limit(0), none).count() == 0 and decontaminate.contamination(df.limit(0), none).count() == 0


def test_items_of_equal_words_are_read_in_proportion():
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        automaton = decontaminate.SuffixAutomaton([("a", [b"x"] * n)], 10)
        assert automaton.hits([0] * n) == ([(0, n)], {"a"})
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_near_copies_give_a_link_a_node(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [base[:at] + [f"x{at}"] + base[at + 1 :] for at in range(0, 400, 2)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    counts = []
    monkeypatch.setattr(near_dedup, "components", lambda links, own=near_dedup.components: counts.append(links.count()) or own(links))
    assert near_dedup.near_groups(docs).where("component_id = 0").count() == 200
    assert counts and max(counts) <= 200  # several hubs a node gave several times that


def test_components_leave_out_settled_links(spark, monkeypatch):
    rng = random.Random(4)
    star = [(min(500, k), max(500, k)) for k in range(1000) if k != 500]
    way = rng.sample(range(2000, 3000), 40)  # as nodes are digests, in no order
    path = [tuple(sorted(x)) for x in zip(way, way[1:])]
    loose = [tuple(sorted(rng.sample(range(3000, 3060), 2))) for _ in range(40)] + [(4000, 4000)]
    at = {}

    def root(k):
        while at.setdefault(k, k) != k:
            k = at[k]
        return k

    for a, b in star + path + loose:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    gone = []
    monkeypatch.setattr(near_dedup, "written", lambda df, name, own=near_dedup.written: (made := own(df, name), gone.append((name, made.count())))[0])
    table_ = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    found = near_dedup.components(table_(star + path + loose))
    assert dict(map(tuple, found.collect())) == {k: root(k) for k in at}
    links = [n for name, n in gone if name == "links"]
    assert len(links) < 9
    assert links == sorted(links, reverse=True) and links[-1] == 0 and sum(links) < len(star + path + loose)
    grown = near_dedup._grown(near_dedup.components(table_(star + path)), table_([*star, (7, way[9]), (8, 9), (5000, 6000), (999, 5000)]))
    want = {k: 0 for a, b in star + path for k in (a, b)} | {5000: 0, 6000: 0}
    assert dict(map(tuple, grown.collect())) == want


def test_texts_that_share_a_half_are_no_pairs(spark, monkeypatch):
    rng = random.Random(14)
    core = [f"c{k}" for k in range(104)]  # two sets share 100 of 100 + 2 * 50: enough for their lists, far from linked
    texts = [core + [f"o{k}x{j}" for j in range(50)] for k in range(60)]
    texts += [edited(rng, texts[0], 1).split(" ") for _ in range(3)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    made = []
    monkeypatch.setattr(near_dedup, "written", lambda df, name, own=near_dedup.written: (out := own(df, name), made.append((name, out.count())))[0])
    got = near_dedup.near_groups(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_by_force(rows, 5, 80)
    assert sum(n for name, n in made if name == "pairs") < 60


def test_sketches_miss_less_than_promised():
    rng = near_dedup.np.random.default_rng(5)
    for percent in (80, 85):
        n, least = 1000, near_dedup.sketch_threshold(percent)
        own = 2 * percent * n // (100 + percent) + 1  # of two sets of n
        for _ in range(40):
            codes = rng.integers(0, 1 << 63, 2 * n - own, dtype="uint64")
            one, two = near_dedup._sketches(near_dedup.np.concatenate([codes[:n], codes[n - own :]]), near_dedup.np.array([0, n]))
            differ = sum(int(x).bit_count() for x in (one ^ two).view("uint64"))
            assert near_dedup.SKETCH - differ >= least
