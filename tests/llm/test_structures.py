"""Exact search, conversation repair and the prefix trie, against brute force and their SQL."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import pivot_search, prefix_trie, queries, repair

DATA = "/root/testdata/sf0.001"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def odd_conversations(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, long texts, a long conversation, extra columns."""
    rng = random.Random(7)
    rows = [
        (rng.choice([None, *range(-7, 30)]), rng.choice([None, *range(6)]), rng.choice([None, "", "user", "assistant", "system", "tool"]), rng.choice([None, "", " \t\x0b", "a.", "b", "ü! ", "word " * rng.randrange(3)]))
        for _ in range(400)
    ]
    rows += [(70, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(300)] + [(71, 0, "user", "x" * 200_000)] + [(c, 0, "user", "same.") for c in range(100, 140)]
    rows += rows[:60]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], CONVERSATIONS + ", depth long, x string"), rows


# --- exact search ---------------------------------------------------------------------------------


def nearest_by_force(rows, every, k=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(kept):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(kept) if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("annulus", [4, 1024])
def test_search_on_odd_vectors(spark, monkeypatch, annulus):
    monkeypatch.setattr(pivot_search, "ANNULUS", annulus)
    rng = random.Random(5)
    one = lambda: rng.choice([0.1, 0.5, -0.3, None if rng.random() < 0.03 else 0.2, float("nan") if rng.random() < 0.03 else 0.0])
    rows = [(rng.choice([None, *range(40)]), None if rng.random() < 0.05 else [one() for _ in range(rng.choice([0, 3, 3, 3, 4]))]) for _ in range(300)]
    rows += [(i, [0.1, 0.2, 0.3]) for i in range(150)] + [(3, [float("inf"), 1.0, 1.0])]  # many copies of one vector
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double")
    assert sorted(map(tuple, pivot_search.nearest(df, every=7).collect())) == nearest_by_force(rows, 7)
    assert pivot_search.nearest(df.limit(0)).count() == 0


def test_search_in_clusters_leaves_annuli_out(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "ANNULUS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.01 * rng.normal(size=8)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    visited = []
    whole = pivot_search.written

    def watched(table, name):
        out = whole(table, name)
        if name in ("next", "rest"):
            visited.append(out.count())
        return out

    monkeypatch.setattr(pivot_search, "written", watched)
    assert sorted(map(tuple, pivot_search.nearest(df, every=50).collect())) == nearest_by_force(rows, 50)
    assert sum(visited) < 24 * 75 / 2  # of 24 queries and 75 annuli at least


def test_products_of_large_numbers_are_exact():
    q, x = np.array([[2.0**30 + 1, 3.0]]), np.array([[2.0**31 + 1, 5.0]])
    assert pivot_search.products(q, x)[0, 0] == (2**30 + 1) * (2**31 + 1) + 15


# --- repair ---------------------------------------------------------------------------------------


def edits_by_force(kinds):
    """The least (cost, edits) by uniform-cost search over rows used and state."""
    arcs = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in best:
            continue
        best[at, state] = (cost, audit)
        for (p, role), q in arcs.items():
            if p != state:
                continue
            if role != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", at, q))
            if at < len(kinds) and kinds[at] != "-":
                more = kinds[at].isupper()
                if kinds[at].lower() == role:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, q))
                if role != "s":
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, q))
        if at < len(kinds):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
    return min(best[len(kinds), s] for s in (0, 3) if (len(kinds), s) in best)


def cells_by_all_splits(kinds):
    """Textbook CYK: every span, every split."""
    n = len(kinds)
    table = {(i, i + 1): repair.parsed(k) for i, k in enumerate(kinds)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            found = [repair.combined(table[i, k], table[k, i + length]) for k in range(i + 1, i + length)]
            table[i, i + length] = tuple(min((c[x] for c in found if c[x] is not None), default=None) for x in range(len(repair.PAIRS)))
    return table[0, n] if n else repair.EMPTY


def test_edits_are_least_and_all_splits_agree():
    rng = random.Random(3)
    for _ in range(1500):
        kinds = "".join(rng.choice("sSuUaAoO-") for _ in range(rng.randrange(12)))
        assert repair.least(repair.parsed(kinds)) == edits_by_force(kinds), kinds
        if len(kinds) < 8:
            assert repair.parsed(kinds) == cells_by_all_splits(kinds)


def repairs_by_force(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        own = convs[c]
        if code:
            x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
            own += [(t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        seen, faults = set(), []
        for _, r, x in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", x)
            faults.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((r, x))
        cost, audit = edits_by_force("".join(repair.kind_of(r[:1], f) for (_, r, _), f in zip(own, faults)))
        lines, rest, expected = [], iter(own), "user"
        for letter in audit:
            _, r, x = next(rest) if letter != "I" else (None, expected, "")
            if letter != "D":
                role = r if letter == "K" else expected
                lines.append(f"{role}:{x}")
                expected = "assistant" if role[0] == "u" else "user"
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"most_rows": 3, "block": 5}, {"most_bytes": 10, "block": 1}])
def test_repairs(spark, sizes):
    df, rows = odd_conversations(spark)
    want = repairs_by_force(rows)
    got = repair.repairs(df.repartition(5), **sizes)
    assert got.columns == repair._NAMES
    assert sorted(map(tuple, got.collect()), key=str) == want
    turns = collections.defaultdict(list)
    for r in sorted(repair.repaired_turns(repair.damaged(df), **sizes).collect(), key=lambda r: r["number"]):
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(turns[w[0]]).encode()).hexdigest() == w[-1] for w in want)
    assert repair.repairs(df.limit(0), **sizes).count() == 0


def test_repair_without_damage(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "u."), (1, 2, "assistant", "a."), (2, 0, "assistant", "a."), (3, None, None, None)]
    got = {r["conv_id"]: r for r in repair.repaired(repair.undamaged(spark.createDataFrame(rows, CONVERSATIONS))).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "KKK")
    assert (got[2]["cost"], got[2]["audit"]) == (2, "IK")
    assert (got[3]["cost"], got[3]["audit"], got[3]["blank"]) == (3, "D", 1)


# --- trie -----------------------------------------------------------------------------------------


def trie_by_force(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [z[2:] for z in sorted(own)] for c, own in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    nodes, below = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    for p in nodes:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = sum(saved[k] for k in below[p]) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if built[c] == p))) for p, m in nodes.items()}
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()), key=str)


@pytest.mark.parametrize("piece", [2, 4096])
def test_trie(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "_SHIFT", piece.bit_length() - 1)
    df, rows = odd_conversations(spark)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df.repartition(6)).collect()), key=str) == trie_by_force(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(df.where("conv_id IS NULL")).count() == 0


def test_trie_of_conversations_without_turns(spark):
    absent = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:4]
    rows = [(c, 0, "user", "gone") for c in absent if c - c % 5 not in absent]
    got = list(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()))
    assert sorted(got, key=str) == trie_by_force(rows) and len(got) == 1 and got[0][4:7] == (0, 1, 0)


def test_products_compose():
    rng = np.random.default_rng(1)
    turns = [rng.integers(0, 1 << 31, 4, dtype=np.uint64) % prefix_trie.MODULUS for _ in range(9)]

    def product(run):
        out = [np.zeros(1, np.uint64)] * 4
        for t in run:
            out = prefix_trie.combined(out, [t[i : i + 1] for i in range(4)], np.array([1]))
        return out

    for cut in range(10):
        both = prefix_trie.combined(product(turns[:cut]), product(turns[cut:]), np.array([9 - cut]))
        assert all((a == b).all() for a, b in zip(both, product(turns)))
    last = [turns[-1][i : i + 1] for i in range(4)]
    assert all((a == b).all() for a, b in zip(prefix_trie.parents(product(turns), last), product(turns[:-1])))


def test_trie_tries_another_seed(spark, monkeypatch):
    df, rows = odd_conversations(spark)
    whole, seeds = prefix_trie._turns, []

    def colliding(conversations, seed):
        seeds.append(seed)
        out = whole(conversations, seed)
        return out.selectExpr("conv_id", "turn", "role", "text", "h1 % 3 AS h1", "0L AS h2", "n_bytes") if seed == 0 else out

    monkeypatch.setattr(prefix_trie, "_turns", colliding)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=str) == trie_by_force(rows) and seeds == [0, 1]


@pytest.mark.parametrize("name", ["op11_pivot_search", "op12_repair", "op13_prefix_trie"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    assert found.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.fetchall(), key=str)
