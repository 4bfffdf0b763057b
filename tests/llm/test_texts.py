"""Main text, token files, URL lists and mixing."""

import datetime as dt
import hashlib
import math
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, mixing, token_store, url_filter
from tidemark.llm.queries import tokenizer_path

LONG = "The story of the river and of the town that it made is a long one, and it is told by those who live there."
LONG_2 = "It was in the spring of that year that they built the first bridge, and with it came the roads and the trade."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p><script>var a='<p>no</p>'</script><p>{LONG_2}</p></article><footer>(c)</footer></body></html>", f"Title\n{LONG}\nShort.\n{LONG_2}"),
        (f"<body><div class='sidebar'>{LONG}</div><div id=main><p>{LONG}<p>A &amp; B&#33; <b>bold</b>\n text</p><p>{LONG_2}</div><div class='comments'><p>{LONG}</p></div>", f"{LONG}\nA & B! bold text\n{LONG_2}"),
        (f"<body><header>{LONG}</header><form><p>{LONG}</p></form><aside>{LONG}</aside><p>{LONG}</p><ul><li><a href=1>One link here</a></li><li><a href=2>Another link there</a></li></ul>", LONG),
        (f"<article><p>{LONG}<!-- <p>gone</p> --><p>{LONG_2}</p><p>cut &am", f"{LONG}\n{LONG_2}\ncut &am"),
        (f"<article><div class='ad'>Buy it now, {LONG}</div><p>{LONG}</p><section class='user-comments'><p>{LONG_2}</p></section></article>", LONG),
        (f"<header><h2>{LONG}</h2></header><article class=post><header><h1>Title</h1></header><p>{LONG}</p></article><article class='comment c1'><p>{LONG_2}</p></article>", f"Title\n{LONG}"),
        ("just text <", "just text <"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


RUSSIAN = "Это длинная история о реке и о городе, который она создала, и её рассказывают те, кто живёт там до сих пор."
FIGURES = " ".join(["12.5 13.7"] * 9)


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article><p data-x=it's>{LONG}</p><p>More. It's done.</p></article>", f"{LONG}\nMore. It's done."),
        (f"<article>x</article><div><p>{LONG}</p><p>{LONG_2}</p></div>", f"x\n{LONG}\n{LONG_2}"),
        (f"<div><p>{RUSSIAN}</p><p>{RUSSIAN}</p></div>", f"{RUSSIAN}\n{RUSSIAN}"),
        (f"<p>{'これは川と町についての長い物語です。' * 6}</p>", "これは川と町についての長い物語です。" * 6),
        (f"<body><div id='main-header-wrapper'><p>{LONG}</p><table><tr><td>{FIGURES}</td></tr></table><p>{LONG_2}</p></div>", f"{LONG}\n{FIGURES}\n{LONG_2}"),
        (f"<article><p>{LONG}</p><table><tr><td>{FIGURES}</td></tr></table></article>", f"{LONG}\n{FIGURES}"),
        (f'<main title="a > b" data-y=>{LONG}</main>', LONG),
    ],
)
def test_pages_that_are_easily_lost(page, text):
    assert html_text.main_text(page) == text


class Plain(HTMLParser):
    """The text of well-formed pages with an article, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK:
            self.blocks.append("")
        if tag not in html_text.VOID:
            self.open.append(f"{tag} {dict(attrs).get('class', '')}")

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.blocks.append("")
        self.open.pop()

    def handle_data(self, data):
        names = {x for name in self.open for x in name.split()}
        if "article" in names and not names & {"nav", "footer", "aside", "script", "style", "form", "comments", "ad"}:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_random_pages_against_another_parser():
    rng = random.Random(5)

    def part(depth):
        kind = rng.choice(["p", "p", "h2", "ul", "div", "table", "pre", "drop"])
        body = rng.choice([LONG, LONG_2, "Short &amp; <b>bold</b>\n line.", f"{LONG} <a href='x'>a link</a> <i class=it's>{LONG_2}</i>"])
        if kind == "drop":
            return rng.choice([f"<aside>{LONG}</aside>", f"<div class='ad'>{LONG}</div>", "<script>if (a < b) { '</p>' }</script>", f"<form><p>{LONG}</p></form>", f"<section class='comments'><p>{LONG_2}</p></section>"])
        if kind == "ul":
            return f"<ul>{''.join(f'<li>{body}</li>' for _ in range(rng.randint(1, 3)))}</ul>"
        if kind == "table":
            return f"<table><tr><td>{body}</td><td>17.5</td></tr></table>"
        if kind == "div" and depth < 4:
            return f'<div data-k="a>b">{"".join(part(depth + 1) for _ in range(rng.randint(1, 3)))}</div>'
        return f"<{kind if kind != 'div' else 'p'}>{body}</{kind if kind != 'div' else 'p'}>"

    for _ in range(300):
        inner = "".join(part(0) for _ in range(rng.randint(1, 8)))
        page = f"<html><head><title>t</title></head><body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>{LONG}</p>{inner}</article><footer>(c) {LONG}</footer></body></html>"
        plain = Plain()
        plain.feed(page)
        assert html_text.main_text(page) == plain.text(), page


def test_stray_ends_are_read_in_proportion():
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_text.main_text("<div>" * n + "</p>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_no_pages(spark):
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>É {LONG}</p></article>", "x"), (1, "u", None, "x"), (None, None, "", "x")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extracted(df).collect()), key=str)
    assert got == sorted([(1, "u", f"É {LONG}", len(LONG) + 2), (1, "u", "", 0), (None, None, "", 0)], key=str)


def test_huge_page_is_read_in_proportion():
    assert len(html_text.main_text("<article>" + f"<p>{LONG}</p>" * 20_000)) == 20_000 * (len(LONG) + 1) - 1
    assert html_text.main_text("<" * 200_000 + "<div>" * 50_000) is not None


def test_huffman_round_trip():
    rng = np.random.default_rng(4)
    for n, size in ((1, 5), (2, 100), (300, 5000), (40_000, 100_000)):
        ids = np.minimum(rng.zipf(1.3, size) - 1, n - 1)
        known, counts = np.unique(ids, return_counts=True)
        bits = token_store.code_lengths(counts)
        assert bits.max() <= token_store.MAX_BITS and (0.5**bits).sum() <= 1
        book = token_store.Codebook(known, bits)
        stream, points = token_store.encode_bits(ids, book)
        assert (token_store.decode_bits(stream, points, size, book.table()) == ids).all()


def test_code_lengths_are_limited_and_optimal():
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    bits = token_store.code_lengths(np.array(fibonacci))
    assert bits.max() == token_store.MAX_BITS and (0.5**bits).sum() <= 1
    import heapq

    rng = random.Random(1)
    counts = [rng.randint(1, 50) for _ in range(30)]
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert (token_store.code_lengths(np.array(counts)) * counts).sum() == cost


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    pieces = ["it's", "It'S", "don't...", "ÉCOLE", "a'b", "x9y", "'s's", "!!!", "foo<|endoftext|>bar", "<|startoftext|>", "ét́", "≠", "日本語", " ", " x", "İstanbul", "ΣΑΣ", "1,234.5", "a.b.c", "_x_", "\x1c", "🙂🙂", "ß"]
    texts = [None, "", "   ", "x" * 3000] + [rng.choice([" ", "\n", "\t "]).join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    ids = [*range(0, 3 * len(texts), 3)]
    rng.shuffle(ids)
    rows = [*zip(ids, texts), (None, "null id"), (3, "again")]
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = token_store.stored(df.repartition(3), tokenizer_path()).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted((-1 if i is None else i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert ((-1 if r["doc_id"] is None else r["doc_id"]), own) in want and (r["start"], r["n_tokens"]) == (at, len(own))
        at += len(own)
    crc = {r["start"]: r["ids_crc32"] for r in token_store.digests(token_store.stored(df, tokenizer_path())).collect()}
    assert crc == {r["start"]: zlib.crc32(r["ids"]) for r in got}
    assert token_store.stored(df.limit(0), tokenizer_path()).count() == 0


def test_url_lists(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    entries = [("example.com", "block", day(5)), ("example.com", "none", day(10)), ("good.example.com", "allow", day(1)), ("example.com/a/b", "allow", day(7)), ("example.com", "block", day(6)), (None, "block", day(1)), ("x.org", "block", None)]
    pages = [
        (1, "https://user@WWW.Example.com:80/a?q#f", day(4), "none"),
        (2, "https://www.example.com./a", day(5), "block"),
        (3, "http://example.com/a/b/c", day(8), "allow"),
        (4, "http://example.com/a/bc", day(8), "block"),
        (5, "http://good.example.com/", day(8), "allow"),
        (6, "http://example.com", day(10), "none"),
        (7, None, day(8), "none"),
        (8, "http://example.com", None, "none"),
        (9, "", day(8), "none"),
        (10, "http://badexample.com/", day(8), "none"),
        (4, "http://example.com/a/bc", day(8), "block"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, fetched_at timestamp, want string")
    listed = spark.createDataFrame(entries, "pattern string, action string, listed_at timestamp")
    got = url_filter.evaluated(df, listed).collect()
    assert len(got) == len(pages) and all(r["decision"] == r["want"] and r["kept"] == (r["want"] != "block") for r in got)
    spans = {(r["pattern"], r["valid_from"], r["valid_to"]) for r in url_filter.intervals(listed).collect()}
    assert ("example.com", day(5), day(10)) in spans and ("example.com", day(10), None) in spans
    assert url_filter.evaluated(df, listed.limit(0)).where("decision != 'none'").count() == 0


def test_url_lists_with_clashing_columns_and_long_hosts(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    rows = [("http://" + "a." * 3000 + "x.org/" + "p/" * 3000, day(3), "own", "best", 1), ("http://y.org", day(3), "own", "best", 2)]
    captures = spark.createDataFrame(rows, "url string, fetched_at timestamp, decision string, best string, pattern int")
    listed = spark.createDataFrame([("x.org", "block", day(1)), ("a.x.org", "allow", day(2))], "pattern string, action string, listed_at timestamp")
    got = url_filter.evaluated(captures, listed)
    assert got.columns == ["url", "fetched_at", "decision", "best", "pattern", "_decision", "_pattern", "valid_from", "kept"]
    assert {(r["pattern"], r["_decision"], r["_pattern"], r["valid_from"]) for r in got.collect()} == {(1, "allow", "a.x.org", day(2)), (2, "none", None, None)}
    assert url_filter.evaluated(captures.limit(0), listed).count() == 0


def test_url_lists_against_force(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(seconds=rng.choice([rng.randrange(20), rng.randrange(86_400 * 4) // 600 * 600]))
    names = ["hot.org"] * 6 + ["a.hot.org", "b.a.hot.org", "hot.org/x", "a.hot.org/x/y", "cold.net"]
    entries = [(rng.choice(names), rng.choice(["allow", "block", "none"]), when()) for _ in range(500)]
    pages = [(k, f"http://{rng.choice(['', 'a.', 'b.a.', 'c.'])}{rng.choice(['hot.org', 'hot.org', 'cold.net'])}/{rng.choice(['', 'x', 'x/y', 'z'])}", when()) for k in range(600)]
    want = {}
    for k, url, at in pages:
        host, _, path = url[7:].partition("/")
        labels, steps = host.split("."), [x for x in path.split("/") if x]
        covers = [".".join(labels[-n:]) for n in range(1, len(labels) + 1)] + [f"{host}/{'/'.join(steps[:n])}" for n in range(1, len(steps) + 1)]
        for pattern in covers:
            own = sorted((t, a) for p, a, t in entries if p == pattern and t <= at)
            if own:
                action, since = own[-1][1], own[-1][0]
                for t, a in reversed([(t, max(b for u, b in own if u == t)) for t in sorted({t for t, _ in own})]):
                    if a != action:
                        break
                    since = t
                want[k] = (action, pattern, since)
        want.setdefault(k, ("none", None, None))
    got = url_filter.evaluated(spark.createDataFrame(pages, "k long, url string, fetched_at timestamp"), spark.createDataFrame(entries, "pattern string, action string, listed_at timestamp"))
    assert {r["k"]: (r["decision"], r["pattern"], r["valid_from"]) for r in got.collect()} == want


def test_mixing(spark):
    rows = [(k, f"t{k}", "big" if k % 3 else ["a", "b", None][k // 3 % 3]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit(0))
    weights = spark.createDataFrame([("big", 1.0), ("a", 2.0), (None, 1.0), ("gone", 9.0), ("b", -1.0)], "source string, weight double")
    out = mixing.mixed(df, weights, total=8000.0, seed=5)
    assert out.columns == ["doc_id", "text", "source", "copy", "_copy", "order_key"]
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"big", "a", None} and abs(n["big"] - 2000) < 200 and abs(n["a"] - 4000) < 300 and abs(n[None] - 2000) < 200
    rate = 2000 / 2000
    cdf, p, below = [], np.exp(-rate), 0.0
    for k in range(60):
        below += p
        cdf.append(below)
        p = p * rate / (k + 1)
    times = {r["doc_id"]: r["count"] for r in out.where("source = 'big'").groupBy("doc_id").count().collect()}
    for k, _, s in rows[:400]:
        if s == "big":
            u = int(hashlib.md5(f"5|{k}".encode()).hexdigest()[:13], 16) / 2**52
            assert times.get(k, 0) == sum(c <= u for c in cdf)
    again = mixing.mixed(df.repartition(7), weights, total=8000.0, seed=5)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    few = mixing.mixed(df.where("doc_id < 30"), weights, total=30_000.0, seed=5)  # some 750 copies a document
    n = {r["source"]: r["count"] for r in few.groupBy("source").count().collect()}
    assert abs(n["big"] - 7500) < 500 and abs(n["a"] - 15_000) < 700 and abs(n[None] - 7500) < 500
    assert mixing.mixed(df.limit(0), weights).count() == 0


def test_mixing_of_a_rare_source(spark):
    rows = [(k, "rare" if k < 2 else "few" if k < 10 else "big") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mixed(df, spark.createDataFrame([("rare", 6.0), ("few", 3.0), ("big", 1.0)], "source string, weight double"))
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for k, source in rows[:10]:
        rate = {"rare": 1800.0, "few": 225.0}[source]
        u = int(hashlib.md5(f"1|{k}".encode()).hexdigest()[:13], 16) / 2**52
        below = np.cumsum(np.exp([-rate + x * math.log(rate) - math.lgamma(x + 1) for x in range(4000)]))
        assert times[k] == (below <= u).sum()


@pytest.mark.parametrize("rate", [0.3, 499.0, 501.0, 30_000.0])
def test_poisson_distribution(spark, rate):
    low, below = spark.range(1).select(mixing.lowest(F.lit(rate)), mixing.distribution(F.lit(rate))).first()
    want = np.cumsum(np.exp([-rate + x * math.log(rate) - math.lgamma(x + 1) for x in range(low + len(below))]))
    assert np.allclose(below, want[low:], atol=1e-9) and below[-1] > 1 - 1e-12 and (not low or want[low - 1] < 1e-25)


RUSSIAN = "История реки и города, который она создала, длинная, и её рассказывают те, кто живёт здесь уже много лет подряд."
CHINESE = "这条河流和它所造就的城市的故事很长,由住在那里的人们讲述。那年春天他们建造了第一座桥,随之而来的是道路和贸易,城市也因此一天天变得更大更热闹起来了。"
FINNISH = "Joen ja sen synnyttämän kaupungin tarina on pitkä, ja sitä kertovat ihmiset, jotka asuvat siellä yhä tänäkin päivänä."


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE, FINNISH])
def test_pages_in_other_languages(text):
    assert html_text.main_text(f"<body><div><p>{text}</p><p>{text}</p></div><ul><li><a href=1>{text}</a></li></ul></body>") == f"{text}\n{text}"


def test_other_script_beside_english():
    assert html_text.main_text(f"<body><p>{LONG}</p><p>{RUSSIAN}</p><p>{LONG_2}</p></body>") == f"{LONG}\n{RUSSIAN}\n{LONG_2}"


@pytest.mark.parametrize("name", ["has-sidebar", "entry tags-politics", "no-comments post", "sidebar-layout"])
def test_names_that_only_contain_a_word(name):
    assert html_text.main_text(f"<main><div class='{name}'><p>{LONG}</p></div></main>") == LONG
    assert html_text.main_text(f"<main><p>{LONG_2}</p><div class='{name}'><p>see</p><p><a href=1>{LONG}</a></p></div></main>") == LONG_2


LONGER = f"{LONG} {LONG_2} {LONG}"
DOUBTFUL = (
    "comment-body comment-text comment-content comments-list ad-slot ad-container cookie-bar newsletter-box sidebar-left footer-bottom related-articles subscribe-box promo-box login-form alert cc-window sponsored-content "
    "commentBody user-comments"
).split()


@pytest.mark.parametrize("name", DOUBTFUL)
@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<article>{}</article>", "<form>{}</form>", "<div class='page-header'>{}</div>"])
def test_named_elements_beside_an_article_go(name, wrap):
    page = wrap.format(f"<h1>Title</h1><p>{LONGER}</p><p>{LONG_2}</p><div class='{name}'><p>{LONG}</p></div>")
    assert html_text.main_text(f"<body><nav><a href=1>Home</a></nav>{page}</body>") == f"Title\n{LONGER}\n{LONG_2}"
    several = wrap.format(f"<p>{LONGER}</p>" + f"<div class='{name}'><p>{LONG_2}</p></div>" * 6)
    assert html_text.main_text(f"<body>{several}</body>") == LONGER


@pytest.mark.parametrize("name", ["history-of-social", "page-header", "article comments", "main sidebar", "header-top", *DOUBTFUL])
@pytest.mark.parametrize("tag", ["div", "form", "section", "aside"])
def test_named_elements_around_the_article_stay(name, tag):
    page = f"<{tag} class='{name}'><h1>Title</h1><p>{LONGER}</p><p>Short.</p><p>{LONG_2}</p></{tag}>"
    for whole in (page, f"<article>{page}</article>", f"<p>{LONG}</p><form>{page}</form>".replace(f"<p>{LONG}</p>", "")):
        assert html_text.main_text(f"<body><nav><a href=1>Home</a></nav>{whole}<footer>(c)</footer></body>") == f"Title\n{LONGER}\nShort.\n{LONG_2}"


def test_an_article_of_a_few_words_beside_a_footer():
    assert html_text.main_text(f"<body><article><h1>Title here.</h1><p><b>Title here.<br></article><footer>{LONG}</footer>") == "Title here.\nTitle here."


def test_paragraphs_with_many_links():
    links = "See <a href=1>the first report</a>, <a href=2>the second one</a> and <a href=3>the last of them</a> for what came of it all."
    text = "See the first report, the second one and the last of them for what came of it all."
    assert html_text.main_text(f"<main><p>{LONG}</p><p>{links}</p><p>{LONG_2}</p></main>") == f"{LONG}\n{text}\n{LONG_2}"


def test_random_pages_with_names_at_random():
    """Against the generator's own labels: an article among named parts at any place and depth, sometimes wrapped in a named element or a form."""
    rng = random.Random(11)
    sentences = LONGER.split(". ")

    def prose(n):
        return " ".join(rng.choice(sentences).strip(".") + "." for _ in range(n))

    for _ in range(400):
        kept, parts = [], []
        for _ in range(rng.randint(2, 6)):
            kept.append(prose(rng.randint(2, 5)))
            parts.append(f"<p>{kept[-1]}</p>" if rng.random() < 0.7 else f"<div class='{rng.choice(['content', 'entry', 'has-sidebar', 'text-body'])}'><p>{kept[-1]}</p></div>")
        for _ in range(rng.randint(0, 4)):
            odd = f"<{{0}} class='{rng.choice(DOUBTFUL)}'>{''.join(f'<p>{prose(rng.randint(1, 2))}</p>' for _ in range(rng.randint(1, 2)))}</{{0}}>".format(rng.choice(["div", "section", "aside"]))
            parts.insert(rng.randint(0, len(parts)), odd)
        inner = "".join(parts)
        for _ in range(rng.randint(0, 3)):
            inner = rng.choice(["<div>{}</div>", "<article>{}</article>", "<main>{}</main>", "<form>{}</form>", "<div class='main sidebar'>{}</div>", "<section id=social-history>{}</section>"]).format(inner)
        page = f"<body><nav><a href=1>Home</a></nav><header><a href=2>Site</a></header>{inner}<footer>(c) {LONG}</footer></body>"
        assert html_text.main_text(page) == "\n".join(kept), page


@pytest.mark.parametrize("tag", ["title", "select", "button", "head"])
def test_raw_tags_without_an_end_are_read_in_proportion(tag):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_text.main_text(f"<{tag}>x" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_letters_whose_lower_case_is_longer():
    assert html_text.main_text(f"<p>{'İ' * 50}</p><script>var a = 1</script><p>{LONG}</p>").endswith(LONG)


def test_deeply_nested_names_are_weighed_in_proportion():
    took = []
    for n in (5_000, 20_000):
        began = time.process_time()
        html_text.main_text("<div class=ad><p>x y z</p>" * n + f"<p>{LONG}</p>")
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5
