"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, langid, mixing, near_dedup, pivot_search, prefix_trie, quality, repair, token_store, toxicity, url_filter
from .common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
k AS (SELECT doc_id, min(other) AS least_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id, d.doc_id <= coalesce(least_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM g)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.n, dw.i, win.item FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digests(token_store.stored(_table(spark, sf_dir, "documents"), tokenizer_path()))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries from the events: each concerns the page numbered like its user, by its host, its domain or its path."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.col("user_id").alias("page_id"))
    host, path = url_filter.host_of(F.col("url")), url_filter.steps_of(url_filter.path_of(F.col("url")))
    kind = F.pmod(F.col("event_id"), F.lit(3))
    pattern = F.when(kind == 0, host).when(kind == 1, url_filter.domain(host, 3)).otherwise(F.concat_ws("/", host, F.array_join(F.slice(path, 1, 1), "/")))
    action = F.when(F.col("event_type").isin("click", "error"), "block").when(F.col("event_type") == "purchase", "allow").otherwise("none")
    return events.join(_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id").select(pattern.alias("pattern"), action.alias("action"), F.col("ts").alias("listed_at"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    age = F.make_dt_interval(secs=F.pmod(F.conv(F.substring(F.md5("url"), 1, 7), 16, 10).cast("long"), F.lit(30 * 86400)))
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", (start + age).alias("fetched_at"))
    return url_filter.evaluated(captures, list_entries(spark, sf_dir))


OP8_SQL = r"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
u AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host,
  list_filter(string_split(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM p),
e AS (SELECT CASE event_id % 3 WHEN 0 THEN host WHEN 1 THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE concat_ws('/', host, array_to_string(parts[1:1], '/')) END AS pattern,
  CASE WHEN event_type IN ('click', 'error') THEN 'block' WHEN event_type = 'purchase' THEN 'allow' ELSE 'none' END AS action, ts AS listed_at FROM events JOIN u ON u.page_id = events.user_id),
o AS (SELECT pattern, listed_at, max(action) AS action FROM e GROUP BY 1, 2),
g AS (SELECT *, lag(action) OVER (PARTITION BY pattern ORDER BY listed_at) AS before FROM o),
i AS (SELECT pattern, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to FROM g WHERE before IS NULL OR before <> action),
c AS (SELECT page_id, url, host, parts, TIMESTAMP '2024-01-01' + to_seconds(CAST(('0x' || substr(md5(url), 1, 7)) AS BIGINT) % (30 * 86400)) AS fetched_at FROM u),
l AS (SELECT *, string_split(host, '.') AS labels FROM c WHERE host <> ''),
k AS (SELECT page_id, url, fetched_at, array_to_string(labels[-n:], '.') AS pattern, n AS rank FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS n FROM l)
  UNION ALL SELECT page_id, url, fetched_at, host || '/' || array_to_string(parts[1:n], '/'), 1000 + n FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM l)),
b AS (SELECT page_id, k.url, arg_max(struct_pack(action := action, pattern := i.pattern, valid_from := valid_from), rank) AS best
  FROM k JOIN i ON k.pattern = i.pattern AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY 1, 2)
SELECT c.page_id, c.url, c.fetched_at, coalesce(best.action, 'none') AS decision, best.pattern AS pattern, best.valid_from AS valid_from, coalesce(best.action, 'none') <> 'block' AS kept
FROM c LEFT JOIN b ON c.page_id = b.page_id AND c.url = b.url
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.tempered_weights(docs))


OP9_SQL = """
WITH n AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY 1),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
t AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r)),
d AS (SELECT *, CAST(CAST(('0x' || substr(md5('1|' || doc_id), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
m AS (SELECT d.doc_id, count(*) FILTER (WHERE t.below <= d.u) AS times FROM d JOIN t ON t.source = d.source GROUP BY 1)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, substr(md5('order1|' || doc_id || '|' || copy), 1, 16) AS order_key
FROM (SELECT documents.*, unnest(range(1, times + 1)) AS copy FROM documents JOIN m USING (doc_id))
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

def op11_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


OP11_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(_table(spark, sf_dir, "conversations"))


#: CRC-32 of an ASCII string, bit by bit.
_CRC32 = "xor(list_reduce([ord(c) FOR c IN string_split({}, '')], lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295)"

#: The cheapest way to each state (nothing yet, s, u, a) row by row: what it costs, its edits, its lines.
OP12_SQL = r"""
WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS code
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM o WHERE code <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM d),
f AS (SELECT *, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM n),
g AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
  list(struct_pack(gone := fault IN ('b', 'd'), more := CASE WHEN fault = 't' THEN 1 ELSE 0 END, first := left(role, 1), role := role, text := text) ORDER BY k) AS rows FROM g GROUP BY 1),
w AS (SELECT *, list_reduce(rows, lambda x, r: list_transform([[
    {{'c': x[1].c + 3, 'a': x[1].a || 'D', 't': x[1].t}},
    list_min([{{'c': x[2].c + 3, 'a': x[2].a || 'D', 't': x[2].t}}, CASE WHEN NOT r.gone AND r.first = 's' THEN {{'c': x[1].c + r.more, 'a': x[1].a || 'K', 't': x[1].t || chr(10) || r.role || ':' || r.text}} END]),
    list_min(list_concat([{{'c': x[3].c + 3, 'a': x[3].a || 'D', 't': x[3].t}}],
      CASE WHEN NOT r.gone AND r.first = 'u' THEN [{{'c': y.c + r.more, 'a': y.a || 'K', 't': y.t || chr(10) || r.role || ':' || r.text}} FOR y IN [x[1], x[2], x[4]]] ELSE [] END,
      CASE WHEN NOT r.gone THEN [{{'c': y.c + r.more + 2, 'a': y.a || 'R', 't': y.t || chr(10) || 'user:' || r.text}} FOR y IN [x[1], x[2], x[4]]] ELSE [] END)),
    list_min([{{'c': x[4].c + 3, 'a': x[4].a || 'D', 't': x[4].t}}, CASE WHEN NOT r.gone AND r.first = 'a' THEN {{'c': x[3].c + r.more, 'a': x[3].a || 'K', 't': x[3].t || chr(10) || r.role || ':' || r.text}} END,
      CASE WHEN NOT r.gone THEN {{'c': x[3].c + r.more + 2, 'a': x[3].a || 'R', 't': x[3].t || chr(10) || 'assistant:' || r.text}} END])]],
  lambda z: [z[1], z[2],
    list_min([z[3], {{'c': z[1].c + 2, 'a': z[1].a || 'I', 't': z[1].t || chr(10) || 'user:'}}, {{'c': z[2].c + 2, 'a': z[2].a || 'I', 't': z[2].t || chr(10) || 'user:'}}, {{'c': z[4].c + 2, 'a': z[4].a || 'I', 't': z[4].t || chr(10) || 'user:'}}]),
    list_min([z[4], {{'c': z[3].c + 2, 'a': z[3].a || 'I', 't': z[3].t || chr(10) || 'assistant:'}}, {{'c': z[1].c + 4, 'a': z[1].a || 'II', 't': z[1].t || chr(10) || 'user:' || chr(10) || 'assistant:'}},
      {{'c': z[2].c + 4, 'a': z[2].a || 'II', 't': z[2].t || chr(10) || 'user:' || chr(10) || 'assistant:'}}])])[1],
  [{{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}}, {{'c': CAST(2 AS BIGINT), 'a': 'I', 't': chr(10) || 'user:'}}, {{'c': CAST(4 AS BIGINT), 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}]) AS x FROM c),
b AS (SELECT *, list_min([x[1], x[4]]) AS best FROM w)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
""".format(crc=_CRC32.format("key"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH t AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT *, {crc} % 9 AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS key FROM t)),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS turns FROM h c LEFT JOIN h b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS length, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
m AS (SELECT conv_id, length, depth, turns[1:depth] AS path FROM p),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth) AS ends, CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(path[depth].text)) END AS bytes FROM m GROUP BY 1, 2),
k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.depth = k.depth AND n.path = k.path),
u AS (SELECT unnest(range(depth + 1)) AS depth, path AS below, n_children = 0 AS leaf, (n_convs - 1) * bytes AS saved FROM l),
s AS (SELECT depth, below[1:depth] AS path, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved FROM u GROUP BY 1, 2)
SELECT l.conv_id, l.depth, up.conv_id AS parent_conv_id, l.n_convs, l.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(l.ends, '')) AS ends_sha256
FROM l JOIN s ON l.depth = s.depth AND l.path = s.path LEFT JOIN l up ON up.depth = l.depth - 1 AND up.path = l.path[1:l.depth - 1]
""".format(crc=_CRC32.format("key"))

QUERIES = {"op1_toxicity": op1_toxicity, "op5_language_id": op5_language_id, "op6_quality": op6_quality, "op2_near_dedup": op2_near_dedup, "op3_html_text": op3_html_text, "op4_decontamination": op4_decontamination, "op7_token_store": op7_token_store, "op8_url_filter": op8_url_filter, "op9_mixing": op9_mixing, "op10_exact_dedup": op10_exact_dedup, "op11_pivot_search": op11_pivot_search, "op12_repair": op12_repair, "op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {"op8_url_filter": OP8_SQL, "op2_near_dedup": OP2_SQL, "op4_decontamination": OP4_SQL, "op9_mixing": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_pivot_search": OP11_SQL, "op12_repair": OP12_SQL, "op13_prefix_trie": OP13_SQL}
