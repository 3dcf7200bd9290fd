"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, html_text, language_id, licenses, mixing, ngram_join, perspectives, prefix_trie, repetition, token_store, url_filter, vector_codes
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("component")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents")).withColumn("position", F.round("position", 12))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def _url_sql() -> str:
    """op5 in SQL: links and redirects to absolute urls without character references; none of the tables has others."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = lambda u: f"substr({u}, strpos({u}, '://') + 3)"
    host = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN translate(regexp_extract({rest(u)}, '(?s)^([^/?#]*)', 1), '{upper}', '{lower}') ELSE '' END"
    path = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract({rest(u)}, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END"
    node = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN lower(split_part({u}, '://', 1)) || '://' || ({host(u)}) || coalesce(nullif({path(u)}, ''), '/') || regexp_extract({rest(u)}, '(?s)^[^?#]*(\\?[^#]*)', 1) END"
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    pick = lambda h, p, k: "CASE " + " ".join(f"WHEN ({h} = '{r[1]}' OR ends_with({h}, '.{r[1]}')) AND starts_with({p}, '{r[2]}') THEN '{k(r)}'" for r in ordered) + " END"
    rule, verdict = (lambda h, p: pick(h, p, lambda r: r[1] + r[2])), (lambda h, p: pick(h, p, lambda r: r[0]))
    tag = lambda name, key, value, wanted: f"list_transform(regexp_extract_all(html, '(?is)<{name}\\b[^>]*\\b{key}\\s*=\\s*[\"'']?{value}\\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\\b{wanted}\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1))"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
t AS (SELECT node AS a, unnest(list_concat({tag('link', 'rel', 'canonical', 'href')}, {tag('meta', 'http-equiv', 'refresh', 'url')})) AS t FROM p WHERE node IS NOT NULL),
e AS (SELECT a, {node('t')} AS b FROM t WHERE strpos(t, '://') > 0),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, c.root FROM c JOIN s ON s.a = c.node),
k AS (SELECT node, min(root) AS component FROM c GROUP BY node),
o AS (SELECT component, {host('node')} AS h, {path('node')} AS q FROM k),
v AS (SELECT component, coalesce(bool_or(w = 'block'), false) AND NOT coalesce(bool_or(w = 'allow'), false) AS blocked
  FROM (SELECT component, {verdict('h', 'q')} AS w FROM o) GROUP BY component)
SELECT page_id, host, path, {rule('host', 'path')} AS rule,
  coalesce({verdict('host', 'path')}, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN k ON p.node = k.node LEFT JOIN v ON k.component = v.component"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """op11 in SQL: all distances in each round; vectors of one length, a multiple of four, as in the tables."""
    near = lambda book: f"""SELECT vec_id, label, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT v.*, b.e, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, b.c) + list_dot_product(b.c, b.c) AS d FROM v JOIN {book} b USING (p)) GROUP BY vec_id, label, p, x"""  # noqa: E731
    with_ = [f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor({1024} * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = len(embedding)),
v AS (SELECT vec_id, label, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM k, range({parts}) t(p)),
b0 AS (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM v) WHERE e < {entries})"""]
    for k in range(rounds):
        with_.append(f"""a{k} AS MATERIALIZED ({near(f'b{k}')}),
m{k} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, 10000) t(i) WHERE i <= len(x) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)""")
    book = f"(SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) FROM b{rounds})"
    with_.append(f"f AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM ({near(f'b{rounds}')}) GROUP BY vec_id, label)")
    return "WITH " + ",\n".join(with_) + f"\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {book} AS codebooks_sha256 FROM f"


QUERIES = {f.__name__: f for f in (op1_language_id, op2_chat_formatting, op3_ngram_jaccard_join, op4_license_scan, op5_url_filter, op6_token_store, op7_benchmark_decontamination, op8_html_extraction, op9_quality_rules, op10_source_mixing, op11_vector_codes, op12_prefix_trie, op13_exact_dedup)}

ORACLE_SQL = {
    "op3_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n + m - c)),
s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
k(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, k.root FROM k JOIN s ON s.a = k.node),
r AS (SELECT node, min(root) AS root FROM k GROUP BY node)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, coalesce(r.root, g.doc_id) AS component_id FROM g LEFT JOIN r ON g.doc_id = r.node""",
    "op11_vector_codes": _codes_sql(),
    "op12_prefix_trie": """
WITH o AS (
  SELECT conv_id, turn, md5(strlen(role) || ':' || role || text) AS t, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
k AS (SELECT conv_id, t, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS k FROM o),
-- crc32 bit by bit: a byte is mixed in (x >= 0), then eight steps follow (-1)
c AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM k)),
r AS (
  SELECT c.conv_id, 0 AS own, k.k, k.t, k.w FROM c JOIN k ON k.conv_id = c.conv_id - c.conv_id % 20 AND k.k <= c.h
  UNION ALL SELECT c.conv_id, 1, k.k, k.t, k.w FROM c JOIN k ON k.conv_id = c.conv_id AND k.k > c.h),
q AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS w FROM c
  UNION ALL SELECT conv_id, row_number() OVER p, string_agg(t, '') OVER p, w FROM r WINDOW p AS (PARTITION BY conv_id ORDER BY own, k ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM q),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM l GROUP BY path, depth),
u AS (SELECT n.*, left(path, length(path) - 32) AS up FROM n WHERE depth > 0),
g AS (SELECT up AS path, count(*) AS n_children FROM u GROUP BY up),
m AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(g.n_children, 0) AS n_children FROM n LEFT JOIN u ON n.path = u.path LEFT JOIN n p ON u.up = p.path LEFT JOIN g ON n.path = g.path),
s AS (SELECT v.path, sum(x.saved)::BIGINT AS saved_tokens, count(*) FILTER (x.n_children = 0) AS n_leaves FROM m v JOIN m x ON starts_with(x.path, v.path) GROUP BY v.path)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM m JOIN s USING (path)""",
    "op13_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, length(text) AS n_chars, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS bare FROM t)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept,
  sha256(bare) AS text_sha256, strlen(bare)::BIGINT AS n_bytes
FROM b WINDOW w AS (PARTITION BY bare ORDER BY n_chars DESC, doc_id NULLS LAST)""",
    "op5_url_filter": _url_sql(),
    "op2_chat_formatting": """
WITH t AS (
  SELECT conv_id, 0::BIGINT AS part, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role,
    replace(replace(coalesce(text, ''), '<|', '<\\|'), '|>', '|\\>') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
r AS (
  SELECT t.conv_id, p.participant, t.part, t.turn, t.role, t.text, t.role = p.participant AS own,
    CASE WHEN t.role = p.participant THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name=' || replace(replace(t.role, '<|', '<\\|'), '|>', '|\\>') || '|>' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, participant, part ORDER BY turn, role, text) AS k FROM r),
s AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, participant, part ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS a FROM n)
SELECT conv_id, participant, part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_target,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(a || ':' || (a + length(text)), ',' ORDER BY k) FILTER (WHERE own), '') AS spans,
  string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY k) AS masks
FROM s GROUP BY conv_id, participant, part""",
    "op10_source_mixing": """
WITH c AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * sum(n) OVER () / (sum(w) OVER () * n) AS rate FROM c),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM r),
f AS (SELECT source, k, exp(-rate + coalesce(sum(CASE WHEN k > 0 THEN ln(rate / k) END) OVER (PARTITION BY source ORDER BY k), 0)) AS pmf FROM k),
g AS (SELECT source, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) AS cdf FROM f),
a AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM g GROUP BY source),
d AS (SELECT *, md5(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) AS nth FROM documents),
u AS (SELECT d.*, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || h || ':' || nth), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM d),
e AS (SELECT u.*, unnest(range(1, len(list_filter(a.cdf, lambda x: x < u.u)) + 1))::INTEGER AS copy FROM u JOIN a ON u.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, text, lang, source, n_chars, copy,
  round(('0x' || substr(md5('mix/order:' || coalesce(doc_id::VARCHAR, '') || ':' || h || ':' || nth || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0, 12) AS position
FROM e""",
}
