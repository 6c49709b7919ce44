"""The dealt operators as queries over the supplied tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, langid, lexical, lines, mixing, neighbours, ngrams, packing, quality, secrets, sketches, urls, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file()).drop("fill")


@query
def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, read back and listed."""
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op2_warc_index_merge"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
b AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((instr('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16
          + greatest(instr('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1, 0))
          // (2 ** (3 - (5 * i) % 4))::BIGINT % 32)::INT, 1)), '') AS payload_digest
  FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand, or nearly stand, earlier."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "kept_lines", "text")


SQL["op7_line_dedup"] = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, pos, string_split(text, chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
c AS MATERIALIZED (
  SELECT line, min((doc_id, pos)) AS first, row_number() OVER () AS id FROM l
  WHERE regexp_matches(line, '[^\s]') GROUP BY line),
v AS MATERIALIZED (
  SELECT id, first, p, substr(line, 1, p - 1) || substr(line, p + 1) AS cut
  FROM (SELECT id, first, line, unnest(range(1, length(line) + 1)) AS p FROM c WHERE length(line) >= 20)),
s AS (SELECT cut, p, min(first) AS f FROM v GROUP BY cut, p HAVING count(*) > 1),
near AS (
  SELECT v.id, s.f AS f FROM v JOIN s USING (cut, p) WHERE s.f < v.first
  UNION ALL SELECT v.id, c.first FROM v JOIN c ON c.line = v.cut WHERE c.first < v.first AND length(c.line) >= 20
  UNION ALL SELECT c.id, v.first FROM v JOIN c ON c.line = v.cut WHERE v.first < c.first AND length(c.line) >= 20),
t AS (SELECT c.line, least(c.first, coalesce(n.f, c.first)) AS t FROM c LEFT JOIN (SELECT id, min(f) AS f FROM near GROUP BY id) n USING (id)),
k AS (
  SELECT l.doc_id, l.pos, l.line, t.t IS NULL OR (l.doc_id, l.pos) <= t.t AS keep
  FROM l LEFT JOIN t USING (line)),
g AS (
  SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (keep)::INT AS kept_lines,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '') AS text
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.kept_lines, 0) AS kept_lines,
  CASE WHEN d.text IS NULL THEN NULL ELSE g.text END AS text
FROM documents d LEFT JOIN g USING (doc_id)
"""


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and its number of links."""
    out = ngrams.near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "copies", "text_links", "n_links")


SQL["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r ]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
i AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
p AS MATERIALIZED (
  SELECT a, b, i = x.n AND i = y.n AS same FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * i >= 4 * (x.n + y.n - i)
  UNION ALL SELECT x.doc_id, y.doc_id, true FROM n x JOIN n y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
k AS MATERIALIZED (SELECT n.doc_id, least(n.doc_id, min(p.b)) AS k FROM n LEFT JOIN p ON p.a = n.doc_id AND p.same GROUP BY n.doc_id)
SELECT n.doc_id, c.class_id, 1 + count(p.b) FILTER (p.same) AS copies,
  count(DISTINCT kb.k) FILTER (NOT p.same) AS text_links, count(p.b) AS n_links
FROM n JOIN c USING (doc_id) LEFT JOIN p ON p.a = n.doc_id LEFT JOIN k kb ON kb.doc_id = p.b
GROUP BY n.doc_id, c.class_id
"""


# The mixture of the query: domains are runs of numbered sources.
WEIGHTS = {"domain": {"web": 4, "news": 2, "books": 3, "other": 1}, "lang": {"en": 4, "de": 2, "es": 2, "fr": 2}}
DOMAIN = """case when try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) < 5 then 'web'
  when try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) < 10 then 'news'
  when try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) < 15 then 'books' else 'other' end"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, mixed to the weights, with at most three epochs of a leaf."""
    return mixing.mix(table(spark, sf_dir, "documents"), F.expr(DOMAIN), 0.5, 3, WEIGHTS, only_counts=True)


def _fill(level: str, parent: str, weights: str) -> str:
    key = f"{parent}, {level}" if parent else level
    part = f"PARTITION BY {parent}" if parent else ""
    got = f"got_{parent.split(', ')[-1]}" if parent else "got"
    return f"""
cap_{level} AS (SELECT {key}, sum(tokens * 3)::HUGEINT AS cap FROM leaves GROUP BY ALL),
w_{level} AS (SELECT c.*, g.budget, {weights} AS w FROM cap_{level} c {f"JOIN {got} g USING ({parent})" if parent else "CROSS JOIN got g"}),
u_{level} AS (SELECT *,
  coalesce(sum(cap) OVER ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(w) OVER ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM w_{level}),
f_{level} AS (SELECT *, cap * open_w <= w * (budget - used) AS is_full FROM u_{level}),
got_{level} AS (SELECT {key}, CASE WHEN is_full THEN cap ELSE
    (w * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}))) // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) END AS budget
  FROM f_{level}),"""


SQL["op3_mixing"] = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN n < 5 THEN 'web' WHEN n < 10 THEN 'news' WHEN n < 15 THEN 'books' ELSE 'other' END AS domain,
    coalesce(len(regexp_extract_all(text, '\S+')), 0)::BIGINT AS tokens
  FROM (SELECT *, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents)),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
got AS (SELECT floor(sum(tokens)::DOUBLE * 0.5)::HUGEINT AS budget FROM leaves),
{_fill("domain", "", "CASE domain WHEN 'web' THEN 4 WHEN 'news' THEN 2 WHEN 'books' THEN 3 ELSE 1 END::HUGEINT")}
{_fill("lang", "domain", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'es' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::HUGEINT")}
{_fill("source", "domain, lang", "1::HUGEINT")}
b AS (SELECT l.*, (g.budget // l.tokens)::BIGINT AS whole, (g.budget % l.tokens)::BIGINT AS rest FROM leaves l JOIN got_source g USING (domain, lang, source)),
k AS (SELECT d.*, b.whole, b.rest, md5('1:' || b.whole::VARCHAR || ':' || coalesce(d.doc_id::VARCHAR, '')) AS key
  FROM d JOIN b USING (domain, lang, source)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
e AS (SELECT *, unnest(range(0, whole + CASE WHEN start < rest THEN 1 ELSE 0 END)) AS epoch FROM s)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens,
  CASE WHEN epoch = whole THEN least(tokens, rest - start) ELSE tokens END::BIGINT AS kept_tokens
FROM e
"""


@query
def op6_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return sketches.fingerprints(table(spark, sf_dir, "documents")).drop("containment_edited")


def _sketch(words: str) -> str:
    grams = f"""CASE WHEN {words} = '' THEN [] WHEN len(string_split({words}, ' ')) < 5 THEN [{words}]
      ELSE list_transform(range(1, len(string_split({words}, ' ')) - 3), lambda i: array_to_string(string_split({words}, ' ')[i:i + 4], ' ')) END"""
    return f"list_sort(list_distinct(list_filter(list_transform({grams}, lambda g: substr(md5(g), 1, 12)), lambda h: h < '4')))"


SQL["op6_scaled_fingerprints"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
x AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM t),
e AS (SELECT *, left(text, n_chars - n_chars // 2) || left(next, n_chars // 2) AS edited FROM x),
w AS MATERIALIZED (SELECT doc_id, n_chars, edited,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) AS w, trim(regexp_replace(edited, '\\s+', ' ', 'g')) AS ew,
  trim(regexp_replace(next, '\\s+', ' ', 'g')) AS nw FROM e),
s AS MATERIALIZED (SELECT *, {_sketch("w")} AS s, {_sketch("ew")} AS es, {_sketch("nw")} AS ns FROM w),
i AS (SELECT *, len(list_intersect(s, es)) AS i, len(list_intersect(s, ns)) AS j FROM s)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
  md5(w) || ':' || array_to_string(s, '') AS fingerprint, md5(ew) || ':' || array_to_string(es, '') AS edited_fingerprint,
  CASE WHEN w = ew THEN 1.0 WHEN len(s) + len(es) = 0 THEN 0.0 ELSE i::DOUBLE / (len(s) + len(es) - i) END::DOUBLE AS near_edited,
  CASE WHEN w = nw THEN 1.0 WHEN len(s) + len(ns) = 0 THEN 0.0 ELSE j::DOUBLE / (len(s) + len(ns) - j) END::DOUBLE AS near_next
FROM i
"""


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the stated rules, else by the mined ones."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES).drop("confidence")


SQL["op9_url_filters"] = r"""
WITH p AS MATERIALIZED (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_distinct(regexp_extract_all(lower(coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '')), '[\p{L}\p{N}]+')) AS items
  FROM pages),
rules(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
s AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id),
l AS MATERIALIZED (
  SELECT p.page_id, p.items, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad
  FROM p JOIN labels ON labels.doc_id = p.page_id GROUP BY ALL),
n AS (SELECT count(*) AS n, sum(bad) AS bad FROM l),
i AS MATERIALIZED (SELECT page_id, bad, unnest(items) AS t FROM l),
c AS (
  SELECT [t] AS x, count(*) AS n, sum(bad) AS b FROM i GROUP BY ALL
  UNION ALL SELECT [a.t, b.t], count(*), sum(a.bad) FROM i a JOIN i b ON a.page_id = b.page_id AND a.t < b.t GROUP BY ALL
  UNION ALL SELECT [a.t, b.t, c.t], count(*), sum(a.bad) FROM i a JOIN i b ON a.page_id = b.page_id AND a.t < b.t
    JOIN i c ON c.page_id = a.page_id AND b.t < c.t GROUP BY ALL),
m AS (
  SELECT x FROM c, n WHERE c.b >= greatest(0.002 * n.n, least(20, n.n)) AND c.b >= 0.5 * c.n
    AND (c.b / c.n) / (n.bad / n.n) >= 1.5),
f AS (SELECT DISTINCT page_id FROM p JOIN m ON list_has_all(items, x))
SELECT p.page_id, host, path, rule, CASE WHEN s.rule IS NOT NULL THEN v WHEN f.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN s USING (page_id) LEFT JOIN f USING (page_id)
"""


@query
def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query
def op10_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the co-trained quality classifier."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between two tokenizers."""
    import public_tokenizers

    def digest(df: DataFrame) -> DataFrame:
        sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        return df.withColumn("groups_sha256", sha).drop("groups")

    docs, file_b = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(docs, tokenizer_file(), file_b, then=digest)


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op12_lexical_search"] = r"""
WITH t AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, big_n),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by patterns and by what literals are assigned to."""
    out = secrets.scan(table(spark, sf_dir, "documents"))
    return secrets.digest(out)
