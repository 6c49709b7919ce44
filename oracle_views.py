"""The derivation of ``bench_views.py`` in ANSI SQL, and steps on top of it.

Each entry is one common table expression. ``sql(final, *names)`` puts the
ones a query needs in front of it.
"""

from __future__ import annotations

import re

CTE: dict[str, str] = {}

CTE["pf"] = """
 SELECT 'repo' || (p_partkey // 1000) AS repo, p_partkey, CAST(p_partkey % 1000 AS INTEGER) AS k,
        CAST(p_size AS INTEGER) AS size, p_type, p_name,
        lower(p_type) || '/' || lower(replace(p_brand, '#', '')) AS pkg_name
 FROM part"""
CTE["pfn"] = """
 SELECT *, repo || '/' || pkg_name AS parent,
        CASE WHEN p_name LIKE 'red %' THEN 'T' END AS recv,
        (CASE WHEN p_name LIKE 'red %' THEN 'T.' ELSE '' END) || 'F' || k AS name,
        pkg_name || (CASE WHEN size > 25 THEN '/large.go' ELSE '/small.go' END) AS file,
        k * 60 + 3 AS line, k * 60 + 3 + size AS end_line
 FROM pf"""
CTE["func"] = """
 SELECT repo, parent || '.' || name AS id, name, parent, pkg_name AS dir, file, line, end_line,
        CASE WHEN size % 2 = 0 THEN line - 2 END AS doc_line, size % 2 = 0 AS exported, recv,
        'h' || (size % 4) AS body_hash, p_partkey, k, size, p_type, p_name,
        1 + size % 15 AS cc, (p_partkey * 7) % 25 AS cognitive, size + 1 AS loc
 FROM pfn"""
CTE["li"] = """
 SELECT f.*, l_orderkey, l_suppkey, CAST(l_linenumber AS INTEGER) AS ln, CAST(l_quantity AS INTEGER) AS q,
        l_returnflag AS rf, l_linestatus AS ls
 FROM lineitem JOIN func f ON l_partkey = f.p_partkey"""
CTE["pkg"] = "SELECT DISTINCT repo, parent AS id, dir AS name, dir FROM func"
CTE["extmod"] = """
 SELECT s_suppkey, 'example.org/' || lower(replace(n_name, '_', '')) || '/v2/s' || s_suppkey AS path,
        'example.org/' || lower(replace(n_name, '_', '')) || '/v2' AS module, lower(replace(n_name, '_', '')) AS ext_name
 FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
CTE["imppath"] = """
 SELECT DISTINCT repo, parent AS importer, path, module, ext_name
 FROM (SELECT DISTINCT repo, parent, l_suppkey FROM li) JOIN extmod ON l_suppkey = s_suppkey"""
CTE["node"] = """
 SELECT repo, id, 'func' AS kind, name, parent, dir, file, line, end_line, doc_line, exported, recv, NULL AS type_kind FROM func
 UNION ALL SELECT repo, id, 'package', name, repo, dir, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pkg
 UNION ALL SELECT DISTINCT repo, repo, 'module', repo, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pkg
 UNION ALL SELECT repo, id || '.' || t, 'type', t, id, dir, dir || '/types.go', 1, 9, NULL, NULL, NULL,
        CASE WHEN t = 'I' THEN 'interface' ELSE 'struct' END FROM pkg, (VALUES ('T'), ('I')) v(t)
 UNION ALL SELECT DISTINCT repo, module, 'external', ext_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM imppath"""
CTE["call0"] = """
 SELECT DISTINCT a.repo, a.id, a.k * 2 + ln AS tk, l_quantity, l_linestatus
 FROM (SELECT DISTINCT l_partkey, CAST(l_linenumber AS INTEGER) AS ln, l_quantity, l_linestatus FROM lineitem) JOIN func a ON l_partkey = a.p_partkey"""
CTE["rawcall"] = """
 SELECT DISTINCT a.repo, CASE WHEN l_quantity = 50 THEN b.id ELSE a.id END AS f,
        CASE WHEN l_quantity = 50 THEN a.id ELSE b.id END AS t,
        CASE WHEN l_linestatus = 'F' THEN 'calls' ELSE 'calls_dynamic' END AS kind, l_quantity = 50 AS back
 FROM call0 a JOIN func b ON b.repo = a.repo AND b.k = a.tk"""
CTE["callx"] = """
 SELECT DISTINCT repo, f, CASE WHEN kind = 'calls_dynamic' THEN replace(t, '.T.', '.I.') ELSE t END AS t, kind FROM rawcall"""
CTE["dag"] = "SELECT DISTINCT repo, f, t FROM rawcall WHERE NOT back"
CTE["cyc"] = "SELECT DISTINCT repo, f, t FROM rawcall"
CTE["impl"] = "SELECT DISTINCT repo, parent || '.T' AS f, parent || '.I' AS t, 'implements' AS kind FROM func WHERE size >= 40"
CTE["imp"] = """
 SELECT DISTINCT c.repo, a.parent AS f, b.parent AS t, 'imports' AS kind
 FROM cyc c JOIN func a ON a.repo = c.repo AND a.id = c.f JOIN func b ON b.repo = c.repo AND b.id = c.t
 WHERE a.parent <> b.parent
 UNION SELECT DISTINCT repo, importer, module, 'imports' FROM imppath"""
CTE["edge"] = "SELECT * FROM callx UNION ALL SELECT * FROM impl UNION ALL SELECT * FROM imp"
CTE["eff"] = "SELECT repo, id FROM func WHERE p_type = 'SMALL' AND size = 50"

# measurements
CTE["block"] = """
 SELECT repo, CASE WHEN p_type = 'PROMO' OR p_name LIKE 'small %' THEN 'unlisted/' || file ELSE file END AS file, line + q % (size + 1) AS sl, ln AS sc, line + q % (size + 1) + ln - 1 AS el, l_suppkey % 3 + 1 AS ec,
        ln AS n, CASE WHEN rf = 'R' THEN l_suppkey % 5 ELSE 0 END AS cnt
 FROM li"""
CTE["mblock"] = "SELECT repo, file, sl, sc, el, ec, n, CAST(sum(cnt) AS BIGINT) AS cnt FROM block GROUP BY ALL"
CTE["inblock"] = """
 SELECT f.repo, f.id, b.* EXCLUDE (repo, file) FROM func f JOIN mblock b
   ON b.repo = f.repo AND b.file = f.file AND b.sl >= f.line AND b.el <= f.end_line"""
CTE["cov"] = """
 SELECT f.repo, f.id, CAST(coalesce(s.stmts, 0) AS BIGINT) AS stmts, CAST(coalesce(s.covered, 0) AS BIGINT) AS covered,
        CASE WHEN s.stmts > 0 THEN floor(CAST(s.covered AS DOUBLE) / CAST(s.stmts AS DOUBLE) * 1000.0 + 0.5) / 10.0 END AS percent,
        coalesce(s.reached, false) AS reached
 FROM func f LEFT JOIN (SELECT repo, id, sum(n) AS stmts, sum(CASE WHEN cnt > 0 THEN n ELSE 0 END) AS covered,
                               bool_or(cnt > 0) AS reached FROM inblock GROUP BY ALL) s USING (repo, id)
 WHERE EXISTS (SELECT 1 FROM block b WHERE b.repo = f.repo AND b.file = f.file)"""
CTE["lstate"] = """
 SELECT repo, id, ln AS line, CASE WHEN bool_or(cnt > 0) AND bool_or(cnt = 0) THEN 'partial'
        WHEN bool_or(cnt > 0) THEN 'covered' ELSE 'uncovered' END AS state
 FROM (SELECT repo, id, cnt, unnest(range(sl, el + 1)) AS ln FROM inblock) GROUP BY ALL"""
CTE["urun"] = """
 SELECT repo, id, min(line) AS s, max(line) AS e FROM (
   SELECT repo, id, line, line - row_number() OVER (PARTITION BY repo, id ORDER BY line) AS g
   FROM lstate WHERE state = 'uncovered') GROUP BY repo, id, g"""
CTE["mutant"] = """
 SELECT repo, CASE WHEN p_type = 'LARGE' THEN 'unlisted/' || file ELSE file END AS file, line + q % 60 AS line, l_suppkey % 40 + 1 AS col,
   (['ARITHMETIC_BASE','CONDITIONALS_BOUNDARY','CONDITIONALS_NEGATION','INCREMENT_DECREMENT','INVERT_ASSIGNMENTS',
     'INVERT_BITWISE','INVERT_BWASSIGN','INVERT_LOGICAL','INVERT_LOOPCTRL','INVERT_NEGATIVES','CUSTOM_TYPE'])[CAST(l_suppkey % 11 + 1 AS INTEGER)] AS type,
   CASE rf || ls WHEN 'RF' THEN 'KILLED' WHEN 'RO' THEN 'LIVED' WHEN 'NF' THEN 'NOT COVERED' WHEN 'NO' THEN 'TIMED OUT'
                 WHEN 'AF' THEN 'NOT VIABLE' ELSE 'SKIPPED' END AS status
 FROM li"""
CTE["mfunc"] = "SELECT * FROM func WHERE dir NOT LIKE 'large/%'"
CTE["amut"] = """
 SELECT m.*, (SELECT min(f.id) FROM mfunc f WHERE f.repo = m.repo AND f.file = m.file AND m.line BETWEEN f.line AND f.end_line) AS id
 FROM mutant m WHERE status IN ('KILLED', 'LIVED', 'NOT COVERED', 'TIMED OUT')"""
CTE["tally"] = """
 SELECT f.repo, f.id, count(a.id) FILTER (a.status = 'KILLED') AS killed, count(a.id) FILTER (a.status = 'LIVED') AS survived,
        count(a.id) FILTER (a.status = 'NOT COVERED') AS not_covered, count(a.id) FILTER (a.status = 'TIMED OUT') AS timed_out
 FROM mfunc f LEFT JOIN amut a ON a.repo = f.repo AND a.id = f.id GROUP BY f.repo, f.id"""
CTE["mut"] = """
 SELECT *, CASE WHEN killed + timed_out + survived > 0 THEN
   floor(abs(CAST(killed + timed_out AS DOUBLE) / CAST(killed + timed_out + survived AS DOUBLE) * 100.0 * 10.0) + 0.5) / 10.0 END AS score
 FROM tally"""
CTE["tnc"] = """
 SELECT m.repo, m.id, CASE WHEN c.reached THEN coalesce(t.n, 0) ELSE m.not_covered END AS testable
 FROM mut m LEFT JOIN cov c USING (repo, id)
 LEFT JOIN (SELECT a.repo, a.id, count(*) AS n FROM amut a JOIN lstate s ON s.repo = a.repo AND s.id = a.id AND s.line = a.line
            WHERE a.status = 'NOT COVERED' GROUP BY ALL) t ON t.repo = m.repo AND t.id = m.id"""
CTE["hunk"] = """
 SELECT repo, 'c' || l_orderkey AS c, file, line + q AS s, CASE WHEN ln = 1 THEN line + q ELSE line + q + ln - 2 END AS e, ln = 1 AS del
 FROM li"""
CTE["fchurn"] = """
 SELECT f.repo, f.id, count(DISTINCT h.c) AS churn FROM func f LEFT JOIN hunk h ON h.repo = f.repo AND h.file = f.file
   AND CASE WHEN h.del THEN h.s >= f.line AND h.s + 1 <= f.end_line ELSE h.s <= f.end_line AND h.e >= f.line END
 GROUP BY f.repo, f.id"""
CTE["cfile"] = """
 SELECT repo, 'c' || l_orderkey AS c, o_orderdate AS ts, file FROM li JOIN orders ON o_orderkey = l_orderkey"""
CTE["recent"] = "SELECT * FROM cfile WHERE ts >= TIMESTAMP '2000-08-01 00:00:00'"
CTE["filechurn"] = "SELECT repo, file, count(DISTINCT c) AS churn FROM recent GROUP BY ALL"
CTE["dirchurn"] = """
 SELECT repo, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT c) AS churn FROM recent GROUP BY ALL"""
CTE["metric0"] = """
 SELECT f.repo, f.id, f.name, f.parent, f.file, f.line, f.end_line, f.cc, f.cognitive, f.loc, ch.churn,
        c.stmts, c.covered, c.percent, c.reached, m.killed, m.survived, m.not_covered, m.timed_out, m.score, t.testable,
        CASE WHEN c.stmts IS NULL THEN NULL WHEN c.stmts = 0 THEN 1.0 ELSE CAST(c.covered AS DOUBLE) / CAST(c.stmts AS DOUBLE) END AS r
 FROM func f LEFT JOIN cov c USING (repo, id) LEFT JOIN mut m USING (repo, id) LEFT JOIN tnc t USING (repo, id)
      LEFT JOIN fchurn ch USING (repo, id)"""
CTE["metric1"] = """
 SELECT *, CAST(cc AS DOUBLE) * CAST(cc AS DOUBLE) * ((1.0 - r) * (1.0 - r) * (1.0 - r)) + CAST(cc AS DOUBLE) AS crap FROM metric0"""
CTE["metric2"] = """
 SELECT *, CASE WHEN crap <= 5 THEN 10 WHEN crap <= 8 THEN 8 WHEN crap <= 12 THEN 6 WHEN crap <= 20 THEN 4 WHEN crap <= 30 THEN 2 ELSE 1 END AS g_crap,
   CASE WHEN stmts IS NULL THEN 1 WHEN percent IS NULL THEN 10 WHEN percent >= 90 THEN 10 WHEN percent >= 80 THEN 8 WHEN percent >= 70 THEN 6
        WHEN percent >= 50 THEN 4 WHEN percent >= 30 THEN 2 ELSE 1 END AS g_cov,
   CASE WHEN killed IS NULL OR score IS NOT NULL OR coalesce(testable, 0) > 0 THEN
        CASE WHEN score >= 90 THEN 10 WHEN score >= 80 THEN 8 WHEN score >= 70 THEN 6 WHEN score >= 55 THEN 4 WHEN score >= 40 THEN 2 ELSE 1 END END AS g_mut
 FROM metric1"""
CTE["metric"] = "SELECT *, CASE WHEN g_mut IS NULL THEN g_crap ELSE (g_crap + g_mut + 1) // 2 END AS g_all FROM metric2"
CTE["rolled"] = """
 SELECT repo, parent AS package, min(g_crap) AS g_crap, min(g_mut) AS g_mut, min(g_cov) AS g_cov, min(g_all) AS g_all,
   floor(max(crap) * 10.0 + 0.5) / 10.0 AS crap_max, floor(sum(crap) / count(crap) * 10.0 + 0.5) / 10.0 AS crap_avg,
   arg_min(id, ROW(-coalesce(crap, -1.0), g_all, id)) AS worst,
   CAST(sum(stmts) AS BIGINT) AS stmts, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(killed) AS BIGINT) AS killed, CAST(sum(survived) AS BIGINT) AS survived,
   CAST(sum(not_covered) AS BIGINT) AS not_covered, CAST(sum(timed_out) AS BIGINT) AS timed_out, count(*) AS functions, count(*) FILTER (g_all >= 9) AS green
 FROM metric GROUP BY repo, parent"""
CTE["roll"] = """
 SELECT *, CASE WHEN stmts > 0 THEN floor(CAST(covered AS DOUBLE) / CAST(stmts AS DOUBLE) * 100.0 * 10.0 + 0.5) / 10.0 END AS percent,
   CASE WHEN killed + timed_out + survived > 0 THEN
     floor(CAST(killed + timed_out AS DOUBLE) / CAST(killed + timed_out + survived AS DOUBLE) * 100.0 * 10.0 + 0.5) / 10.0 END AS score
 FROM rolled"""

# text
CTE["doc"] = """
 SELECT source AS repo, lang || '/d' || doc_id || '.go' AS file, source || '.D' || doc_id AS id, doc_id, string_split(text, chr(10)) AS ls FROM documents"""
CTE["sline"] = "SELECT repo, file, id, doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS text FROM doc"
CTE["tstate"] = """
 SELECT repo, id, n AS line, CASE length(text) % 4 WHEN 0 THEN 'covered' WHEN 1 THEN 'uncovered' WHEN 2 THEN 'partial' END AS state
 FROM sline WHERE length(text) % 4 < 3"""
CTE["tnote"] = """
 SELECT repo, 'n' || doc_id || '_' || n AS id, repo || '.D' || doc_id AS target, n - 1 + length(text) % 4 AS off,
   CASE WHEN length(text) % 4 = 3 THEN '~' || trim(text, chr(32) || chr(9) || chr(13) || chr(10)) ELSE trim(text, chr(32) || chr(9) || chr(13) || chr(10)) END AS line_text,
   CASE WHEN length(text) % 2 = 0 THEN 'user' ELSE 'agent' END AS author, 'note ' || length(text) AS text, length(text) % 5 = 0 AS resolved
 FROM sline"""
CTE["ev"] = """
 SELECT 'u' || user_id AS repo, ts, 'pkg/f' || json_extract_string(props, '$.k') ||
   CASE event_type WHEN 'view' THEN '.md' WHEN 'signup' THEN '_test.go' ELSE '.go' END AS file,
   CASE WHEN event_type = 'error' THEN 'chmod' ELSE 'write' END AS op FROM events"""

_WORD = re.compile(r"[a-z_0-9]+", re.I)


def _needs(text: str, seen: dict[str, None]) -> None:
    for w in _WORD.findall(text):
        if w in CTE and w not in seen and CTE[w] != text:
            _needs(CTE[w], seen)
            seen[w] = None


def sql(final: str, recursive: bool = False, **extra: str) -> str:
    """``WITH`` the views that ``final`` and ``extra`` mention, in order."""
    seen: dict[str, None] = {}
    for text in [*extra.values(), final]:
        _needs(text, seen)
    def one(name: str, text: str) -> str:
        itself = recursive and re.search(rf"\b{name}\b", text)
        return f"{name} AS {'' if itself else 'MATERIALIZED '}({text.strip()})"

    parts = [one(n, CTE[n]) for n in seen] + [one(n, t) for n, t in extra.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + final.strip() if parts else final.strip()
