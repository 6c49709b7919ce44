"""The registry of the operators and the pipeline, stage by stage, on the supplied tables."""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import langid, packing
from plumbline.llm.queries import SQL, WEIGHTS, tokenizer_file
from verify import rows

from . import test_lines, test_mixing, test_ngrams, test_packing

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="supplied tables are not here")


def test_all_operators_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    df = entry.queries()[name](spark, str(DATA))
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name, d: spark.createDataFrame(stage[name](spark, d, str(DATA)).collect(), d.schema)
    known = run("language_id", docs)
    lang = {r.doc_id: r for r in langid.identify(docs).collect()}
    have = {r.doc_id for r in known.collect()}
    assert all((i in have) == (lang[i].lang_pred != "und" and lang[i].score >= 0.3) for i in lang)

    before = [(r.doc_id, r.text) for r in known.collect()]
    lines = run("line_dedup", known)
    want = test_lines.expected(before)
    whole = dict(before)
    want = Counter({k[:2]: n for k, n in want.items() if k[1].strip() or k[1] == whole[k[0]]})
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    before = [(r.doc_id, r.text) for r in lines.collect()]
    single = run("ngram_jaccard_join", lines)
    names = {k[1] for k in test_ngrams.expected(before)}
    assert sorted(r.doc_id for r in single.collect()) == sorted(names)

    before = [(r.doc_id, r.text, r.lang, r.source) for r in single.collect()]
    mixed = run("mixing", single)
    domain = lambda s: ("web", "news", "books", "other")[min(3, int(s.removeprefix("src")) // 5)]
    want = test_mixing.expected(before, 0.8, 2, WEIGHTS, domain=domain)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r[0] for r in want)

    out = stage["best_fit_packing"](spark, mixed, str(DATA)).collect()
    test_packing.check(out, [(r.doc_id, r.text) for r in mixed.collect()], 2048)
    at = {r.sequence_id for r in out}
    assert len(at) <= -(-sum(r.length for r in out) // 2048) + 2
    assert packing.encoder(tokenizer_file())("") == []


def test_the_mixing_stage_passes_cut_texts_on(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    before = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    domain = lambda s: ("web", "news", "books", "other")[min(3, int(s.removeprefix("src")) // 5)]
    want = test_mixing.expected(before, 0.8, 2, WEIGHTS, domain=domain)
    text = {r[0]: r[1] for r in before}
    cut = lambda t, n: t if len(t.split()) <= n else re.match(r"\s*" + r"\s+".join([r"\S+"] * n), t)[0]
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, str(DATA)).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == Counter((r[0], c := cut(text[r[0]], r[-1]), len(c)) for r in want)
    assert any(r.text != text[r.doc_id] for r in got)
