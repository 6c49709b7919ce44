from __future__ import annotations

import duckdb

import bench_queries
from bench_views import Views
from conftest import pairs
from test_shuffles import plan_of

SF = "/root/testdata/sf0.001"


def test_line_items_meet_their_functions_once(spark):
    v = Views(spark, SF)
    for name in ("blocks", "file_mutants", "hunks"):
        plan = getattr(v, name)()._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
    assert v.blocks().count() == v.table("lineitem").count()


def test_documents_of_a_snapshot_do_not_grow_with_other_snapshots(spark):
    f = spark.range(30).selectExpr("concat('r', id % 3) as repo", "'s' as snapshot_id", "id")
    assert {r["parts"] for r in bench_queries.document_parts(f, 20).collect()} == {1}
    assert {r["parts"] for r in bench_queries.document_parts(f, 5).collect()} == {3}


def test_documents_of_blanks_and_stops_are_rejected_as_in_sql(spark, tmp_path):
    texts = ["", " \n\t", "...", " .:,\n:", "\u00a0", "mode: set", "Prose. \n\nmode: set\na.go:1.1,2.2 1 1", None]
    rows = [(i, t, None if i == 5 else "en", "src", len(t or "")) for i, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = bench_queries.QUERIES["coverage_profile_rejects"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(bench_queries.SQL["coverage_profile_rejects"]).fetchall()
    assert len(want) == 14 and pairs(got, "repo", "path", "reason") == sorted(want, key=repr)


def test_pairs_of_functions_are_those_of_the_calls(spark):
    v = Views(spark, SF)
    raw, ends = v.raw_calls(), ["repo", "from", "to"]
    assert pairs(v.cyclic(), *ends) == pairs(raw.select(*ends).distinct(), *ends)
    assert pairs(v.dag(), *ends) == pairs(raw.where("not back").select(*ends).distinct(), *ends)
    kinds = raw.selectExpr("repo", "from", "if(kind = 'calls', to, replace(to, '.T.', '.I.')) as to", "kind").distinct()
    assert pairs(v.calls(), *ends, "kind") == pairs(kinds, *ends, "kind")
    # written once, whatever reads it
    assert "lineitem.parquet" not in plan_of(v.effect_edges())
