from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from plumbline.llm import sketches


def sketch(text, width=5, limit="4"):
    w = re.sub(r"\s+", " ", text).strip(" ")
    words = w.split(" ") if w else []
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([w] if w else [])
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    s = sorted({md5(g)[:12] for g in grams if md5(g)[:12] < limit})
    return w, s, f"{md5(w)}:{''.join(s)}"


def like(a, b):
    if a[0] == b[0]:
        return 1.0
    union = set(a[1]) | set(b[1])
    return len(set(a[1]) & set(b[1])) / len(union) if union else 0.0


def expected(rows):
    rows = [(d, t or "") for d, t in rows]
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = sketch(t), sketch(edited), sketch(nxt)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a[2], b[2], like(a, b), like(a, c)))
    return sorted(out, key=repr)


def result(df, cols=("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")):
    return sorted((tuple(r[c] for c in cols) for r in sketches.fingerprints(df).collect()), key=repr)


def test_texts_equal_brute_force(spark, messy_rows):
    seen, rows = set(), []
    for r in messy_rows:
        if r[0] not in seen:
            seen.add(r[0])
            rows.append((r[0], r[1]))
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df) == expected(rows)
    assert result(df.where("doc_id = 3")) == expected([r for r in rows if r[0] == 3])


def test_repeated_rows_and_clashing_columns(messy, messy_rows, empty):
    out = sketches.fingerprints(messy).collect()
    assert len(out) == len(messy_rows)
    five = [r for r in out if r.doc_id == 5]
    assert len(five) == 2 and five[0].fingerprint == five[1].fingerprint and sorted(r.near_next == 1.0 for r in five) == [False, True]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert sketches.fingerprints(empty).count() == 0


def test_merged_sketch_and_containment(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(2_000))), (2, " ".join(f"b{i}" for i in range(100)))]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("s", sketches.sketch(sketches.words(F.col("t"))))
    both = df.agg(sketches.merged(F.col("s")).alias("m"), F.max("s").alias("s")).select(
        sketches.containment(F.col("s"), F.col("m")).alias("inside"), F.size("m").alias("n")
    )
    r = both.first()
    assert r.inside == 1.0 and 400 < r.n < 650


def test_the_plan_is_native(messy):
    plan = sketches.fingerprints(messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
