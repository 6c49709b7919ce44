from __future__ import annotations

import random
from collections import Counter

from plumbline.llm import lines



def within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def expected(rows, min_chars=20):
    low = -(1 << 63)
    place = [((low if d is None else d, k), x) for d, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip()]
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        kept = []
        all_lines = t.split("\n")
        for k, x in enumerate(all_lines):
            me = (low if d is None else d, k)
            gone = x.strip() and any(
                p < me and (y == x or (len(x) >= min_chars and len(y) >= min_chars and within_one(x, y))) for p, y in place
            )
            if not gone:
                kept.append(x)
        out.append((d, "\n".join(kept), len(all_lines), len(kept)))
    return Counter(out)


def result(df, **how):
    return Counter((r.doc_id, r.text, r.n_lines, r.kept_lines) for r in lines.dedup_lines(df, **how).collect())


def test_random_edits_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef gh") for _ in range(rng.randint(15, 50))) for _ in range(25)]

    def edited(x: str) -> str:
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            p = rng.randrange(len(x))
            x = rng.choice([x[:p] + "ü" + x[p:], x[:p] + x[p + 1 :], x[:p] + "z" + x[p + 1 :]])
        return x

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == expected(rows)


def test_messy_documents(messy, messy_rows, empty):
    assert result(messy.where("length(text) < 20000 or text is null")) == expected(
        [(r[0], r[1]) for r in messy_rows if r[1] is None or len(r[1]) < 20_000]
    )
    out = lines.dedup_lines(messy)
    assert out.columns == [*messy.columns, "n_lines", "kept_lines"]
    assert out.where("doc_id = 109").first().kept_lines == 1  # a line of 60,000 words
    assert lines.dedup_lines(empty).count() == 0


def test_columns_of_the_same_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "a line of many characters", 7, "x"), (2, "a line of many charakters", 8, "y")], "doc_id long, text string, n_lines int, gone string")
    out = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert out[2].text == "" and out[2].n_lines == 1 and out[2].kept_lines == 0 and out[2].gone == "y"


def test_one_very_common_line(spark):
    rows = [(i, f"the same line stands in every text\nline number {i} of its own, and long") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = lines.dedup_lines(df)
    assert out.where("text like 'the same%'").count() == 1


