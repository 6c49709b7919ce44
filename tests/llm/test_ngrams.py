from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import ngrams
from plumbline.llm.components import components


def shingles(text, width=5):
    w = (text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def expected(rows):
    s = [shingles(t) for _, t in rows]
    like = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    link = [[j for j in range(len(rows)) if j != i and like(s[i], s[j])] for i in range(len(rows))]
    for i, js in enumerate(link):
        for j in js:
            root[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[find(i)] = min(d, name.get(find(i), d))
    return Counter(
        (d, name.get(find(i)), sum(s[j] == s[i] for j in range(len(rows))), len({s[j] for j in link[i] if s[j] != s[i]}), len(link[i]))
        for i, (d, _) in enumerate(rows)
    )


def result(df, **how):
    return Counter((r.doc_id, r.class_id, r.copies, r.text_links, r.n_links) for r in ngrams.near_classes(df, **how).collect())


def near_copies(rng, n, words=120):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


def test_bands_reach_the_recall():
    bands, rows = ngrams.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and 1 - (1 - 0.3**rows) ** bands <= 0.01


def test_shingles_do_not_depend_on_the_piece(monkeypatch):
    text = " ".join(f"wört{i}\t" for i in range(400)) + "\n end"
    whole = ngrams.Shingler(5)(text)
    monkeypatch.setattr(ngrams, "PIECE", 64)
    assert (ngrams.Shingler(5)(text) == whole).all() and len(whole) == 397
    assert len(ngrams.Shingler(5)("")) == 0 and len(ngrams.Shingler(5)("one two")) == 1


def test_overlaps_equal_set_intersections(monkeypatch):
    monkeypatch.setattr(ngrams, "COLUMNS", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 30)).astype(np.uint64)) for _ in range(9)]
    got = ngrams.overlaps(sets[:4], sets[4:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[4:]] for a in sets[:4]]


def test_messy_documents(messy, messy_rows, empty):
    assert result(messy) == expected([(r[0], r[1]) for r in messy_rows])
    kept = ngrams.keep_one(messy)
    assert kept.columns == messy.columns
    names = Counter(c for (_, c, *_), n in expected([(r[0], r[1]) for r in messy_rows]).items())
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) or ids.count(7) == 2  # two texts under one id
    assert {i for i in ids if i is not None} == {c for c in names if c is not None}
    assert ngrams.near_classes(empty).count() == 0


@pytest.mark.parametrize("block", [2_048, 6])
def test_a_large_group_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ngrams, "BLOCK_CLASSES", block)
    rng = random.Random(6)
    texts = near_copies(rng, 40) + near_copies(rng, 5) + ["only one of its kind " * 3]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == expected(rows)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(1000, 1050)}) == 1
    assert got[0] != got[1000] and components(spark.createDataFrame([], "a long, b long")).count() == 0
