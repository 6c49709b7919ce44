from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def want(docs, items, k):
    """Every document scored for every item."""
    tf = [(d, Counter(plain_terms(t))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    n, length = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in tf:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(plain_terms(text))
                if t in c
            )
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out[(item, rank, d, -s)] += 1
    return out


def rows_of(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


ITEMS = [(1, "the water house"), (2, "straße wasser ÜBER The x"), (3, None), (4, ""), (5, "! ,"), (6, "nowhere zzz"), (2, "story of light"), (None, "world 345 été"), (7, "the the the and of with that this from have which there")]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 40}, {"k": 3}])
def test_messy_documents(spark, messy, messy_rows, empty, how):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.search(messy, items, **how)
    assert rows_of(got) == want([(r[0], r[1]) for r in messy_rows], ITEMS, how.get("k", 10))
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(messy, items.limit(0)).count() == 0


def test_small_shards_give_the_same(spark, messy, messy_rows, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 30)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows_of(lexical.search(messy, items)) == want([(r[0], r[1]) for r in messy_rows], ITEMS, 10)


@pytest.mark.parametrize("seed", range(4))
def test_limited_accumulators_lose_nothing_and_save(seed):
    rng = np.random.default_rng(seed)
    docs, vocabulary = 2000, 60
    common = rng.zipf(1.4, 40_000) % vocabulary
    doc = rng.integers(0, docs, 40_000)
    pairs, tf = np.unique(doc * vocabulary + common, return_counts=True)
    d, t = pairs // vocabulary, pairs % vocabulary
    n = np.bincount(doc, minlength=docs)
    first = np.searchsorted(d, np.arange(docs + 1))
    df = np.bincount(t, minlength=vocabulary)
    w = np.array([lexical.weight(docs, int(x)) for x in df], np.int64)
    shard = lexical.Shard(n, first, t, tf, 10 + 90 * n * docs // max(1, n.sum()), w)
    saved = 0
    for _ in range(30):
        item = sorted(rng.choice(vocabulary, 8, replace=False).tolist(), key=lambda x: (df[x], x))
        full = np.zeros(docs, np.int64)
        for x in item:
            at, gain = shard.list(x)
            full[at] += gain
        made, score, n_made = shard.search(item, 10, 0)
        assert (full[made] == score).all()
        tenth = np.sort(full)[-10]
        assert set(np.flatnonzero(full >= max(tenth, 1)).tolist()) <= set(made.tolist())
        saved += n_made < (full > 0).sum()
    assert saved


def test_terms_are_ascii_lower_cased_only():
    text = "ÀB-c_D 9é K İ\tẞ~x\x7f"
    assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 0xD800)])) for _ in range(50))
        assert [x.decode() for x in lexical.terms(t)] == plain_terms(t)
