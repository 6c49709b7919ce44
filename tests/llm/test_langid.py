from __future__ import annotations

import random
import zlib

import numpy as np

from plumbline.llm import langid

from .conftest import SCHEMA, WORDS, sentence


def test_counts_do_not_depend_on_the_piece():
    alpha = langid.letters()
    text = "Ein Satz über Wasser, und 12 Häuser. " * 20
    whole = langid.counts(text, alpha)
    size, langid.PIECE = langid.PIECE, 10_000
    try:
        assert (langid.counts(text, alpha) == whole).all()
    finally:
        langid.PIECE = size
    assert langid.counts("12 !?", alpha) is None and langid.counts("", alpha) is None


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(300):
        c = i % 3
        at = np.unique(np.concatenate([[c], rng.integers(10, 2_000, 8)]))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
        y.append(c)
    w = langid.fit_ftrl(rows, np.array(y), 3, 3, 2.0, 1.0, 0.3, 0.05, 1)
    assert (langid.logits(rows, w).argmax(1) == y).mean() > 0.98
    assert (w[:, 10:2_000] == 0).mean() > 0.9


def test_temperature_cools_an_overconfident_model():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    sure = np.where(rng.random(500) < 0.8, y, 1 - y)
    s = np.zeros((500, 2))
    s[np.arange(500), sure] = 9.0
    assert langid.temperature(s, y) > 3


def test_held_out_accuracy_and_defined_results(spark, messy, messy_rows, empty):
    rng = random.Random(4)
    more = [(1000 + i, sentence(rng, lang, rng.randint(3, 50)), lang, "s", 0, "k", 1, "t", "l", 2) for i, lang in enumerate([*sorted(WORDS)] * 80)]
    df = messy.unionByName(spark.createDataFrame(more, SCHEMA))
    out = langid.identify(df).collect()
    assert len(out) == len(messy_rows) + len(more)
    lang = {r[0]: r[2] for r in more}
    held = [r for r in out if r.held_out and r.doc_id in lang]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert {103, 104, 105, 106} <= und and all(0 <= r.score <= 1 for r in out)
    assert not any(r.held_out for r in out if r.doc_id is None)
    kept = langid.known_language(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {103, 104, 105, 106} and {101, 109} <= ids
    assert kept.where("doc_id = 101").first().lang is not None
    assert langid.identify(empty).count() == 0


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(df).collect()} == {("und", 0.0)}
