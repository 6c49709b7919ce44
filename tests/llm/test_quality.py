from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality

from .conftest import SCHEMA, sentence

LABELS = "doc_id long, quality int, toxic int, text string"


def test_features_do_not_depend_on_the_piece(monkeypatch):
    table = quality.kinds()
    text = "Some WORDS, again and again; 123 zählt!\nnew line " * 30
    whole = quality.text_features(text, table)
    monkeypatch.setattr(quality, "PIECE", 50)
    assert (quality.text_features(text, table) == whole).all()


def test_a_view_learns_from_the_other():
    rng = np.random.default_rng(0)
    n = 3_000
    y = rng.integers(0, 2, n)
    # the first view knows every document, the second only by features that few labelled ones show
    a = [np.array([y[i], 9]) for i in range(n)]
    b = [np.array([10 + 2 * rng.integers(200) + y[i], 499]) for i in range(n)]
    known = np.where(np.arange(n) < 200, y, -1)
    alone = quality.co_train([a, b], known, [10, 500], 0, 0.9, 6, 1, [(0.5, 0.1, 0.1)] * 2)
    taught = quality.co_train([a, b], known, [10, 500], 2, 0.9, 6, 1, [(0.5, 0.1, 0.1)] * 2)
    acc = lambda m: ((quality.raw(b, m["weights"][1]) * m["scale"][1][0] + m["scale"][1][1] > 0) == y).mean()
    assert acc(taught) > 0.97 and acc(taught) > acc(alone) + 0.1


def test_held_out_accuracy_and_defined_results(spark, messy, messy_rows, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        text, kind = sentence(rng, "en", 40), i % 4
        if kind == 0:
            text = " ".join(w + "###" for w in text.split())
        elif kind == 1:
            text += " vileword"
        rows.append((1000 + i, text, "en", "src1", 0, "k", 1, "t", "l", 2))
        if i % 5 < 3:
            labels.append((1000 + i, 0 if kind == 0 else 1, 1 if kind == 1 else 0, "x"))
    labels += [(1000, None, None, "x"), (None, 1, 1, "x"), (1002, 1, 0, "x")]
    df = messy.unionByName(spark.createDataFrame(rows, SCHEMA))
    out = quality.classify(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows) + len(messy_rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id >= 1000 and (r.doc_id - 1000) % 5 >= 3]
    assert np.mean([r.keep == ((r.doc_id - 1000) % 4 > 1) for r in held]) > 0.93
    assert {(r.score, r.keep) for r in out if r.doc_id in (103, 104, 105)} == {(0.0, False)}
    assert quality.classify(empty, spark.createDataFrame(labels, LABELS)).count() == 0


def test_without_labels(spark, messy):
    out = quality.classify(messy, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in out} == {0.0, 1.0}


def test_all_unlabelled_documents_teach(spark):
    rng = random.Random(4)
    rows, labels = [], []
    # the unlabelled documents that a sample by a hash of the id would take last
    draw = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30))
    last = {r.id for r in spark.range(400, 6_000).orderBy(draw.desc()).limit(60).collect()}
    for i in range(6_000):
        bad = i % 2
        text = " ".join(rng.choice(("vile", "nasty", "junk") if bad else ("plain", "clear", "sound")) for _ in range(12))
        # a source that only these show
        rows.append((i, text, "en", f"only{bad}" if i in last else f"src{i % 6}", 0, "k", 1, "t", "l", 2))
        if i < 400:
            labels.append((i, 1 - bad, 0, "x"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = quality.train(df, spark.createDataFrame(labels, LABELS))
    at = lambda bad: quality.zlib.crc32(f"s:only{bad}".encode()) % (quality.META_BINS - 1)
    assert model["weights"][1][at(0)] > 0 > model["weights"][1][at(1)]
