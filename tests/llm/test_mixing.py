from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from plumbline.llm import mixing

DOMAIN = "if(source in ('src0', 'src1'), 'a', 'b')"


def share(children, budget):
    """(name, cap, weight) -> budget: fill the one of least capacity per weight first."""
    left, out = budget, {}
    todo = sorted((c for c in children if c[2] > 0), key=lambda c: (c[1] / c[2], c[0]))
    while todo:
        name, cap, w = todo[0]
        total = sum(c[2] for c in todo)
        if cap * total > w * left:
            return out | {n: v * left // total for n, _, v in todo}
        out[name] = cap
        left -= cap
        todo = todo[1:]
    return out


def expected(rows, fraction, epochs, weights, seed=1, domain=lambda s: "a" if s in ("src0", "src1") else "b"):
    leaf = defaultdict(list)
    for d, t, lang, source in rows:
        h = 42 if t is None else xxhash.xxh64(t.encode(), seed=42).intdigest()
        leaf[domain(source), lang or "", source or ""].append((d, len((t or "").split()), h - (h >> 63 << 64)))
    tokens = {k: sum(x[1] for x in v) for k, v in leaf.items() if sum(x[1] for x in v)}
    got = {(): int(sum(tokens.values()) * fraction)}
    for level, name in enumerate(("domain", "lang", "source")):
        new = {}
        for parent, b in got.items():
            kids = defaultdict(int)
            for k, n in tokens.items():
                if k[:level] == parent:
                    kids[k[level]] += n * epochs
            new |= {(*parent, k): v for k, v in share([(k, c, weights.get(name, {}).get(k, 1)) for k, c in kids.items()], b).items()}
        got = new
    out = []
    for k, b in got.items():
        whole, rest = divmod(b, tokens[k])
        key = lambda d: hashlib.md5(f"{seed}:{whole}:{'' if d is None else d}".encode()).hexdigest()  # noqa: B023, E731
        at = defaultdict(int)
        for d, n, _ in leaf[k]:
            at[key(d)] += n
        start, total, taken = {}, 0, defaultdict(int)
        for x in sorted(at):
            start[x], total = total, total + at[x]
        for d, n, _ in sorted(leaf[k], key=lambda x: x[2]):
            out += [(d, *k, e, n, n) for e in range(whole)]
            at_cut = start[key(d)] < rest <= start[key(d)] + at[key(d)]
            if start[key(d)] < rest and (not at_cut or n == 0 or taken[key(d)] < rest - start[key(d)]):
                out.append((d, *k, whole, n, min(n, rest - start[key(d)] - taken[key(d)]) if at_cut else n))
            taken[key(d)] += n
    return sorted(out, key=repr)


def test_messy_documents(messy, messy_rows, empty):
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2, "fr": 0}, "source": {"src0": 5}}
    rows = [r[:4] for r in messy_rows if r[0] != 109]
    df = messy.where("doc_id <> 109 or doc_id is null")
    for fraction, epochs in ((0.4, 3), (1.5, 2), (9.0, 1)):
        out = mixing.mix(df, DOMAIN, fraction, epochs, weights, only_counts=True)
        got = sorted(((r.doc_id, r.domain, r.lang, r.source, r.epoch, r.tokens, r.kept_tokens) for r in out.collect()), key=repr)
        assert got == expected(rows, fraction, epochs, weights)
    full = mixing.mix(df, DOMAIN, 0.4, 3, weights)
    assert full.columns == [*df.columns, "epoch", "cut_document"]
    assert full.count() == len(expected(rows, 0.4, 3, weights))
    assert mixing.mix(empty, DOMAIN).count() == 0


def test_the_plan_is_native(messy):
    plan = mixing.mix(messy, DOMAIN)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_sibling_takes_a_shortage_before_the_other_domain(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, text(10), "en", "src0"), (2, text(200), "en", "src1"), (3, text(200), "en", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, DOMAIN, 200, 1, {}, only_counts=True).groupBy("source").agg(F.sum("kept_tokens").alias("n")).collect()
    assert {r.source: r.n for r in out} == {"src0": 10, "src1": 90, "other": 100}


def test_a_cut_document_ends_with_its_leaf_s_budget(spark):
    long = " \n" + "\t ".join(f"é{i}" for i in range(100_000)) + "  "
    rows = [(1, long, "en", "src0"), (2, "b " * 30, "en", "src1"), (3, " c  d ", "en", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for budget in (50, 77, 3_000):
        out = mixing.mix(df, DOMAIN, budget, 1).collect()
        kept = mixing.mix(df, DOMAIN, budget, 1, only_counts=True).collect()
        n = {r.doc_id: r.kept_tokens for r in kept}
        assert {r.doc_id: len(r.text.split()) for r in out} == n and any(r.cut_document for r in out)
        for r in out:
            text = rows[r.doc_id - 1][1]
            words = text.split()
            assert text.startswith(r.text) and r.text.split() == words[: n[r.doc_id]]
            assert r.text == text if n[r.doc_id] == len(words) else r.text.endswith(words[n[r.doc_id] - 1])


def test_shared_places_keep_the_budget(spark):
    """Rows without a doc_id or with a repeated one stand in one place: at the cut they share what is left."""
    rng = random.Random(2)
    rows = [(rng.choice([None, None, 1, 2, 3]), " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))), "en", f"src{i % 3}") for i in range(600)]
    rows += [(None, "the same text again", "en", "src0")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    for budget in (250, 1_111, 4_000):
        counts = mixing.mix(df, DOMAIN, budget, 2, only_counts=True).collect()
        assert budget - 3 <= sum(r.kept_tokens for r in counts) <= budget  # a token is lost to rounding for each of two nodes at most
        texts = mixing.mix(df, DOMAIN, budget, 2).collect()
        assert sum(len(r.text.split()) for r in texts) == sum(r.kept_tokens for r in counts) and len(texts) == len(counts)


def test_columns_with_the_operator_s_own_names_come_back(spark):
    names = ["_domain", "_lang", "_source", "row", "key", "cut", "whole", "rest", "h", "tokens", "_n", "_part", "_left", "cut_tokens", "cut_rows", "range"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i % 4 or None, "a b c", "en", "src0", *(f"mine {n} {i}" for n in names)) for i in range(20)]
    out = mixing.mix(spark.createDataFrame(rows, schema), DOMAIN, 30, 1)
    assert out.columns[:-2] == ["doc_id", "text", "lang", "source", *names]
    got = {tuple(r)[2:-2] for r in out.collect()}
    assert len(got) == 10 and got <= {r[2:] for r in rows}
