from __future__ import annotations

import itertools
import random

from plumbline.llm import urls
from plumbline.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host string, rule string, items array<string>"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def judged(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def frame(spark, rows):
    return spark.createDataFrame([(p, u, "", "h", "r", ["x"]) for p, u in rows], SCHEMA).repartition(3)


LABELS = "doc_id long, quality int, toxic int"


def test_stated_rules(spark):
    names = [None, "", "no scheme", "http://", "http://ORG/", "http://a.org", "http://a.org/x?y#z", "http://borg/", "https://example.org/en/12"]
    names += ["https://m.example.org/es/", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/fr", "a://b://c.com/fr/", "http://É.com/de/É#/fr/"]
    names += ["http://user@example.org:80/es/", "http://example.org/es/", "http://a.com/?/fr/"]
    rows = [(i, u) for i, u in enumerate(names)] + [(1, ""), (None, "http://a.org/")]
    out = urls.judge(frame(spark, rows), spark.createDataFrame([], LABELS), URL_RULES).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out), key=repr)
    assert got == sorted(((i, *judged(u)[:3], judged(u)[3] or "allow") for i, u in rows), key=repr)
    assert urls.judge(frame(spark, []), spark.createDataFrame([], LABELS), URL_RULES).count() == 0


def test_mined_rules_need_support_confidence_and_all_tokens(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad_host, bad_path = rng.random() < 0.3, rng.random() < 0.3
        rows.append((i, f"http://{'spam' if bad_host else 'fine'}.net/{'pills' if bad_path else 'news'}/{i}"))
        bad = bad_host and bad_path
        if i % 2:
            labels.append((i, 0 if bad else 1, None))
    labels += [(1, None, None), (None, 0, 1), (3, 1, 0)]
    out = urls.judge(frame(spark, rows), spark.createDataFrame(labels, LABELS), URL_RULES, least_pages=10).collect()
    for r, (_, u) in zip(sorted(out, key=lambda r: r.page_id), rows, strict=True):
        assert r.rule is None and r.verdict == ("block" if "spam" in u and "pills" in u else "allow")
    assert {r.confidence for r in out if r.verdict == "block"} == {1.0}


def test_the_plan_is_native(spark):
    out = urls.judge(frame(spark, [(1, "http://a.org/")]), spark.createDataFrame([(1, 0, 1)], LABELS), URL_RULES)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_pattern_that_only_four_tokens_together_tell(spark):
    # three of the four are bad on two pages of five only
    texts = ["/".join(f"{'bad' if v < 2 else 'ok'}{k}" for k, v in enumerate(c)) for c in itertools.product(range(5), repeat=4)]
    rows = [(i, f"http://a.net/{t}/{i}") for i, t in enumerate(texts * 3)]
    blocked = {i for i, u in rows if u.count("bad") == 4}
    labels = spark.createDataFrame([(i, 0 if i in blocked else 1, None) for i, _ in rows], LABELS)
    out = urls.judge(frame(spark, rows), labels, URL_RULES).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == blocked
    known = spark.createDataFrame([(u.split("//")[1].replace(".", "/").split("/"), i in blocked) for i, u in rows], "items array<string>, bad boolean")
    assert [r.antecedent for r in urls.mine(known)[0].collect()] == [["bad0", "bad1", "bad2", "bad3"]]


def plain_rules(known, support, least, confidence, lift):
    """The same rules by counting every set of items, without merging: token sets that fire."""
    n = len(known)
    bad_all = sum(b for _, b in known)
    need = max(support * n, min(least, n))
    names = sorted({t for items, _ in known for t in items})
    sure = {}
    for size in range(1, 6):
        for s in itertools.combinations(names, size):
            pages = [b for items, b in known if set(s) <= set(items)]
            if sum(pages) >= need and sum(pages) >= confidence * len(pages) and sum(pages) / len(pages) * n / bad_all >= lift:
                sure[s] = sum(pages) / len(pages)
    return sure


def test_tokens_that_always_come_together_are_one_item(spark):
    rng = random.Random(6)
    known = []
    for _ in range(400):
        items = [t for group in (("a", "b"), ("c",), ("d", "e", "f")) if rng.random() < 0.4 for t in group]
        known.append((items + [f"z{rng.randrange(3)}"], rng.random() < (0.95 if {"a", "c"} <= set(items) else 0.2)))
    sure = plain_rules(known, 0.002, 20, 0.5, 1.5)
    rules, items = urls.mine(spark.createDataFrame(known, "items array<string>, bad boolean"))
    tokens = [*"abcdef", "z0", "z1", "z2", "other"]
    texts = [rng.sample(tokens, rng.randrange(1, 8)) for _ in range(200)]
    frame = spark.createDataFrame([(f"x://{'/'.join(t)}",) for t in texts], "url string").distinct()
    got = {r.url: round(r.confidence, 9) for r in urls.fired(frame, rules, items).collect()}
    for t in texts:
        want = [c for s, c in sure.items() if set(s) <= set(t)]
        assert got.get(f"x://{'/'.join(t)}") == (round(max(want), 9) if want else None)


def test_a_url_of_forty_tokens_on_a_third_of_all_pages(spark):
    long = "/".join(f"part{k}" for k in range(40))
    rows = [(i, f"http://spam.net/{long}/{i}" if i % 3 == 0 else f"http://fine.net/{'/'.join(f'page{k}' for k in range(i % 3))}/{i}") for i in range(900)]
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, None) for i, _ in rows], LABELS)
    out = urls.judge(frame(spark, rows), labels, URL_RULES).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == {i for i, _ in rows if i % 3 == 0}


def test_mined_rules_of_one_to_five_tokens_reach_the_query(spark, tmp_path):
    from plumbline.llm.queries import QUERIES

    rng = random.Random(9)
    rows, bad = [], set()
    for size in range(1, 6):
        for i in range(240):
            have = [f"r{size}t{k}" for k in range(size) if rng.random() < 0.8]
            rows.append((len(rows), f"http://h.net/{'/'.join(have)}/{len(rows)}"))
            if len(have) == size:
                bad.add(len(rows) - 1)
    frame(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 0 if i in bad else 1, None) for i, _ in rows], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES["op9_url_filters"](spark, str(tmp_path)).collect()
    blocked = {r.page_id for r in out if r.verdict == "block"}
    assert bad <= blocked
