from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import alignment, packing, queries
from plumbline.llm.queries import tokenizer_file


def piece_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_file())


def plain(coders, text):
    """Groups and links of a text by sets of ends, from the libraries themselves."""
    a, b = coders
    if not text:
        return None
    raw, letter = (" " + text).encode(), packing.byte_letters()
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    parts = [[b"".join(letter[c] for c in a.id_to_token(i)) for i in ids[0]], []]
    parts[1] = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    if any(b"".join(p) != raw for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    both = sorted(set(ends[0]) & set(ends[1]))
    groups: list = [[[], []]]
    at_a, at_b = iter(zip(ends[0], ids[0], strict=True)), iter(zip(ends[1], ids[1], strict=True))
    for e in both:
        for side, tokens in enumerate((at_a, at_b)):
            for end, i in tokens:
                groups[-1][side].append(str(i))
                if end == e:
                    break
        groups.append([[], []])
    groups = ["|".join(map(",".join, g)) for g in groups[:-1]]
    at = [dict(zip(ends[s], ids[s], strict=True)) for s in (0, 1)]
    links = [(at[0][e], at[1][e]) for e in both]
    return len(ids[0]), len(ids[1]), ";".join(groups), links


def want(coders, rows):
    each = [(d, plain(coders, t)) for d, t in rows]
    n = Counter(x for _, p in each if p for x in p[3])
    top = defaultdict(int)
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    out = Counter()
    for d, p in each:
        if p is None:
            out[(d, 0, 0, 0, 0, "", 0, 0)] += 1
        else:
            best = sum(n[x] == top[x[1]] for x in p[3])
            out[(d, p[0], p[1], p[2].count(";") + 1, len(p[3]), p[2], best, sum(n[x] for x in p[3]))] += 1
    return out


COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
ODD = ["<|endoftext|> in a text", "a ▁ of its own", "  two before", "after \n\n", "日本語 and 🙂 é", "\x00\x01", "<s> <0x41> </s>", "\t", "ﬁ", "é", "x" * 3000, " " * 6000, "y" + "\n" * 5000 + "z"]


@pytest.mark.parametrize("most", [1 << 18, 40, 0])
def test_messy_documents(spark, messy, messy_rows, empty, coders, most):
    rows = [(r[0], r[1]) for r in messy_rows if len(r[1] or "") < 100_000] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.align_documents(docs, tokenizer_file(), piece_file(), most).select(*COLS).collect()
    assert Counter(tuple(r) for r in got) == want(coders, rows)
    assert alignment.align_documents(empty, tokenizer_file(), piece_file()).count() == 0


def test_very_long_text(spark, messy):
    out = alignment.align_documents(messy.where("doc_id = 109"), tokenizer_file(), piece_file()).first()
    assert out.n_groups > 50_000 and out.n_links == out.n_groups


def test_digest_of_the_query(spark, tmp_path):
    spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op11_token_alignment"](spark, str(tmp_path)).collect()}
    assert len(got[1].groups_sha256) == 64 and got[2].groups_sha256 == "" and got[2].n_groups == 0


@pytest.mark.parametrize("seed", range(5))
def test_halving_finds_all_shared_ends(seed):
    rng = np.random.default_rng(seed)
    for density in (2, 5, 40, 4000):
        total = 6000
        texts = sorted({*rng.integers(1, total, 3).tolist(), total})
        a = np.unique([*rng.integers(1, total, total // density), *texts])
        b = np.unique([*rng.integers(1, total, total // 3), *texts])
        last = np.searchsorted(a, texts)
        got = alignment.shared_cuts(a, b, np.concatenate([[0], last[:-1] + 1]), last)
        assert a[got].tolist() == sorted((set(a.tolist()) & set(b.tolist())) - set(texts))


def test_frequent_bound(spark):
    rng = random.Random(4)
    counts = spark.createDataFrame([(i, rng.randint(1, 1000)) for i in range(500)], "pair long, links long").cache()
    for most in (0, 1, 30, 499, 500, 10_000):
        assert counts.where(f"links >= {alignment.frequent(counts, most)}").count() <= most
    assert alignment.frequent(counts, 500) == 1
