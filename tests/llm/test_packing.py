from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import packing
from plumbline.llm.queries import tokenizer_file


def test_ids_equal_those_of_the_tokenizer_file():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    tok.encode_special_tokens = True
    encode = packing.encoder(tokenizer_file())
    rng = random.Random(1)
    letters = "ab é ß\n\t  .,'12345 we'll 日本 🙂 <|endoftext|>  "
    texts = ["", " ", "a  b", "\n\n x \n", "it's", *("".join(rng.choice(letters) for _ in range(80)) for _ in range(300))]
    for t in texts:
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_cuts_leave_only_the_first_short():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]
    assert packing.cuts(3, 4) == [(0, 3)]


@pytest.mark.parametrize("seed", range(4))
def test_local_search_keeps_pieces_and_never_adds_bins(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    first = packing.best_fit(sizes, 100)
    before = sum(sum(sizes[i] for i in b) ** 2 for b in first)
    bins = packing.Search(sizes, [list(b) for b in first], 100).run(6)
    assert Counter(i for b in bins for i in b) == Counter(range(400))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(first)
    assert sum(sum(sizes[i] for i in b) ** 2 for b in bins) >= before


def test_exchange_empties_a_bin():
    # best fit leaves 6+3, 5+4 and 2; two for one and moves fill two bins of ten
    sizes = [6, 5, 4, 3, 2]
    bins = packing.Search(sizes, [[0, 3], [1, 2], [4]], 10).run(6)
    assert len(bins) == 2


def check(rows, texts, room):
    encode = packing.encoder(tokenizer_file())
    want = Counter()
    for d, t in texts:
        ids = np.array([*encode(t or ""), 0], "<u4")
        for k, (s, n) in enumerate(packing.cuts(len(ids), room)):
            want[(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= room
    return at


def test_messy_documents(spark, messy, messy_rows, empty):
    out = packing.pack_documents(messy, tokenizer_file(), max_tokens=256, keep_ids=True).cache()
    at = check(out.collect(), [(r[0], r[1]) for r in messy_rows], 256)
    total = sum(r.length for r in out.select("length").collect())
    assert len(at) <= -(-total // 256) + 1
    s = packing.sequences(out).collect()
    assert sum(r.n_tokens for r in s) == total and all(len(r.ids) == 4 * r.n_tokens for r in s)
    assert packing.pack_documents(empty, tokenizer_file()).count() == 0


def test_many_blocks_keep_all(spark, messy, messy_rows):
    out = packing.pack_documents(messy, tokenizer_file(), max_tokens=64, block=20).collect()
    check(out, [(r[0], r[1]) for r in messy_rows], 64)


def test_added_tokens_have_their_own_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    encode = packing.encoder(tokenizer_file())
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "a", "\n", "word", "<|", "é", "12"]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(20))
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def blank_runs():
    rng = random.Random(8)
    runs = [" " * 1_000_000, "\t" * 300_000, "\n" * 300_000, "".join(rng.choice(" \t\n\r\x0b\x85\xa0\u2003\u3000") for _ in range(300_000))]
    return [a + r + b for r in runs for a, b in (("", ""), ("a", "b"), ("é!", "1"), ("x ", "\n"))]


def test_long_blank_runs_have_the_library_s_ids(blank_runs):
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(tokenizer_file()), packing.encoder(tokenizer_file())
    for t in blank_runs:
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_long_blank_runs_are_packed(spark, blank_runs):
    docs = spark.createDataFrame(list(enumerate(blank_runs)), "doc_id long, text string")
    check(packing.pack_documents(docs, tokenizer_file()).collect(), list(enumerate(blank_runs)), 2048)


def test_other_files_are_refused(tmp_path):
    import json

    spec = json.load(open(tokenizer_file(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="byte-level"):
            packing.encoder(f"{tmp_path}/t.json")
