from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, row int, tokens string, line string, score int"
WORDS = {
    "en": "the and of with that this from have which there water house green often never under people light story world".split(),
    "de": "der und das mit dass nicht haben welche straße wasser haus grün oft niemals unter leute licht welt über schön".split(),
    "fr": "le et de avec que cette depuis avoir quelle eau maison vert souvent jamais sous gens lumière histoire monde été".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Documents with nulls, empty and very long texts, copies, ties and repeated rows."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = rng.choice(sorted(WORDS))
        text = "\n".join(sentence(rng, lang, rng.randint(6, 40)) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, lang, f"src{i % 7}"))
    base = rows[0][1]
    rows += [(100, base, "en", "src0"), (101, base + " once more", None, None), (102, base.replace("the", "a", 1), "en", "src1")]
    rows += [(103, None, None, None), (104, "", "en", "src0"), (105, "   ", "en", "src2"), (106, "12 345 !", "de", "src3")]
    rows += [(107, "four words are here", "en", ""), (108, "one", "fr", "src4")]
    rows += [(109, sentence(rng, "de", 60_000), "de", "src0"), (110, "x" * 30_000, "en", "src1")]
    rows += [(5, rows[5][1], rows[5][2], rows[5][3]), (7, "another text under a known id " * 3, "en", "src1")]
    rows += [(None, "a text without an id " * 5, "en", "src0"), (None, None, None, None), (-3, "below zero stands first of all here", "en", "src9")]
    return [(d, t, lang, s, None if t is None else len(t), "k", 1, "t", "l", 2) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
