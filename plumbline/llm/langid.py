"""Operator 8, language identification.

A sparse multinomial logistic regression on TF-IDF character n-grams, trained
with follow-the-regularised-leader under an elastic-net penalty and followed by
temperature calibration. One pass over the training documents counts document
frequencies over all of them and extracts the features of a bounded sample
(``sample_rows`` in all, spread evenly over the languages by a hash of the id);
the model is fitted on that sample and scores every whole text in a second pass.

What a task holds: one batch of texts, the counts of one text (``BINS`` numbers)
and the model (``BINS`` weights per language). Long texts are read in pieces of
``PIECE`` characters, so their counts need no more memory than those of others.

Defined results: ``und`` with score 0 where text is null or has no letter, or
where nothing could be learned; a null ``doc_id`` is never learned from and not
held out; repeated rows are learned and scored as often as they occur; an empty
table gives no rows; only doc_id, text and lang are read, the last only to learn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

BINS = 1 << 16
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 20
UNKNOWN = "und"


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def counts(text: str, alpha: np.ndarray) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None if it has no letter.

    Everything that is not a letter is one blank between words.
    """
    out = None
    for lo in range(0, len(text), PIECE):
        piece = text[max(0, lo - max(ORDERS) + 1) : lo + PIECE] if lo else text[:PIECE]
        c = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = alpha[c]
        if not is_letter.any():
            continue
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        c = np.where(is_letter, c, np.uint32(32))[keep]
        c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
        h, all_hashes = np.zeros(len(c), np.uint32), []
        for k in ORDERS:
            if len(c) < k:
                break
            h = h[: len(c) - k + 1] * np.uint32(0x9E3779B1) + c[k - 1 :] + np.uint32(k)
            mixed = h ^ (h >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B)
            all_hashes.append(mixed >> np.uint32(16))
        n = np.bincount(np.concatenate(all_hashes), minlength=BINS)
        out = n if out is None else out + n
    return out


def weigh(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and TF-IDF values (length one) of the counts of a text."""
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, (x / norm if norm > 0 else x)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int
) -> np.ndarray:
    """Weights (classes, BINS + 1) after FTRL-proximal; the last one is the bias."""
    z, n = np.zeros((classes, BINS + 1)), np.zeros((classes, BINS + 1))

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[:, at], n[:, at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], BINS), np.append(rows[i][1], 0.1)
            w = weights(at)
            p = softmax(w @ x)
            p[y[i]] -= 1
            g = p[:, None] * x[None, :]
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    return weights(np.arange(BINS + 1))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def logits(rows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray) -> np.ndarray:
    return np.array([w[:, at] @ x + 0.1 * w[:, BINS] for at, x in rows]).reshape(len(rows), len(w))


def temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    Labels are smoothed by one part in rows + 2, so that a sample without an
    error does not make every prediction certain.
    """
    if not len(s):
        return 1.0
    other = 1 / (len(y) + 2)
    target = np.full(s.shape, other / max(1, s.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - other

    def loss(t: float) -> float:
        v = s / np.exp(t)
        v = v - v.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(v).sum(1)) - (v * target).sum(1)))

    lo, hi, r = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


LEARNED = "feature int, df long, lang string, draw long, at array<int>, n array<int>"


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of this task's texts, and the features of the sampled ones."""
    alpha, df, docs = letters(), np.zeros(BINS, np.int64), 0
    names = [x.split()[0] for x in LEARNED.split(", ")]
    types = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    none = lambda k: [None] * k
    for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
        for text, lang, draw, sampled in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = counts(text or "", alpha)
            if n is None:
                continue
            docs += 1
            at = np.flatnonzero(n)
            df[at] += 1
            if sampled:
                cols = [none(1), none(1), [lang], [draw], [at.astype(np.int32)], [n[at].astype(np.int32)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
    at = np.flatnonzero(df)
    cols = [[*at, -1], [*df[at], docs], *(none(len(at) + 1) for _ in range(4))]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def train(
    docs: DataFrame,
    sample_rows: int = 4_000,
    least_rows: int = 100,
    epochs: int = 3,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    seed: int = 7,
) -> dict:
    """A model learned from ``docs`` (doc_id, text, lang), all of them training rows.

    ``sample_rows`` bounds the rows the regression sees: each language offers
    ``sample_rows / languages`` of its rows, and ``least_rows`` at least.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    langs = sorted(docs.groupBy("lang").count().collect())
    if not langs:
        return {"langs": []}
    each = max(least_rows, sample_rows // len(langs))
    share = F.create_map(*(x for r in langs for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["count"])))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    found = settle(
        docs.select(F.col("text").cast("string"), "lang", draw.alias("draw"), (draw < share[F.col("lang")] * (1 << 30)).alias("sampled")).mapInArrow(extract, LEARNED),
        "langid-features",
    )
    n = found.where("feature is not null").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(BINS + 1)
    df[n["feature"].to_numpy()] = n["df"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    names = sorted({r["lang"] for r in langs})
    # the bounded sample meets in one task, not in the driver
    sample = found.where("lang is not null").select("lang", "draw", "at", "n").repartition(1)
    fitted = sample.mapInArrow(fitter(names, idf, (epochs, alpha, beta, l1, l2, seed)), "weights binary, t double").toArrow()
    if not fitted.num_rows:
        return {"langs": []}
    w = np.frombuffer(fitted["weights"][0].as_py(), np.float32).reshape(len(names), BINS + 1)
    return {"langs": names, "idf": idf.astype(np.float32), "weights": w, "temperature": fitted["t"][0].as_py()}


def fitter(names: list[str], idf: np.ndarray, how: tuple):
    """The fit of one task: the sample's features in, weights over the temperature out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(d, lang, at, n) for b in batches for lang, d, at, n in zip(*b.columns, strict=True)]
        got.sort(key=lambda r: (r[0].as_py(), r[1].as_py()))
        rows, y = [], []
        for _, lang, at, n in got:
            at, n = at.values.to_numpy(), n.values.to_numpy()
            x = (1 + np.log(n)) * idf[at]
            rows.append((at, x / np.sqrt(x @ x)))
            y.append(names.index(lang.as_py()))
        if not rows:
            return
        y = np.array(y, int)
        check = np.arange(len(rows)) % 5 == 4  # kept from the fit for the calibration
        fit = [r for r, c in zip(rows, check, strict=True) if not c]
        w = fit_ftrl(fit, y[~check], len(names), *how)
        t = temperature(logits([r for r, c in zip(rows, check, strict=True) if c], w), y[check])
        yield pa.RecordBatch.from_arrays([pa.array([(w / t).astype(np.float32).tobytes()]), pa.array([t])], ["weights", "t"])

    return run


def predict(docs: DataFrame, model: dict, *keep: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the language found and its probability, called ``names``."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{names[0]} string", f"{names[1]} double"])
    read = [*keep, *(["text"] if "text" not in keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alpha = letters()
        for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
            pred, score = [], []
            for text in b.column(read.index("text")).to_pylist():
                n = counts(text or "", alpha) if model["langs"] else None
                if n is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, x = weigh(n, model["idf"])
                p = softmax((model["weights"][:, at] @ x + 0.1 * model["weights"][:, BINS]).astype(float))
                k = int(p.argmax())
                pred.append(model["langs"][k])
                score.append(float(p[k]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, *names]
            )

    return docs.select(*(F.col(f"`{c}`").cast(types[c]) for c in read)).mapInArrow(run, schema)


def identify(docs: DataFrame, **how) -> DataFrame:
    """Learn from the rows that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    d = docs.select(F.col("doc_id").cast("long"), "text", "lang").withColumn("held_out", held_out())
    return predict(d, train(d.where(~F.col("held_out")), **how), "doc_id", "held_out")


def known_language(docs: DataFrame, least: float = 0.3, **how) -> DataFrame:
    """``docs`` whose language is known with at least this probability; a null lang is filled in."""
    model = train(docs.where(~held_out()), **how)
    out = predict(docs, model, *docs.columns, names=("_lang_found_", "_score_found_"))
    out = out.where((F.col("_lang_found_") != UNKNOWN) & (F.col("_score_found_") >= least))
    lang = F.coalesce("lang", "_lang_found_").alias("lang")
    return out.select(*(lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns))
