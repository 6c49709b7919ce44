"""Operator 10, a quality classifier by co-training.

Two views of a document are learned apart: its text (distinct words, hashed, and
bins of eight style measures) and its metadata (language, source, length). Each
is a logistic regression trained with follow-the-regularised-leader, then calibrated. Over
``rounds`` rounds each view labels the unlabelled documents it is sure about
(calibrated probability of at least ``sure`` for good or bad) for the other view to learn from. At
last a logistic regression over both calibrated views, fitted on labelled rows that neither has
seen, scores every whole document.

A document is good if its quality label is not 0 and its toxic label is not 1.
The first fit sees a bounded sample of the labelled documents by a hash of the id (``labelled_rows``), in
one task. Each round is one pass over the written features of all unlabelled documents, in which tasks
learn apart and their changes are averaged per feature. Scoring is one pass over the documents without a shuffle.

Defined results: a text without a visible character scores 0; a label row with
both labels null is none; of rows that label a document twice the worse counts; without labels,
or with labels of one kind only, all other texts score 1 or the kind's value; a null
doc_id is scored but not learned from; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

WORDS = 1 << 17
STYLES = 8
LEVELS = 16
TEXT_BINS = WORDS + STYLES * LEVELS + 1
META_BINS = (1 << 12) + 1
PIECE = 1 << 20
WORD = re.compile(r"[^\W\d_]+")
KINDS = 0x3000


def kinds() -> np.ndarray:
    """Kind of each character below KINDS: 0 blank, 1 lower or other letter, 2 upper, 3 digit, 4 mark."""
    return np.array(
        [0 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 for c in map(chr, range(KINDS))],
        np.uint8,
    )


def pieces(text: str) -> Iterator[str]:
    """A long text in pieces that end at a blank."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        yield text[lo:hi]
        lo = hi


def text_features(text: str, table: np.ndarray) -> np.ndarray:
    """Indexes of the features of a text."""
    n = np.zeros(5, np.int64)
    found: set[str] = set()
    words = runs = chunks = 0
    last = ""
    for piece in pieces(text):
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        n += np.bincount(table[np.minimum(c, KINDS - 1)], minlength=5)
        chunks += len(piece.split())
        w = WORD.findall(piece.lower())
        words += len(w)
        runs += sum(map(str.__eq__, w, [last, *w[:-1]])) if w else 0
        last = w[-1] if w else last
        found.update(w)
    letters, total = n[1] + n[2], max(1, n[1:].sum())
    share = (
        n[2] / max(1, letters),  # upper case
        n[3] / total,  # digits
        n[4] / total,  # marks
        1 - len(found) / max(1, words),  # words seen before
        runs / max(1, words),  # words that repeat the one before
        min(1.0, letters / max(1, words) / 32),  # length of words
        min(1.0, abs(chunks - words) / max(1, chunks)),  # chunks that are no word
        min(1.0, text.count("\n") / max(1, words)),  # short lines
    )
    style = [WORDS + LEVELS * i + min(LEVELS - 1, int(np.sqrt(s) * LEVELS)) for i, s in enumerate(share)]
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in found), np.int64, len(found))
    return np.concatenate([np.unique(hashed), style, [TEXT_BINS - 1]])


def meta_features(lang: str | None, source: str | None, n_chars: int) -> np.ndarray:
    size = n_chars.bit_length()
    names = (f"l:{lang}", f"s:{source}", f"n:{size}", f"ls:{lang}:{source}", f"ln:{lang}:{size}")
    return np.unique([zlib.crc32(x.encode("utf-8", "surrogatepass")) % (META_BINS - 1) for x in names] + [META_BINS - 1])


def ftrl_weights(z: np.ndarray, n: np.ndarray, alpha: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / alpha + l2))


def learn(z: np.ndarray, n: np.ndarray, rows: list[np.ndarray], y: np.ndarray, epochs: int, alpha: float, l1: float, l2: float, seed: int) -> None:
    """A logistic regression on present features goes on learning: its state (z, n) is changed in place."""
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = ftrl_weights(z[at], n[at], alpha, l1, l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g


def fit_ftrl(rows: list[np.ndarray], y: np.ndarray, bins: int, epochs: int, alpha: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """Weights of a logistic regression on present features."""
    z, n = np.zeros(bins), np.zeros(bins)
    learn(z, n, rows, y, epochs, alpha, l1, l2, seed)
    return ftrl_weights(z, n, alpha, l1, l2)


def raw(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    return np.array([w[r].sum() for r in rows])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias of a small logistic regression by Newton steps, labels smoothed."""
    x = np.column_stack([x, np.ones(len(x))])
    soft = np.where(y == 1, 1 - 1 / (len(y) + 2), 1 / (len(y) + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - soft) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def co_train(
    views: list[list[np.ndarray]], y: np.ndarray, bins: list[int], rounds: int, sure: float, epochs: int, seed: int, penalties: list[tuple[float, float, float]]
) -> dict:
    """The method on one machine. ``views`` of the same documents; y is 1, 0, or -1 where unlabelled."""
    known = np.flatnonzero(y >= 0)
    held = known[np.arange(len(known)) % 4 == 3]
    fit_y = y.copy()
    fit_y[held] = -1
    pool = np.flatnonzero(y < 0)
    given = [fit_y.copy(), fit_y.copy()]
    half, rest = held[::2], held[1::2]
    model: list[np.ndarray] = []
    scale: list[np.ndarray] = []
    for turn in range(rounds + 1):
        model, scale = [], []
        for rows, own, b, (alpha, l1, l2) in zip(views, given, bins, penalties, strict=True):
            use = np.flatnonzero(own >= 0)
            w = fit_ftrl([rows[i] for i in use], own[use], b, epochs, alpha, l1, l2, seed)
            model.append(w)
            scale.append(logistic(raw([rows[i] for i in half], w)[:, None], y[half]))
        if turn == rounds:
            break
        for me, other in ((0, 1), (1, 0)):
            p = sigmoid(raw([views[me][i] for i in pool], model[me]) * scale[me][0] + scale[me][1])
            given[other] = fit_y.copy()
            given[other][pool] = np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1))
    both = np.column_stack([raw([v[i] for i in rest], w) * s[0] + s[1] for v, w, s in zip(views, model, scale, strict=True)])
    mixed = logistic(both, y[rest])
    return {"weights": [w.astype(np.float32) for w in model], "scale": scale, "mixed": mixed}


FEATURES = "doc_id long, words array<int>, meta array<int>"
VIEWS = ("words", "meta")
BINS = (TEXT_BINS, META_BINS)
PENALTIES = ((1.0, 4.0, 0.01), (0.2, 1.0, 1.0))
State = tuple[np.ndarray, np.ndarray]


def features(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """draw, good (1, 0, or -1 where unlabelled), words and meta of every document with an id, written once."""
    good = (F.coalesce("quality", F.lit(1)) != 0) & (F.coalesce("toxic", F.lit(0)) != 1)
    marks = (
        labels.where("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(good.cast("int")).alias("good"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kinds()
        for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
            text, lang, source = (c.to_pylist() for c in b.columns[1:])
            words = [text_features(t or "", table).astype(np.int32) for t in text]
            meta = [meta_features(x, s, len(t or "")).astype(np.int32) for x, s, t in zip(lang, source, text, strict=True)]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, ints), pa.array(meta, ints)], ["doc_id", *VIEWS])

    text = [F.col(c).cast("string") for c in ("text", "lang", "source")]
    found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), *text).mapInArrow(run, FEATURES)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)).alias("draw")
    # one kind of join at every size, so that disk grows in proportion
    return settle(found.join(marks.hint("merge"), "doc_id", "left").select(draw, F.coalesce("good", F.lit(-1)).alias("good"), *VIEWS), "quality-features")


def lists(column: pa.Array) -> list[np.ndarray]:
    return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])


def labelled(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Labels and views of the sample in the order of its draw."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return np.zeros(0, int), [[], []]
    t = pa.Table.from_batches(got).sort_by([("draw", "ascending"), ("good", "ascending")])
    return t["good"].to_numpy().astype(int), [lists(t[c].combine_chunks()) for c in VIEWS]


def in_one_task(sample: DataFrame, f: Callable[[np.ndarray, list[list[np.ndarray]]], object]) -> object:
    """What ``f`` makes of the bounded labelled sample, which meets in one task and not in the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(*labelled(batches)))], pa.binary())], ["made"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "made binary").first()[0])


def first_fit(epochs: int, seed: int) -> Callable:
    """Both views' states from the labelled rows that are not held out, or the only kind of label."""

    def run(y: np.ndarray, views: list[list[np.ndarray]]) -> list[State] | float:
        if len(set(y.tolist())) < 2 or len(y) < 16:
            return float(min(y.tolist(), default=1))
        use = np.flatnonzero(np.arange(len(y)) % 4 != 3)
        states = [(np.zeros(b), np.zeros(b)) for b in BINS]
        for s, rows, how in zip(states, views, PENALTIES, strict=True):
            learn(*s, [rows[i] for i in use], y[use], epochs, *how, seed)
        return states

    return run


def calibrate(weights: list[np.ndarray]) -> Callable:
    """The views' scales and their mixture, from the two halves of the held-out labelled rows."""

    def run(y: np.ndarray, views: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
        held = np.arange(3, len(y), 4)
        half, rest = held[::2], held[1::2]
        s = [raw(rows, w) for rows, w in zip(views, weights, strict=True)]
        scale = [logistic(x[half][:, None], y[half]) for x in s]
        return scale, logistic(np.column_stack([x[rest] * c[0] + c[1] for x, c in zip(s, scale, strict=True)]), y[rest])

    return run


def taught(found: DataFrame, first: list[State], weights: list[np.ndarray], scale: list[np.ndarray], sure: float, epochs: int, seed: int) -> list[State]:
    """States after each view has learned from what the other is sure about, over all unlabelled documents.

    Each task goes on from the labelled rows' states. Per feature, the changes of the
    tasks that met it are averaged by what they learned, so one that a single task knows counts in full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [(z.copy(), n.copy()) for z, n in first]
        for b in (x.slice(lo, 4096) for x in batches for lo in range(0, x.num_rows, 4096)):
            views = [lists(c) for c in b.columns]
            for me, other in ((0, 1), (1, 0)):
                p = sigmoid(raw(views[me], weights[me]) * scale[me][0] + scale[me][1])
                use = np.flatnonzero((p >= sure) | (p <= 1 - sure))
                learn(*states[other], [views[other][i] for i in use], (p[use] >= sure).astype(int), epochs, *PENALTIES[other], seed)
        for k, ((z, n), (z0, n0)) in enumerate(zip(states, first, strict=True)):
            dz, dn = z - z0, n - n0
            at = np.flatnonzero(dn > 0)
            cols = [np.full(len(at), k, np.int32), at.astype(np.int32), dn[at], dn[at] * dz[at], dn[at] * dn[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["view", "feature", "dn", "z", "n"])

    made = found.where("good = -1").select(*VIEWS).mapInArrow(run, "view int, feature int, dn double, z double, n double")
    # decimal sums do not depend on the order of the tasks; at most one row per feature comes back
    total = [F.sum(F.col(c).cast("decimal(28,12)")).cast("double").alias(c) for c in ("dn", "z", "n")]
    t = made.groupBy("view", "feature").agg(*total).where("dn > 0").toArrow()
    states = []
    for k, (z, n) in enumerate(first):
        mine = t.filter(pc.equal(t["view"], k))
        at, dn = mine["feature"].to_numpy(), mine["dn"].to_numpy()
        z, n = z.copy(), n.copy()
        z[at] += mine["z"].to_numpy() / dn
        n[at] += mine["n"].to_numpy() / dn
        states.append((z, n))
    return states


def train(
    docs: DataFrame,
    labels: DataFrame,
    labelled_rows: int = 8_000,
    rounds: int = 2,
    sure: float = 0.95,
    epochs: int = 4,
    seed: int = 5,
) -> dict:
    found = features(docs, labels, seed)
    known = found.where("good >= 0")
    share = min(1.0, labelled_rows / max(1, known.count()))
    sample = settle(known.where(F.col("draw") < share * (1 << 30)), "quality-sample")
    first = in_one_task(sample, first_fit(epochs, seed))
    if isinstance(first, float):
        return {"constant": first}
    states = first
    for turn in range(rounds + 1):
        weights = [ftrl_weights(*s, *how) for s, how in zip(states, PENALTIES, strict=True)]
        scale, mixed = in_one_task(sample, calibrate(weights))
        if turn < rounds:
            states = taught(found, first, weights, scale, sure, epochs, seed)
    return {"weights": [w.astype(np.float32) for w in weights], "scale": scale, "mixed": mixed}


def score(docs: DataFrame, model: dict, keep_at: float = 0.5) -> DataFrame:
    """doc_id, score (probability of a good document), text_score, meta_score, keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kinds()
        for b in (x.slice(lo, 512) for x in batches for lo in range(0, x.num_rows, 512)):
            ids, text, lang, source = b.column(0), *(c.to_pylist() for c in b.columns[1:])
            out = np.zeros((3, len(text)))
            for i, (t, x, s) in enumerate(zip(text, lang, source, strict=True)):
                if not t or t.isspace():
                    continue
                if "constant" in model:
                    out[:, i] = model["constant"]
                    continue
                v = [text_features(t, table), meta_features(x, s, len(t))]
                z = [w[f].sum() * c[0] + c[1] for w, f, c in zip(model["weights"], v, model["scale"], strict=True)]
                m = model["mixed"]
                out[:, i] = sigmoid(np.array([m[0] * z[0] + m[1] * z[1] + m[2], *z]))
            cols = [ids, *(pa.array(o) for o in out), pa.array(out[0] >= keep_at)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "text_score", "meta_score", "keep"])

    d = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("text", "lang", "source")))
    return d.mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5, **how) -> DataFrame:
    """Every document scored by a model co-trained on ``labels`` (doc_id, quality, toxic)."""
    return score(docs, train(docs, labels, **how), keep_at)
