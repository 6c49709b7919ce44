"""Operator 1, best-fit packing with swap-based local search.

Documents become token pieces in Arrow batches; pieces shorter than a sequence
are dealt into blocks of bounded size by hash, each block is packed by best fit
(longest first) and improved by a local search, and the pieces of bins that stay
underfull are dealt anew into fewer blocks until one block is left. A block is
one small group of one task: no task, group or driver holds more than a block.

Local search: a bin with a gap takes a piece (move), exchanges one of its
pieces for a longer one (one for one) or one for two (two for one) from another
underfull bin. Only exchanges that raise the sum of squared fills are made, so
the emptier bin of the two is drained until it disappears.

Defined results: null text is empty text and gives the one piece ``[0]``; repeated
rows are packed as often as they occur; a null ``doc_id`` stays null; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PLACED = "uid long, sequence_id long, offset long, fill long"

# Fixed value: the pre-tokenizer's pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, bytes]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): bytes([b]) for b in shown} | {chr(256 + k): bytes([b]) for k, b in enumerate(hidden)}


# White space as the pattern's \\s has it, in runs too long for its look-ahead.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def byte_level(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and added tokens of a byte-level BPE ``tokenizers`` file.

    A file whose ids are not ranks, or that changes a text before it is cut, is
    refused: its ids would differ from those of the library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens that are more than their text: {path}")
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        raise ValueError(f"not a plain byte-level file: {path}")
    if not before.get("use_regex", True) or model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(order, order[1:], strict=False)):
        raise ValueError(f"ids do not follow the merges: {path}")
    special = {t["content"]: t["id"] for t in added}
    letter = byte_letters()
    ranks = {b"".join(map(letter.__getitem__, w)): i for w, i in model["vocab"].items() if w not in special}
    return ranks, special


def encoder(path: str, added: bool = True) -> Callable[[str], list[int]]:
    """Text to the ids of a byte-level BPE ``tokenizers`` file.

    The file's vocabulary is numbered in the order of its merges, so it is also
    a table of ranks; the rank encoder gives the same ids five times as fast.
    The file's added tokens are cut out of a text first and have their own ids,
    or with ``added`` false are text like any other. Long runs of white space
    are cut off before the pattern sees them, at the places where it cuts.
    """
    import tiktoken

    ranks, special = byte_level(path)
    coding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ordinary = coding.encode_ordinary

    def plain(text: str) -> list[int]:
        ids, lo = [], 0
        for m in LONG_BLANKS.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1  # the last blank goes with the next word
            ids += ordinary(text[lo : m.start()])
            ids += coding._encode_single_piece(text[m.start() : end])
            lo = end
        return ids + ordinary(text[lo:]) if lo else ordinary(text)

    if not special or not added:
        return plain
    marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))

    def encode(text: str) -> list[int]:
        ids, lo = [], 0
        for m in marks.finditer(text):
            ids += [*plain(text[lo : m.start()]), special[m[0]]]
            lo = m.end()
        return ids + plain(text[lo:]) if lo else plain(text)

    return encode


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(ids), 256):
                out: list[tuple] = []
                for doc, text in zip(ids[lo : lo + 256], texts[lo : lo + 256], strict=True):
                    b = np.array([*encode(text or ""), end_id], "<u4").tobytes()
                    for k, (s, n) in enumerate(cuts(len(b) // 4, max_tokens)):
                        part = b[4 * s : 4 * (s + n)]
                        out.append((uid, doc, k, s, n, zlib.crc32(part), part if keep_ids else None))
                        uid += 1
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indexes into ``sizes``: longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    at: list[list[int]] = [[] for _ in range(room + 1)]  # bins by gap
    gaps = 0  # bit g: some bin has gap g
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        fits = gaps >> n
        if fits:
            g = n + (fits & -fits).bit_length() - 1
            b = at[g].pop()
            if not at[g]:
                gaps ^= 1 << g
            bins[b].append(i)
            g -= n
        else:
            b, g = len(bins), room - n
            bins.append([i])
        if g:
            at[g].append(b)
            gaps |= 1 << g
    return bins


class Search:
    """The local search over the underfull bins of one block."""

    def __init__(self, sizes: list[int], bins: list[list[int]], room: int):
        self.sizes, self.room = sizes, room
        self.bins = bins
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.by_size: dict[int, set[int]] = {}  # size -> underfull bins that hold it
        self.present = 0
        self.open = {b for b in range(len(bins)) if self.fill[b] < room}
        for b in self.open:
            self._list(b)

    def _list(self, b: int) -> None:
        for n in {self.sizes[i] for i in self.bins[b]}:
            self.by_size.setdefault(n, set()).add(b)
            self.present |= 1 << n

    def _unlist(self, b: int) -> None:
        for n in {self.sizes[i] for i in self.bins[b]}:
            s = self.by_size[n]
            s.discard(b)
            if not s:
                self.present &= ~(1 << n)

    def _single(self, a: int, given: int) -> tuple[int, int, tuple[int, ...]] | None:
        """The longest piece up to given + gap of another bin: (gain, bin, sizes)."""
        seen = self.present & ((1 << (given + self.room - self.fill[a] + 1)) - 1)
        while seen >> (given + 1):
            n = seen.bit_length() - 1
            gain = n - given
            donors = [b for b in self.by_size[n] if b != a and self.fill[a] - self.fill[b] + gain > 0]
            if donors:
                return gain, min(donors, key=lambda b: (self.fill[b], b)), (n,)
            seen ^= 1 << n
        return None

    def _pair(self, a: int, given: list[int], donors: list[int]) -> tuple[int, int, tuple[int, ...], int] | None:
        """The best two pieces of one of the emptiest bins for one of a's."""
        best = None
        gap = self.room - self.fill[a]
        for b in donors:
            if b == a:
                continue
            own = sorted(self.sizes[i] for i in self.bins[b])
            two = {own[i] + own[j]: (own[i], own[j]) for i in range(len(own)) for j in range(i + 1, min(len(own), i + 64))}
            sums = 0
            for s in two:
                sums |= 1 << s
            for g in given:
                fit = sums & ((1 << (g + gap + 1)) - 1)
                if fit >> (g + 1):
                    s = fit.bit_length() - 1
                    gain = s - g
                    if self.fill[a] - self.fill[b] + gain > 0 and (best is None or gain > best[0]):
                        best = (gain, b, two[s], g)
        return best

    def _take(self, b: int, n: int) -> int:
        k = next(k for k, i in enumerate(self.bins[b]) if self.sizes[i] == n)
        return self.bins[b].pop(k)

    def _exchange(self, a: int, b: int, given: int, got: tuple[int, ...]) -> None:
        self._unlist(a)
        self._unlist(b)
        out = [self._take(a, given)] if given else []
        inn = [self._take(b, n) for n in got]
        self.bins[a] += inn
        self.bins[b] += out
        d = sum(got) - given
        self.fill[a] += d
        self.fill[b] -= d
        for x in (a, b):
            if 0 < self.fill[x] < self.room:
                self._list(x)
            else:
                self.open.discard(x)

    def run(self, passes: int) -> list[list[int]]:
        for _ in range(passes):
            changed = False
            emptiest = sorted(self.open, key=lambda b: (self.fill[b], b))[:8]
            for a in sorted(self.open, key=lambda b: (-self.fill[b], b)):
                while a in self.open:
                    own = sorted({self.sizes[i] for i in self.bins[a]})
                    best = None
                    for g in (0, *own):
                        x = self._single(a, g)
                        if x and (best is None or x[0] > best[0]):
                            best = (*x, g)
                    if best is None or self.fill[a] + best[0] < self.room:
                        two = self._pair(a, [0, *own], [b for b in emptiest if b in self.open])
                        if two and (best is None or two[0] > best[0]):
                            best = two
                    if best is None:
                        break
                    self._exchange(a, best[1], best[3], best[2])
                    changed = True
            if not changed:
                break
        return [b for b in self.bins if b]


def pack_block(uids: np.ndarray, sizes: np.ndarray, room: int, passes: int) -> tuple[list, list, list, list]:
    """One block packed: uid, bin number, offset and fill of every piece."""
    order = np.argsort(uids, kind="stable")
    n = sizes[order].tolist()
    bins = Search(n, best_fit(n, room), room).run(passes)
    u, number, offset, fill = [], [], [], []
    ids = uids[order].tolist()
    for k, b in enumerate(bins):
        total = 0
        for i in b:
            u.append(ids[i])
            number.append(k)
            offset.append(total)
            total += n[i]
        fill += [total] * len(b)
    return u, number, offset, fill


def block_packer(turn: int, room: int, passes: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u, number, offset, fill = pack_block(pdf["uid"].to_numpy(), pdf["length"].to_numpy(), room, passes)
        base = (turn << 56) + (int(key[0]) << 20)
        return pd.DataFrame({"uid": u, "sequence_id": [base + k for k in number], "offset": offset, "fill": fill})

    return run


def pack(
    parts: DataFrame, max_tokens: int = 2048, block: int = 16_384, slack: int = 8, passes: int = 6
) -> DataFrame:
    """Places for settled ``parts`` (uid, length): uid, sequence_id, offset, fill.

    Bins with at most ``slack`` free tokens are final. The pieces of the others
    go on to the next round, in fewer blocks, while that still closes bins.
    """
    full = parts.where(F.col("length") >= max_tokens).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill")
    )
    done, left = [full], parts.where(F.col("length") < max_tokens).select("uid", "length")
    n, turn = left.count(), 0
    while n:
        blocks = math.ceil(n / block)

        placed = settle(
            left.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(blocks)))
            .groupBy("block")
            .applyInPandas(block_packer(turn, max_tokens, passes), PLACED),
            "packed",
        )
        if blocks == 1:
            done.append(placed)
            break
        done.append(placed.where(F.col("fill") >= max_tokens - slack))
        left = settle(
            placed.where(F.col("fill") < max_tokens - slack).select("uid").join(left, "uid"), "underfull"
        )
        before, n, turn = n, left.count(), turn + 1
        if n > 0.9 * before:  # nothing more to gain: the pieces hardly combine
            done.append(placed.where(F.col("fill") < max_tokens - slack))
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, keep_ids: bool = False, **how: int
) -> DataFrame:
    """``docs`` (doc_id, text) as pieces with their places in sequences.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill
    and, with ``keep_ids``, the ids (little-endian unsigned 32-bit numbers).
    """
    parts = settle(pieces(docs, tokenizer, max_tokens, end_id, keep_ids), "pieces")
    out = parts.join(pack(parts, max_tokens, **how), "uid")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]
    return out.select(*cols, *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids, from pieces with their ids."""
    g = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")
    )
    return g.select("sequence_id", "n_tokens", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))
