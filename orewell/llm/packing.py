"""Operator 5: packing documents into sequences by length patterns and non-negative least squares.

Documents are tokenised on the executors; only the histogram of piece lengths (one row for each length) reaches the driver. There, patterns
of two or three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares, rounded, and what remains is packed best-fit, again length by length. The plan is a list of (pattern, repeats): its size is bounded
by the sequence length, not by the data. Each piece gets its rank among the pieces of its length and so its place in the plan.

Ranks are counted in salted groups, so that one frequent length is spread over tasks; the groups' sizes make the ranks whole.

Defined results: a null or empty text is the end id alone. A longer document is cut into full sequences, after a first piece that may be
shorter. Equal rows are packed each for itself. An empty table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TextEncoder, map_text, stage

CAPACITY, END, ROUNDS, GROUP_ROWS = 2048, 0, 300, 200_000


def patterns(hist: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the capacity, of lengths that occur; hist[l] is the number of pieces of length l."""
    c = len(hist) - 1
    have = hist > 0
    two = np.arange(1, c // 2 + 1)
    out = [np.stack([np.zeros_like(two), two, c - two], 1)]
    for a in range(1, c // 3 + 1):
        if have[a]:
            b = np.arange(a, (c - a) // 2 + 1)
            out.append(np.stack([np.full_like(b, a), b, c - a - b], 1))
    p = np.concatenate(out)
    return p[(have[p] | (p == 0)).all(1)]


def fit_repeats(p: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises the squared error of the pieces used, long pieces weighing more: accelerated projected gradient."""
    c = len(hist) - 1
    w = (np.arange(c + 1) / c) ** 0.5
    w[0] = 0
    goal = hist * w

    def use(x):
        return sum(np.bincount(p[:, k], x, c + 1) for k in range(3)) * w

    def back(r):
        r = r * w
        return sum(r[p[:, k]] for k in range(3))

    v = np.ones(len(p))
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(use(v))
        step = np.linalg.norm(v)
        v /= step
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(use(y) - goal) / step, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that hold every piece of the histogram once."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    c = len(left) - 1
    out: list[tuple[tuple[int, ...], int]] = [((c,), int(left[c]))] if left[c] else []
    left[c] = 0
    p = patterns(left)
    if len(p):
        x = fit_repeats(p, left)
        rest = left.tolist()
        for lengths, most in _rounded(p, x):
            need: dict[int, int] = {}
            for n in lengths:
                need[n] = need.get(n, 0) + 1
            times = min(most, *(rest[n] // k for n, k in need.items()))
            if times > 0:
                out.append((lengths, times))
                for n, k in need.items():
                    rest[n] -= k * times
        left = np.array(rest)
    return out + best_fit(left)


def _rounded(p: np.ndarray, x: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
    """Whole parts first, then single repeats, patterns of the largest remainder first."""
    whole = np.floor(x).astype(np.int64)
    for i in np.flatnonzero(whole):
        yield tuple(int(n) for n in p[i] if n), int(whole[i])
    part = x - whole
    order = np.argsort(-part, kind="stable")
    for row in p[order[part[order] > 1e-3]].tolist():
        yield tuple(n for n in row if n), 1


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: bins of equal content are one entry."""
    c = len(left) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by free space
    spaces: list[int] = []

    def put(space: int, content: tuple[int, ...], n: int) -> None:
        if space not in open_:
            open_[space] = []
            insort(spaces, space)
        open_[space].append((content, n))

    for n in range(c, 0, -1):
        count = int(left[n])
        while count:
            at = bisect_left(spaces, n)
            if at == len(spaces):
                fit = c // n
                if count >= fit:
                    put(c - fit * n, (n,) * fit, count // fit)
                if count % fit:
                    put(c - count % fit * n, (n,) * (count % fit), 1)
                break
            space = spaces[at]
            content, bins = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces.pop(at)
            used = min(bins, count)
            put(space - n, (*content, n), used)
            if bins > used:
                put(space, content, bins - used)
            count -= used
    return [x for held in open_.values() for x in held]


class Places:
    """Where the piece of a length and a rank goes: arrays sorted by length and rank."""

    SHIFT = 1 << 44

    def __init__(self, packed: list[tuple[tuple[int, ...], int]]):
        sequence, rows = 0, []
        for lengths, times in packed:
            offset = 0
            for n in lengths:
                rows.append((n, times, sequence, offset))
                offset += n
            sequence += times
        n, times, seq, off = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([],) * 4))
        order = np.argsort(n, kind="stable")
        n, times, self.sequence, self.offset = n[order], times[order], seq[order], off[order]
        ends = np.cumsum(times)
        first = np.searchsorted(n, n)  # the first entry of the same length
        self.begin = ends - times - (ends - times)[first] if len(n) else ends
        self.key = n * self.SHIFT + self.begin

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * self.SHIFT + rank, side="right") - 1
        return self.sequence[at] + rank - self.begin[at], self.offset[at]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32: each document's ids and the end id, cut only if longer than the capacity."""

    def make():
        encode, tail = TextEncoder(vocabulary), np.uint32(end).tobytes()

        def run(keys, texts):
            out = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for row, ids in enumerate(encode(texts)):
                ids += tail
                n = len(ids) // 4
                first = n - (n - 1) // capacity * capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    size = first if k == 0 else capacity
                    for c, v in zip(out, (row, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])), strict=True):
                        out[c].append(v)
            return {key: keys.take(pa.array(out.pop("row"), pa.int64()))} | out

        return run

    return map_text(docs, make, f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long", key, text)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (with ``length``, at most the capacity) with ``sequence_id`` and ``offset``. Sequences are gapless from 0."""
    names = found.columns
    # Each row's own number is written with it, so that equal rows are dealt to all groups, and always to the same ones.
    held = stage(found.withColumn("_number", F.monotonically_increasing_id()))
    groups = max(16, -(-held.count() // GROUP_ROWS))
    rows = held.withColumn("salt", F.pmod(F.xxhash64("_number"), F.lit(groups))).drop("_number")
    sizes = stage(rows.groupBy("length", "salt").agg(F.count("*").alias("held")))
    hist = np.zeros(capacity + 1, np.int64)
    for n, held in sizes.groupBy("length").agg(F.sum("held")).collect():  # a row for each length
        hist[n] = held
    places = found.sparkSession.sparkContext.broadcast(Places(plan(hist)))
    before = F.sum("held").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("held")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*names)) - 1).join(offsets, ["length", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.of(np.asarray(b.column("length"), np.int64), np.asarray(b.column("rank"), np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = found.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, (F.col("rank") + F.col("before")).cast("long").alias("rank")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The contract's rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack(pieces(docs, vocabulary, capacity, end), capacity)
