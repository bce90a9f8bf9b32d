"""Operator 10: substring deduplication by content-defined chunking with a gear rolling hash.

Words are joined by single spaces, so white space does not matter. A gear hash over the last 8 bytes is taken at the end of each word. A chunk begins at
each word that has the least hash of some ``window`` words in a row (and at the first word): cuts depend on nearby bytes only, so an insertion moves no cut but
those beside it. A cut has two digests: of the ``look`` words from it on (the key), and of its chunk with the ``min_words`` words that follow (the whole).

Any two equal passages of ``min_words`` words hold one cut with its key in common, as the first whole window of hashes inside a passage decides it. Chunks are
deduplicated by the whole: where an earlier document has the same whole, the chunk and what follows are repeated, and of all its holders only the first goes on.
There, and where only keys are shared, the digests of the stretches of ``min_words`` words whose deciding key is shared are compared: a stretch that an earlier
document has is repeated. Stretches that overlap are one passage. So cuts choose where to look, wholes take copies out, and the stretches decide; no passage
of ``min_words`` words is missed.

Digests are aggregated before they are shuffled; repeats are joined to first documents, never to each other, so a group of n copies gives n rows.

Defined results: null and empty texts have no chunks. Rows of equal ids are one document, which does not repeat itself; rows without an id count as
one document after all others. Repeats inside a document are not reported. ``first_doc_id`` is the least id found to hold a part of ``min_words`` words.
An empty table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, map_text, stage

MIN_WORDS = 50
#: The gear hash sees so many bytes, which lie in so many words and the one that ends them.
GEAR_STEPS, GEAR_WORDS = (1, 2, 4), 4
#: Random numbers for bytes, from a fixed seed.
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
NO_ID = (1 << 63) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(b: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of GEAR of the last 8 bytes, shifted by their age."""
    h = GEAR[b]
    for m in GEAR_STEPS:
        more = h.copy()
        more[m:] += h[:-m] << np.uint32(m)
        h = more
    return h


def window(min_words: int) -> int:
    """Words in a row of which one begins a chunk: half of what a passage has, the other half is the key."""
    return max(1, (min_words - GEAR_WORDS + 1) // 2)


def least_of(h: np.ndarray, size: int) -> np.ndarray:
    """For each ``size`` values in a row the place of the least (the last of equals), by doubling."""
    if len(h) < size:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    x, held = (h.astype(np.uint64) << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64)), 1
    while 2 * held <= size:
        x, held = np.minimum(x[:-held], x[held:]), 2 * held
    if held < size:
        x = np.minimum(x[: len(x) - (size - held)], x[size - held :])
    return (low - (x & low)).astype(np.int64)


class Cut:
    """The words of a text, and its cuts."""

    def __init__(self, text: str, min_words: int):
        parts = text.encode("utf-8", "surrogatepass").split()
        self.n, self.min_words, self.size = len(parts), min_words, window(min_words)
        self.look = max(1, min_words - GEAR_WORDS - self.size + 1)
        self.raw = b" ".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, self.n)
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        self.least = least_of(gear(np.frombuffer(self.raw, np.uint8))[self.end - 1], self.size) if self.n else np.zeros(0, np.int64)
        self.cuts = np.unique(np.append(self.least, 0))
        self.cuts = self.cuts[self.cuts + self.look <= self.n]

    def digest(self, first: np.ndarray, last: np.ndarray) -> list[int]:
        """Of the words from each ``first`` to before each ``last``."""
        return [xxhash.xxh3_64_intdigest(self.raw[s:e]) - (1 << 63) for s, e in zip(self.start[first].tolist(), self.end[last - 1].tolist(), strict=True)]

    def until(self) -> np.ndarray:
        """Where each cut's whole ends: ``min_words`` after the next cut, or with the text."""
        return np.minimum(np.append(self.cuts[1:], self.n) + self.min_words, self.n)

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end in the text, in code points."""
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        space = _SPACE[b]
        chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        return chars[np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))], chars[np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1]


def chunk_table(docs: DataFrame, min_words: int) -> DataFrame:
    """key, whole, doc, h, at: a row for each cut. ``h`` tells texts of one id apart; texts shorter than ``min_words`` have none."""

    def make():
        def run(keys, texts):
            out = {"key": [], "whole": []}
            at, sizes = [], []
            for x in texts:
                c = Cut(x, min_words) if x else None
                if c is None or c.n < min_words:
                    sizes.append(0)
                    continue
                out["key"] += c.digest(c.cuts, c.cuts + c.look)
                until = c.until()
                whole = until - c.cuts >= min_words
                out["whole"] += c.digest(c.cuts[whole], until[whole]) + [None] * int((~whole).sum())  # lengths fall towards the end
                at.append(c.cuts)
                sizes.append(len(c.cuts))
            return out | {c: np.repeat(np.asarray(keys.field(c), np.int64), sizes) for c in ("doc", "h")} | {"at": np.concatenate([np.zeros(0, np.int32), *at]).astype(np.int32)}

        return run

    rows = docs.select(F.struct(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h")).alias("who"), "text")
    return map_text(rows, make, "key long, whole long, doc long, h long, at int", key="who")


def stretches(text: str, marks: list[dict], min_words: int) -> dict[str, list]:
    """What a text with the shared cuts ``marks`` (at; first, the earlier holder of its whole) has to report: repeated wholes (with ``first``), and stretches to be compared (with ``digest``)."""
    c = Cut(text, min_words)
    key, first = np.zeros(c.n + 1, bool), np.full(c.n + 1, NO_ID)
    for m in marks:
        key[m["at"]] = True
        if m["first"] is not None:
            first[m["at"]] = m["first"]
    begin, end = c.places(text)
    repeated = np.flatnonzero(first[c.cuts] < NO_ID)
    a, z = c.cuts[repeated], c.until()[repeated]
    # A stretch is decided by the least hash of its first whole window.
    s = np.arange(max(c.n - min_words + 1, 0))
    wanted = key[c.least[s + GEAR_WORDS]] if len(s) else np.zeros(0, bool)
    wanted &= first[c.cuts[np.searchsorted(c.cuts, s, side="right") - 1]] == NO_ID if len(s) else wanted
    s = np.flatnonzero(wanted)
    e = s + min_words
    return {
        "digest": [None] * len(a) + c.digest(s, e), "first": [*first[a].tolist(), *[None] * len(s)],
        "word": [*a.tolist(), *s.tolist()], "until": [*z.tolist(), *e.tolist()],
        "start": [*begin[a].tolist(), *begin[s].tolist()], "end": [*end[z - 1].tolist(), *end[e - 1].tolist()],
    }


def shared(table: DataFrame, digest: str) -> DataFrame:
    """``digest`` and ``first``, the first document, of the digests that several documents hold."""
    return table.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select(digest, "first")


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """As repeated_passages, with ``h``, which tells texts of one id apart. ``min_words`` is at least GEAR_WORDS + 1."""
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    table = stage(chunk_table(docs, min_words))
    keys = broadcast_if_small(stage(shared(table, "key").select("key")))
    marked = stage(table.join(keys, "key", "left_semi"))
    discard(table)
    marks = marked.join(broadcast_if_small(stage(shared(marked, "whole"))), "whole", "left").groupBy("doc", "h").agg(F.collect_set(F.struct("at", F.when(F.col("first") < F.col("doc"), F.col("first")).alias("first"))).alias("marks"))
    marks = broadcast_if_small(stage(marks))
    names = ("digest", "doc", "h", "first", "word", "until", "start", "end")
    kinds = {"word": pa.int32(), "until": pa.int32(), "start": pa.int32(), "end": pa.int32()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in names])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out = stretches(r["text"], r["marks"], min_words)
                n = len(out["word"])
                if n:
                    yield pa.RecordBatch.from_pydict(out | {"doc": [r["doc"]] * n, "h": [r["h"]] * n}, schema=schema)

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    asked = texts.join(marks, (texts["doc_id"] == marks["doc"]) & (texts["h"] == marks["h"])).select("doc", marks["h"], "text", "marks")
    asked = stage(asked.mapInArrow(look, "digest long, doc long, h long, first long, word int, until int, start int, end int"))
    tested = asked.where(F.col("digest").isNotNull())
    known = asked.where(F.col("digest").isNull()).drop("digest")
    again = tested.drop("first").join(shared(tested, "digest"), "digest").where("doc > first").select(known.columns)
    # What overlaps in one text is one passage; rows with equal ids and texts give equal rows, of which one is kept.
    own = Window.partitionBy("doc", "h").orderBy("word", "until", "start")
    before = F.max("until").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.unionByName(known).distinct().withColumn("new", F.coalesce(F.col("word") >= before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(own))
    merged = runs.groupBy("doc", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("until") - F.min("word")).alias("n_words"), F.min("first").alias("first"))
    return merged.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "h", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "n_words")], F.col("first").alias("first_doc_id"))


def repeated_passages(docs: DataFrame, **how) -> DataFrame:
    """doc_id, start, end (code points, end exclusive), n_words, first_doc_id: passages of a document that an earlier document holds."""
    return passages(docs, **how).drop("h")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """The same rows and columns, with the repeated passages cut out of ``text``; first holders stay whole."""
    spans = passages(docs.select("doc_id", "text"), **how).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = broadcast_if_small(stage(spans))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, new = b.column("row"), []
            for text, spans in zip(row.field("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                for s in reversed(spans or []):
                    text = text and text[: s["start"]] + text[s["end"] :]
                new.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else row.field(c) for c in names], names=names)

    return rows.join(spans, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("h")), "left").select("row", "spans").mapInArrow(cut, docs.schema)
