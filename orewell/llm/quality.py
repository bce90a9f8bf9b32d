"""Operator 3: a quality classifier by nearest-neighbour voting.

A text becomes counts of word shapes, of hashed words and of its own repetition (distinct words, equal neighbours, equal lines), and then a
latent-semantic vector: log counts times inverse document frequency, projected on the leading singular vectors. Both are fitted on the
labelled rows that vote. Every document meets all voters in blocks of exact cosine products; the nearest vote, weighted by similarity.

The voters are a sample of labelled rows of at most ``voters`` (the bound of what the driver holds and broadcasts: voters x dims floats),
those with the least hash of id, text and label. Everything else covers all documents and whole texts.

Defined results: a null or blank text scores the share of label 1 among the voters. Without any voter every score is 0.5. Null labels
don't vote; a document labelled differently in several rows votes with each. Equal texts score alike. An empty table gives an empty table.
Only the id and the text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_text

VOTERS, DIMS, NEAREST = 4000, 48, 24
SHAPES, WORDS, OWN = 256, 512, 32
TERMS = SHAPES + WORDS + OWN
SYMBOLS = set("#*$%&|<>!?=+~^@/\\_{}[]")


def word_terms(w: str) -> int:
    """A word's shape (case, symbols, digits, length) and the bucket of its letters, as one number."""
    core = w.strip(".,;:")
    case = 0 if core.islower() else 1 if core[:1].isupper() and core[1:].islower() else 2 if core.isupper() else 3
    symbols = min(3, sum(c in SYMBOLS for c in core))
    shape = case + 4 * symbols + 16 * any(c.isdigit() for c in core) + 32 * min(7, len(core) // 3)
    return shape * WORDS + zlib.crc32(core.lower().encode()) % WORDS


class Featurizer:
    """Rows of term counts for texts; remembers the terms of words, up to a fixed bound."""

    def __init__(self, bound: int = 400_000):
        self.known, self.bound = {}, bound

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), TERMS), np.float32)
        if len(self.known) > self.bound:
            self.known = {}
        known = self.known
        for row, text in zip(out, texts, strict=True):
            words = WORD.findall(text or "")
            if not words:
                continue
            distinct = set(words)
            for w in distinct:
                if w not in known:
                    known[w] = word_terms(w)
            codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            row[:SHAPES] = np.bincount(codes // WORDS, minlength=SHAPES)
            row[SHAPES : SHAPES + WORDS] = np.bincount(codes % WORDS, minlength=WORDS)
            n = len(words)
            lines = [x for x in text.split("\n") if x]
            again = int(np.count_nonzero(codes[1:] == codes[:-1]))
            for k, share in enumerate((len(distinct) / n, again / n, 1 - len(set(lines)) / max(1, len(lines)))):
                row[SHAPES + WORDS + 10 * k + min(9, int(10 * share))] = n  # as heavy as all the words
        return out


class Model:
    """Weights of terms, the projection, and the voters' vectors and labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dims: int = DIMS, nearest: int = NEAREST):
        self.nearest = min(nearest, len(labels))
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        if len(labels):
            self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
            x = self._weighted(counts)
            _, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
            self.basis = np.ascontiguousarray(vectors[:, ::-1][:, : min(dims, x.shape[1])], np.float32)
            self.voters = np.ascontiguousarray(self.vectors(counts).T)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        # Shares, not counts, so that length does not decide; log keeps frequent terms from drowning the rest.
        share = counts / np.maximum(counts[:, :SHAPES].sum(1, keepdims=True), 1)
        x = np.log1p(100 * share) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = self._weighted(counts) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if self.nearest:
            for i in range(0, len(counts), block):
                c = counts[i : i + block]
                near = self.vectors(c) @ self.voters
                top = np.argpartition(-near, self.nearest - 1, axis=1)[:, : self.nearest]
                weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** 8 + 1e-6
                vote = (weight * self.labels[top]).sum(1) / weight.sum(1)
                out[i : i + block] = np.where(c.any(1), np.clip(vote, 0, 1), self.prior)
        return out


def fold(key):
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def held_out(key):
    """A row without an id is in no fold, so it is not held out."""
    return F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", voters: int = VOTERS, dims: int = DIMS, nearest: int = NEAREST) -> Model:
    """The model from the labelled rows outside the held-out fold: at most ``voters`` of them."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # Voters are different (id, text, label): repeated rows and labels without a document take no place, and no id sends more than its texts.
    voting = texts.select("doc_id", "h").distinct().join(marked, "doc_id").orderBy(F.xxhash64("doc_id", "h", "label"), "doc_id", "h", "label").limit(voters)
    held = texts.join(F.broadcast(voting), ["doc_id", "h"]).select(F.struct("doc_id", "h", "label").alias("who"), "text")  # at most voters rows

    def make():
        f = Featurizer()
        return lambda keys, texts: {c: keys.field(c) for c in ("doc_id", "h", "label")} | {"counts": [r.tobytes() for r in f(texts)]}

    found = map_text(held, make, "doc_id long, h long, label int, counts binary", key="who").groupBy("doc_id", "h", "label").agg(F.first("counts").alias("counts"))
    rows = sorted((r.doc_id, r.label, r.counts) for r in found.collect())  # one for each voter
    counts = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, TERMS)
    return Model(counts, np.array([r[1] for r in rows], np.float32), dims, nearest)


def score_quality(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each input row: the key and ``score``, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f, m = Featurizer(), shared.value
        return lambda keys, texts: {key: keys, "score": m.score(f(texts))}

    return map_text(docs, make, f"{key} {docs.schema[key].dataType.simpleString()}, score double", key, text)


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.3 on)."""
    scored = score_quality(docs, fit(docs, labels, **how))
    return scored.select("doc_id", held_out(F.col("doc_id")), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
