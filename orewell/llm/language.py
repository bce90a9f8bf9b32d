"""Operator 8: language identification of mixed text.

Each word is scored by its letter n-grams for every learned language; the scripts that a language's training text uses narrow the
candidates of a word. Viterbi over a text's words, with a penalty for each switch, labels spans. The language of most letters wins.

The model is fitted on at most ``sample`` labelled rows (those with the least hash of the id) with whole texts; n-grams are counted on the
executors and fall in a fixed number of buckets, so the model's size is fixed by languages x buckets.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if nothing was learned. Ties go to the first language
by name. Equal texts get equal results. A row without an id is not held out, and nothing is learned from it. An empty table gives an empty table. Only the id, the text and (to learn) the language are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text
from .quality import fold, held_out

SAMPLE, BUCKETS, SWITCH = 6000, 1 << 15, 6.0
#: Words are runs of letters (Unicode category L): numerals such as a half or a raised two are none.
LETTERS = regex.compile(r"\p{L}+")
#: Scripts by ranges of code points.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = tuple(dict.fromkeys(n for n, _, _ in SCRIPTS)) + ("other",)


_FROM = np.array([a for _, a, _ in SCRIPTS])
_TO = np.array([b for _, _, b in SCRIPTS])
_OF = np.array([NAMES.index(n) for n, _, _ in SCRIPTS])


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter, as a place in NAMES."""
    c = np.array([ord(w[0]) for w in words], np.int64)
    inside = (c[:, None] >= _FROM) & (c[:, None] <= _TO)
    return np.where(inside.any(1), _OF[inside.argmax(1)], len(NAMES) - 1)


def grams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, word numbers), sorted by word: the n-grams of one to four letters of lower-case words with marked ends, then whole words."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in marked], np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out, h = [], np.zeros(len(code), np.uint64)
    for n in (1, 2, 3, 4):
        h[: len(code) - n + 1] = h[: len(code) - n + 1] * np.uint64(0xBF58476D1CE4E5B9) + mixed[n - 1 :]
        inside = np.flatnonzero(owner[: len(code) - n + 1] == owner[n - 1 :])
        out.append((_bucket(h[inside] + np.uint64(n)), owner[inside]))
    place = (np.arange(len(code)) - start[owner] + 1).astype(np.uint64)
    out.append((_bucket(np.add.reduceat((mixed + place) * (mixed ^ (place * np.uint64(0x94D049BB133111EB))), start)), np.arange(len(words))))
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(30))) % np.uint64(BUCKETS)).astype(np.int64)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        p = counts + 0.5
        self.logp = np.log(p / p.sum(1, keepdims=True)).T.astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
        uses = scripts >= 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)
        self.barred = np.where(uses | ~uses.any(0), 0, -1e4).T.astype(np.float32)  # a script that no language uses bars none


class Labeler:
    """Language spans of texts; remembers the scores of words, up to a fixed bound."""

    def __init__(self, model: Model, switch: float = SWITCH, bound: int = 200_000):
        self.m, self.switch, self.bound = model, switch, bound
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(self.m.langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        new = list({w for w in words if w not in self.at})
        if len(self.at) + len(new) > self.bound and self.at:
            self._forget()
            new = list(set(words))
        if not new or not self.m.langs:
            self.at.update((w, 0) for w in new)
            self.table = np.zeros((1, len(self.m.langs)), np.float32) if not len(self.table) else self.table
            return
        parts = [self._score(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
        rows = np.vstack(parts)
        n = len(self.at)
        self.at.update((w, n + i) for i, w in enumerate(new))
        self.table = np.vstack([self.table, rows])

    def _score(self, words: list[str]) -> np.ndarray:
        total, n = np.zeros((len(words), len(self.m.langs)), np.float32), np.zeros(len(words))
        for buckets, owner in grams([w.lower() for w in words]):
            held = np.bincount(owner, minlength=len(words))
            some = np.flatnonzero(held)
            if len(some):
                first = np.cumsum(held)[some] - held[some]
                total[some] += np.add.reduceat(self.m.logp[buckets], first, axis=0)
                n += held
        s = total / n[:, None] * np.minimum([len(w) for w in words], 8)[:, None] ** 0.5 + self.m.barred[scripts_of(words)]
        return (s - s.max(1, keepdims=True)).astype(np.float32)

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text's words the language that Viterbi gives each word, as places in ``langs``. All texts go step by step together."""
        flat = [w for ws in texts for w in ws]
        self._learn(flat)
        scores = self.table[np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))]
        sizes = np.array([len(ws) for ws in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(-sizes, kind="stable")
        size, start = sizes[order], starts[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")  # texts with more than t words
        v = np.zeros((len(texts), len(self.m.langs)), np.float32)
        stay = np.zeros(scores.shape, bool)
        best = np.zeros(len(flat), np.int16)
        for t, m in enumerate(active):
            at = start[:m] + t
            if t:
                prev = v[:m]
                best[at] = b = prev.argmax(1)
                jump = prev[np.arange(m), b] - self.switch
                stay[at] = keep = prev >= jump[:, None]
                v[:m] = np.where(keep, prev, jump[:, None]) + scores[at]
            else:
                v[:m] = scores[at]
        out = np.zeros(len(flat), np.int16)
        lab = v.argmax(1) if len(self.m.langs) else np.zeros(len(texts), np.int64)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            at = start[:m] + t
            out[at] = now = lab[:m]
            lab[:m] = np.where(stay[at, now], now, best[at])
        return [out[a : a + n] for a, n in zip(starts, sizes, strict=True)]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(language, start, end) in code points, from a span's first letter to its last."""
        found = list(LETTERS.finditer(text or ""))
        if not found or not self.m.langs:
            return []
        labels = self.labels([[m[0] for m in found]])[0]
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(found)]
        return [(self.m.langs[labels[a]], found[a].start(), found[b - 1].end()) for a, b in zip(cuts, cuts[1:], strict=False)]

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language that holds most letters, and its share of the letters."""
        words = [LETTERS.findall(x or "") for x in texts]
        out = []
        for ws, labels in zip(words, self.labels(words), strict=True):
            if not ws or not self.m.langs:
                out.append(("und", 0.0))
                continue
            held = np.bincount(labels, np.fromiter(map(len, ws), np.float64, len(ws)), len(self.m.langs))
            k = int(held.argmax())
            out.append((self.m.langs[k], float(held[k] / held.sum())))
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` rows with a language outside the held-out fold."""
    # Sampled are different (id, language, text): repeated rows take no place, and no id sends more than its texts.
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    some = rows.select("doc_id", "lang", "h").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "h").limit(sample)
    train = rows.join(F.broadcast(some), ["doc_id", "lang", "h"]).groupBy("doc_id", "lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches):
        held: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[lang].update(LETTERS.findall((text or "").lower()))
        for lang, words in held.items():
            keys, times = list(words), np.array(list(words.values()), float)
            found = np.zeros(BUCKETS + len(NAMES))
            for i in range(0, len(keys), 20_000):
                some, n = keys[i : i + 20_000], times[i : i + 20_000]
                for buckets, owner in grams(some):
                    found += np.bincount(buckets, n[owner], len(found))
                found += np.bincount(BUCKETS + scripts_of(some), n, len(found))
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "gram": pa.array(at, pa.int32()), "n": pa.array(found[at].astype(np.int64))})

    rows = train.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()  # languages x buckets at most
    langs = sorted({r[0] for r in rows})
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    for lang, g, n in rows:
        counts[langs.index(lang), g] = n
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH) -> DataFrame:
    """A row for each input row: the key, ``lang_pred`` and ``score``, the share of letters in that language's spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f = Labeler(shared.value, switch)

        def run(keys, texts):
            found = f.languages(texts)
            return {key: keys, "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

        return run

    return map_text(docs, make, f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double", key, text)


def language_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH) -> DataFrame:
    """A row for each input row: the key and ``spans``, array of (lang, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f = Labeler(shared.value, switch)
        return lambda keys, texts: {key: keys, "spans": [[{"lang": k, "start": s, "end": e} for k, s, e in f.spans(x)] for x in texts]}

    return map_text(docs, make, f"{key} {docs.schema[key].dataType.simpleString()}, spans array<struct<lang:string,start:int,end:int>>", key, text)


def document_languages(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return identify(docs, fit(docs, **how)).select("doc_id", held_out(F.col("doc_id")), "lang_pred", "score")
