"""Operator 2: near-duplicates by DartMinHash signatures and banded joining.

A document is a weighted set of word shingles. Each element owns a region as wide as its weight, and darts fall on it in the order of
their rank, as a Poisson process that the element's hash alone determines: a dart has a rank, a place in the region and a coordinate of the
signature. A dart beyond the element's weight misses. The signature keeps the earliest dart of each coordinate, so two sets agree on a
coordinate with the probability of their weighted Jaccard similarity. About k log k darts fill k coordinates, however many elements there are.

Signatures are cut into bands; documents that agree on a band are in one bucket. Two steps find the links, each in blocks of bounded size, so no bucket is
held by one task and no group of copies is expanded into pairs:

1. In each block of a bucket a spanning forest of the likeliest pairs (most equal coordinates) is checked by the exact similarity of the shingles. In a
   group of n copies that is n - 1 pairs.
2. In buckets whose members are still of several classes, the members outside the largest class meet the others. A pair of different classes is checked
   unless sizes or signatures rule it out, in the first band on which both agree, and in no other.

So every candidate pair is checked, is in one class already, or is ruled out. Only signatures (2 bytes a coordinate) go to the buckets; shingles go to blocks
that have a pair to check, once for each member. Signatures rule a pair out that has SLACK standard deviations fewer equal coordinates than the similarity asks for.

With BANDS bands of ROWS coordinates a pair of similarity 0.8 is missed with probability (1 - 0.8**ROWS)**BANDS = 3e-6, and ruled out with 3e-6. Production weights are 1 for
each different shingle, so the similarity is that of shingle sets; ``weights="count"`` weighs by occurrences.

Defined results: words are runs without white space; fewer words than a shingle are one shingle. Texts without a word (empty or blank) are copies of
each other; a null text is a class of its own, with its own id. Equal rows are copies. A class is named by its least id; null ids count last. An
empty table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, discard, groups, map_text, stage
from .components import components

WORDS, SIMILARITY, BANDS, ROWS, SLACK = 5, 0.8, 24, 4, 4.8
K = BANDS * ROWS
#: About the most rows, and shingles, of a block of a bucket.
BLOCK, BLOCK_WEIGHT = 512, 1_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's words (remembered up to a bound) and of its shingles."""

    def __init__(self, size: int = WORDS, bound: int = 400_000):
        self.size, self.bound, self.known = size, bound, {}

    def words(self, text: str) -> np.ndarray:
        found = WORD.findall(text)
        if len(self.known) > self.bound:
            self.known = {}
        known = self.known
        for w in [w for w in set(found) if w not in known]:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def shingles(self, h: np.ndarray) -> np.ndarray:
        n = min(self.size, len(h))
        if not n:
            return h
        s = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            s = mix(s + h[i : len(h) - n + 1 + i] + np.uint64((i + 1) * int(_STEP) % 2**64))
        return s


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k signatures of n weighted sets given as rows (owner, element hash, weight); 0 where a set has no element.

    All sets go together: first the darts up to the rank at which each set should have k log k + 2 k, then twice as far for those with a
    coordinate that no dart has hit.
    """
    best = np.full(n * k, np.inf)
    total = np.bincount(owner, weight, n)
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    # The region [0, weight) is cut at powers of two; each part has its own darts, so equal elements of other weights share them.
    top = np.maximum(np.ceil(np.log2(np.maximum(weight, 1e-300))), 0).astype(np.int64)
    parts = top + 1
    e = np.repeat(np.arange(len(element)), parts)
    part = np.arange(len(e)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(part == 0, 0.0, 2.0 ** (part - 1))
    width = np.where(part == 0, 1.0, low)
    seed = mix(element[e] + mix(part.astype(np.uint64) + _STEP))
    who, w = owner[e], weight[e]
    rank = np.zeros(len(e))
    turn = np.zeros(len(e), np.uint64)
    while len(e):
        live = np.arange(len(e))
        while len(live):  # the next dart of each region, until its rank is beyond the set's limit
            d = mix(seed[live] + (turn[live] + np.uint64(1)) * _STEP)
            u = ((d >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            after = rank[live] - np.log(u) / width[live]
            inside = after <= limit[who[live]]
            live, d, after = live[inside], d[inside], after[inside]
            rank[live] = after
            turn[live] += np.uint64(1)
            p = mix(d ^ _M1)
            hit = low[live] + width[live] * ((p >> np.uint64(40)).astype(np.float64) * 2.0**-24) < w[live]
            at = who[live][hit] * k + ((p[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, at, after[hit])
        short = np.isinf(best.reshape(n, k)).any(1) & (total > 0)
        limit[short] *= 2
        more = short[who]
        e, seed, who, w, rank, turn, low, width = (a[more] for a in (e, seed, who, w, rank, turn, low, width))
    best[np.isinf(best)] = 0
    return best.reshape(n, k).view(np.uint64)


def _weighted(s: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray]:
    values, times = np.unique(s, return_counts=True)
    return values, times.astype(float) if weights == "count" else np.ones(len(values))


def row_hash() -> F.Column:
    """With the id this tells a row's text from other texts under the same id."""
    return F.xxhash64("text")


def nodes(docs: DataFrame, weights: str = "set", size: int = WORDS, k: int = K) -> DataFrame:
    """doc_id, ``h`` (row_hash), ``node`` (hash of the words in order; null for a null text), ``size`` (its weight in all), ``sig`` (16 bits for each coordinate; null without a word)."""

    def make():
        shingler = Shingler(size)

        def run(keys, texts):
            hashes = [shingler.words(x or "") for x in texts]
            sets = [_weighted(shingler.shingles(h), weights) for h in hashes]
            owner = np.repeat(np.arange(len(texts)), [len(v) for v, _ in sets])
            sig = signatures(owner, np.concatenate([v for v, _ in sets]), np.concatenate([w for _, w in sets]), len(texts), k)
            short = (mix(sig) & np.uint64(0xFFFF)).astype("<u2")
            node = [None if x is None else _node(h) for x, h in zip(texts, hashes, strict=True)]
            return {"doc_id": keys.field("doc_id"), "h": keys.field("h"), "node": node, "size": [float(w.sum()) for _, w in sets], "sig": [s.tobytes() if len(h) else None for s, h in zip(short, hashes, strict=True)]}

        return run

    rows = docs.select(F.struct("doc_id", row_hash().alias("h")).alias("who"), "text")
    return map_text(rows, make, "doc_id long, h long, node long, size double, sig binary", key="who")


def _node(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, weights: str) -> DataFrame:
    """node, ``s`` (sorted shingle hashes), ``w`` (weights; empty for sets) of the nodes of ``wanted`` (node, doc_id, h: a row that holds it)."""

    def make():
        shingler = Shingler(size)

        def run(keys, texts):
            sets = [_weighted(shingler.shingles(shingler.words(x)), weights) for x in texts]
            return {"node": keys, "s": [v.view(np.int64) for v, _ in sets], "w": [w.astype(np.int32) if weights == "count" else [] for _, w in sets]}

        return run

    # Rows with equal ids and texts hold one node; the aggregate leaves one of them before texts become sets.
    texts = docs.select("doc_id", "text", row_hash().alias("h")).where(F.col("text").isNotNull())
    asked = broadcast_if_small(stage(wanted)).alias("w")
    held = texts.alias("d").join(asked, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.h") == F.col("w.h"))).select("w.node", "d.text")
    return map_text(held, make, "node long, s array<long>, w array<int>", key="node").groupBy("node").agg(F.first("s").alias("s"), F.first("w").alias("w"))


class Sets:
    """The shingle sets of a table's rows, side by side."""

    def __init__(self, t: pa.Table):
        self.s, self.at = self._flat(t, "s")
        self.w, held = self._flat(t, "w")
        if len(self.w) == 0 and len(self.s):
            self.w, held = np.ones(len(self.s), np.int32), self.at
        self.total = np.add.reduceat(np.append(self.w, 0), held[:-1]) * (np.diff(held) > 0) if len(held) > 1 else np.zeros(0)

    @staticmethod
    def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        c = t.column(name).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        return c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def alike(self, one: int, others: np.ndarray, least: float) -> np.ndarray:
        """Which rows ``others`` have at least the similarity ``least`` to the row ``one``: exact, on the shingle hashes."""
        own, weight = self.s[self.at[one] : self.at[one + 1]].view(np.uint64), self.w[self.at[one] : self.at[one + 1]]
        sizes = self.at[others + 1] - self.at[others]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(self.at[others] - (ends - sizes), sizes)
        all_ = self.s[place].view(np.uint64)
        to = np.minimum(np.searchsorted(own, all_), len(own) - 1)
        both = np.where(own[to] == all_, np.minimum(weight[to], self.w[place]), 0)
        both = np.add.reduceat(both, ends - sizes)
        return both >= least * (self.total[one] + self.total[others] - both) - 1e-9


def agreements(x: np.ndarray, y: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of signatures the number of equal coordinates, and the first band on which they agree (-1: none)."""
    same = x[:, None, :] == y[None, :, :]
    band = same.reshape(len(x), len(y), -1, rows).all(3)
    return same.sum(2), np.where(band.any(2), band.argmax(2), -1)


def _signatures(t: pa.Table) -> np.ndarray:
    c = t.column("sig").combine_chunks()
    return np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(t.num_rows, -1)


def forest(size: np.ndarray, sig: np.ndarray, least: float, enough: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the likeliest pairs: Prim's on the number of equal coordinates; no edge below ``enough`` or ruled out by sizes."""
    n = len(size)
    same = (sig[:, None, :] == sig[None, :, :]).sum(2)
    same[np.minimum(size[:, None], size) < least * np.maximum(size[:, None], size) - 1e-9] = 0
    best, near, out = same[0].copy(), np.zeros(n, np.int64), []
    best[0] = -1
    for _ in range(n - 1):
        j = int(best.argmax())
        if best[j] >= enough:
            out.append((int(near[j]), j))
        best[j] = -1
        nearer = (same[j] > best) & (best >= 0)
        best[nearer], near[nearer] = same[j][nearer], j
    return out


def blocks_of(rows: str, weight: str) -> F.Column:
    """Into how many blocks a group is dealt, so that a block has about BLOCK rows and BLOCK_WEIGHT shingles at most."""
    return F.greatest(F.ceil(F.col(rows) / F.lit(BLOCK)), F.ceil(F.col(weight) / F.lit(BLOCK_WEIGHT))).cast("int")


def likely_pairs(rows: DataFrame, least: float, enough: int) -> DataFrame:
    """Pairs (a, b) of a spanning forest for each block of each bucket; ``rows``: bk, part, node, size, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, "bk", "part"):
            node, size, sig = t.column("node").to_numpy(), t.column("size").to_numpy(), _signatures(t)
            ends = np.append(starts[1:], t.num_rows)
            two = starts[ends - starts == 2]
            ok = ((sig[two] == sig[two + 1]).sum(1) >= enough) & (np.minimum(size[two], size[two + 1]) >= least * np.maximum(size[two], size[two + 1]) - 1e-9)
            a, b = [*two[ok]], [*(two[ok] + 1)]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 2:
                    for i, j in forest(size[s:e], sig[s:e], least, enough):
                        a.append(s + i)
                        b.append(s + j)
            x, y = node[a], node[b]
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    return rows.repartition("bk", "part").sortWithinPartitions("bk", "part").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, table: DataFrame, least: float, size: int, weights: str) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``least``. Sets go to blocks of a node's partners: once for each partner, and once for the block."""
    count = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(count, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    members = dealt.select("a", "part", F.col("b").alias("node")).union(dealt.select("a", "part", F.col("a").alias("node")).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = shingle_sets(docs, table.join(wanted, "node", "left_semi").select("node", "rep.*"), size, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, "a", "part"):
            node, first, sets = t.column("node").to_numpy(), t.column("a").to_numpy(), Sets(t)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                one = s + int(np.flatnonzero(node[s:e] == first[s])[0])
                others = np.array([i for i in range(s, e) if i != one], np.int64)
                yes = others[sets.alike(one, others, least)]
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.full(len(yes), first[s])), "b": pa.array(node[yes])})

    joined = members.join(sets, "node").select("a", "part", "node", "s", "w")
    return joined.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(run, "a long, b long")


def across(rows: DataFrame, least: float, enough: int, band_rows: int) -> DataFrame:
    """What may still be linked: ``rows`` (bk, band, node, size, sig, root) of buckets of several classes, in blocks that hold each pair of classes' members once.

    A bucket's rows outside its largest class (``asks``) meet all its rows, in blocks of both. Left are rows with a partner of another class
    that the sizes and the signatures allow, and for which this is the first band on which both agree.
    """
    members = rows.groupBy("bk", "root").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    bucket = members.groupBy("bk").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("classes")).where("classes > 1")
    of_most = members.select("bk", F.col("root").alias("r"), F.col("w").alias("most_w"))
    bucket = bucket.join(of_most, (bucket["bk"] == of_most["bk"]) & (bucket["most.root"] == of_most["r"])).select(bucket["bk"], F.col("most.root").alias("major"), F.col("n"), F.col("w"), (F.col("n") - F.col("most.n")).alias("ask_n"), (F.col("w") - F.col("most_w")).alias("ask_w"))
    bucket = bucket.select("bk", "major", blocks_of("n", "w").alias("parts"), blocks_of("ask_n", "ask_w").alias("ask_parts"))
    some = rows.join(bucket, "bk")
    own = lambda parts, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    names = ("bk", "band", "node", "size", "sig", "root")
    asks = some.where("root <> major").select(*names, F.lit(True).alias("asks"), own("ask_parts", 1).alias("i"), every("parts").alias("j"))
    held = some.select(*names, F.lit(False).alias("asks"), every("ask_parts").alias("i"), own("parts", 2).alias("j"))
    dealt = asks.unionByName(held).repartition("bk", "i", "j").sortWithinPartitions("bk", "i", "j", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, "bk", "i", "j"):
            keep = np.zeros(t.num_rows, bool)
            for s, asks, held, ok in _open_pairs(t, starts, least, enough, band_rows):
                keep[asks], keep[held] = keep[asks] | ok.any(1), keep[held] | ok.any(0)
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    return dealt.mapInArrow(run, dealt.schema)


def _open_pairs(t: pa.Table, starts: np.ndarray, least: float, enough: int, band_rows: int):
    node, size, root, asks, band = (t.column(c).to_numpy() for c in ("node", "size", "root", "asks", "band"))
    sig, asks = _signatures(t), asks.astype(bool)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
        i, j = s + np.flatnonzero(asks[s:e]), s + np.flatnonzero(~asks[s:e])
        if not len(i) or not len(j):
            continue
        same, first = agreements(sig[i], sig[j], band_rows)
        ok = (same >= enough) & (first == band[i][:, None]) & (first == band[j]) & (root[i][:, None] != root[j])
        ok &= np.minimum(size[i][:, None], size[j]) >= least * np.maximum(size[i][:, None], size[j]) - 1e-9
        if ok.any():
            yield s, i, j, ok


def remaining(rows: DataFrame, docs: DataFrame, table: DataFrame, least: float, enough: int, band_rows: int, size: int, weights: str) -> DataFrame:
    """Links (a, b) between the classes so far, all of those that the buckets of ``rows`` make candidates."""
    few = stage(across(rows, least, enough, band_rows))
    sets = shingle_sets(docs, table.join(few.select("node").distinct(), "node", "left_semi").select("node", "rep.*"), size, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, "bk", "i", "j"):
            node, sets, done, a, b = t.column("node").to_numpy(), Sets(t), set(), [], []
            root = t.column("root").to_numpy()
            for _, asks, held, ok in _open_pairs(t, starts, least, enough, band_rows):
                for x, mates in zip(asks.tolist(), ok, strict=True):
                    others = held[mates]
                    for y in others[sets.alike(x, others, least)].tolist() if len(others) else ():
                        if (root[x], root[y]) not in done:  # one link joins two classes
                            done.add((root[x], root[y]))
                            a.append(node[x])
                            b.append(node[y])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    joined = few.join(sets, "node").select("bk", "i", "j", "asks", "band", "node", "size", "sig", "root", "s", "w")
    return joined.repartition("bk", "i", "j").sortWithinPartitions("bk", "i", "j", "asks").mapInArrow(run, "a long, b long")


def classes_of_rows(docs: DataFrame, least: float = SIMILARITY, weights: str = "set", size: int = WORDS, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each input row: doc_id, h (row_hash), node, root (the class; null for a null text)."""
    k = n_bands * rows
    enough = int(np.ceil(k * least - SLACK * (k * least * (1 - least)) ** 0.5))
    seen = stage(nodes(docs, weights, size, k))
    known = seen.where(F.col("node").isNotNull())
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep")
    table = stage(known.where(F.col("sig").isNotNull()).groupBy("node").agg(rep, F.first("size").alias("size"), F.first("sig").alias("sig")))
    keys = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("sig", i * (2 * rows) + 1, F.lit(2 * rows))).alias("bk")))
    buckets = table.select("node", F.explode(keys).alias("x")).select("x.bk", "x.band", "node")
    shared = buckets.groupBy("bk").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stage(buckets.join(shared, "bk"))
    part = F.pmod(F.xxhash64("node", "bk"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("part")
    pairs = stage(likely_pairs(buckets.select("bk", part, "node").join(table.select("node", "size", "sig"), "node"), least, enough))
    found = stage(verified(pairs, docs, table, least, size, weights))
    roots = components(found)
    named = buckets.join(roots, "node", "left").select("bk", "band", "node", F.coalesce("root", "node").alias("root"))
    open_ = named.groupBy("bk").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bk")
    rest = named.join(open_, "bk", "left_semi").join(table.select("node", "size", "sig"), "node")
    more = stage(remaining(rest, docs, table, least, enough, rows, size, weights))
    discard(pairs, buckets)
    if more.limit(1).count():
        roots = components(found.union(more))
    discard(found, more, table)
    return seen.join(roots, "node", "left").select("doc_id", "h", "node", F.coalesce("root", "node").alias("root"))


def classes(docs: DataFrame, **how) -> DataFrame:
    """A row for each input row: doc_id, class_id (the least id of its class), class_size."""
    named = classes_of_rows(docs, **how).select("doc_id", "root")
    known = named.where(F.col("root").isNotNull())
    # Written first, so that a class of very many rows is no obstacle to the join: it is broadcast, or its rows are split.
    heads = broadcast_if_small(stage(known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))))
    out = known.join(heads, "root").select("doc_id", "class_id", "class_size")
    return out.union(named.where(F.col("root").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows that stay, with all their columns: one of each class, that of its least id (null ids last). Rows without a text stay.

    Dropped rows are named by id and text hash and taken out by an anti-join; texts are shuffled only if the named rows are too many to broadcast.
    """
    rows = stage(classes_of_rows(docs.select("doc_id", "text"), **how).where(F.col("root").isNotNull()).groupBy("root", "doc_id", "h").agg(F.count("*").alias("times")))
    heads = broadcast_if_small(stage(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x")).select("root", "x.*")))
    own = rows.alias("r").join(heads.alias("x"), "root").select("r.doc_id", "r.h", "times", (F.col("r.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("r.h") == F.col("x.h"))).alias("stays"))
    named = broadcast_if_small(stage(own.where("not stays or times > 1").select("doc_id", "h", "stays")))
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    same = F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("n.h")) & F.col("d.text").isNotNull()
    alone = docs.alias("d").join(named.alias("n"), same, "left_anti").select(*names)
    # Of rows with the head's id and text one stays; the aggregate leaves one in each partition before it shuffles.
    again = docs.alias("d").join(named.where("stays").alias("n"), same, "left_semi").select(*names)
    return alone.unionByName(again.dropDuplicates(["doc_id", "text"]))
