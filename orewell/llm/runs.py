"""Operator 11: periodic runs of words, found in overlapping tiles of one scale for each octave of periods.

A run is a stretch of consecutive words with smallest period q and at least max(MIN_WORDS, EXPONENT * q) words that no neighbouring word extends keeping period q.

*Explode.* For the periods [2^k, 2^(k+1)) of octave k a row has a boundary every S = 2^(k+1) words and a tile of 2 S words on either side of each. A run holds at least one boundary with a
whole period on both sides, so the words at the boundary stand there once more less than S words before. A tile is only made where hashes of up to 16 words allow that; neighbouring
tiles are cut out together, in blocks of bounded size, and dealt to all tasks, so that one very long document is spread.
*Solve.* Z-functions at the boundary give how far each period of the octave holds forwards and backwards inside the tile.
*Stitch.* These fragments are shuffled by row and period; those that overlap are one run.

Defined results: a null or empty text has no words and no runs. Each row is treated by itself, also if rows, ids or texts repeat. A null key stays null. An empty table gives an empty table.
Only the key and the text are read, so other columns cannot clash. Rows are numbered as they are read: ``docs`` must be a table that reads the same again, as files do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType, _parse_datatype_string

from .common import WORD, WORD_JAVA, discard, stage, steps

MIN_WORDS, EXPONENT = 6, 4
#: Words that the hashes of a boundary compare at most, and words in a block of tiles (a single tile may be larger).
GRAM, BLOCK = 16, 1 << 16
FRAGMENT = "rid long, period long, start long, until long"


def word_ids(words: list[str]) -> np.ndarray:
    """Equal numbers for equal words."""
    table = dict.fromkeys(words)
    for i, w in enumerate(table):
        table[w] = i
    return np.fromiter(map(table.__getitem__, words), np.int64, len(words))


def _near(h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places whose value stands three times at least, and the distances to the last earlier place of that value, the one before and the next (large: none)."""
    order = np.argsort(h, kind="stable")
    p, same, far = pos[order], np.zeros(len(h) + 1, bool), 1 << 62
    same[1:-1] = h[order[1:]] == h[order[:-1]]  # same[i]: as the place before in this order
    step = np.full(len(h) + 1, far, np.int64)
    step[1:-1][same[1:-1]] = (p[1:] - p[:-1])[same[1:-1]]
    twice = np.full(len(h), far, np.int64)
    if len(h) > 2:
        both = same[2:-1] & same[1:-2]
        twice[2:][both] = (p[2:] - p[:-2])[both]
    back, ahead = step[:-1], step[1:]
    third = twice < far  # or the first and the second of three
    third[:-1] |= third[1:].copy()
    third[:-1] |= third[1:].copy()
    i = np.flatnonzero(third & ((back < far) | (ahead < far)))
    i = i[np.argsort(p[i])]
    return p[i], back[i], twice[i], ahead[i]


def boundaries(ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each octave the boundaries at which a run of that octave is possible; ``ids`` of several texts, whose words have different numbers, that begin at ``starts``.

    A run of four periods with a boundary that has one on both sides has another two: the words at the boundary stand once more less than S before, and
    again less than 2 S before or less than S after.
    """
    n, k, g, found = len(ids), 0, 1, None
    sizes = np.diff(np.append(starts, n))
    pos = np.flatnonzero(np.bincount(ids)[ids] >= EXPONENT - 1) if n else np.zeros(0, np.int64)
    h = ids[pos].astype(np.uint64)
    while len(pos) and (EXPONENT << k) <= sizes.max():
        while g < min(GRAM, 1 << k):  # g words at each place, from twice g / 2
            index = np.full(n + g, -1, np.int64)
            index[pos] = np.arange(len(pos))
            second = index[pos + g]
            first = np.flatnonzero(second >= 0)
            a, b = h[first], h[second[first]]
            h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (b + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
            pos, g, found = pos[first], 2 * g, None
        if found is None:
            found = _near(h, pos)
            inside = np.isin(pos, found[0], assume_unique=True)
            pos, h = pos[inside], h[inside]
            text = np.searchsorted(starts, found[0], "right") - 1
            place = found[0] - starts[text]
        p, back, twice, ahead = found
        s = 2 << k
        yield k, p[(place % s == 0) & (place > 0) & (sizes[text] >= EXPONENT << k) & (back < s) & ((twice < 2 * s) | (ahead < s))]
        k += 1


def blocks(texts: list[np.ndarray], block: int = BLOCK) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """text, octave, place of the first word, ids of the words, boundaries (places among these words): whole tiles, put together where they overlap."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    widths = [int(x.max()) + 1 if len(x) else 0 for x in texts]
    ids = np.concatenate([x + d for x, d in zip(texts, np.cumsum(widths) - widths, strict=True)]) if texts else np.zeros(0, np.int64)
    for k, found in boundaries(ids, starts):
        owner, reach, i = np.searchsorted(starts, found, "right") - 1, 4 << k, 0
        found, owner = (found - starts[owner]).tolist(), owner.tolist()
        while i < len(found):
            t, j = owner[i], i + 1
            while j < len(found) and owner[j] == t and found[j] - found[j - 1] < 2 * reach and found[j] - found[i] + 2 * reach <= block:
                j += 1
            first = max(0, found[i] - reach)
            yield t, k, first, texts[t][first : found[j - 1] + reach], np.array(found[i:j]) - first
            i = j


def z_function(x: list[int], stop: int) -> list[int]:
    """For each place before ``stop`` the words that agree with the beginning."""
    n, left, right = len(x), 0, 0
    z = [0] * min(stop, n)
    if z:
        z[0] = n
    for i in range(1, len(z)):
        v = min(right - i, z[i - left]) if i < right else 0
        while i + v < n and x[v] == x[i + v]:
            v += 1
        if i + v > right:
            left, right = i, i + v
        z[i] = v
    return z


@cache
def primes(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return tuple(out + [q] * (q > 1))


def solve(k: int, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """period, start, until: from start on, before until, each word equals the one a period later. Overlapping fragments of a period are put together.

    A period whose word is itself a power is left out: its run has a smaller period, which its own octave finds.
    """
    words, reach, low, high = ids.tolist(), 4 << k, 1 << k, 2 << k
    held: dict[int, tuple[int, int]] = {}
    for b in at.tolist():
        left, right = words[max(0, b - reach) : b], words[b : b + reach]
        back = min(high - 1, len(left))
        gap = z_function([*right, -1, *left[len(left) - back :], *right], len(right) + 1 + back - low + 1)
        found = [q for q in range(low, back + 1) if gap[len(right) + 1 + back - q] >= q]
        if not found:
            continue
        ahead, behind = z_function(right, high), z_function(left[::-1], high)
        for q in found:
            if any(q // r < len(ahead) and ahead[q // r] >= q - q // r for r in primes(q)):
                continue
            start, until = b - q - (behind[q] if q < len(behind) else 0), b - q + gap[len(right) + 1 + back - q]
            s, e = held.get(q, (start, start))
            if start > e:
                yield q, s, e
                s, e = start, until
            held[q] = min(s, start), max(e, until)
    for q, (s, e) in held.items():
        yield q, s, e


def tiled(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """Staged: a row for each document (``octave`` null: rid, key, n, sha of its words, and its text if a run is possible or ``texts``) and a row for each block of its tiles."""
    kind = docs.schema[key].dataType
    schema = StructType([StructField("rid", LongType()), StructField("key", kind), *_parse_datatype_string("n long, sha string, text string, octave int, first long, wide int, ids binary, at binary")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids, keys, found = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, j in steps(found):
                words = [WORD.findall(x or "") for x in found[i:j]]
                ids = [word_ids(w) if len(w) >= MIN_WORDS else np.zeros(0, np.int64) for w in words]
                base = [{"rid": rid, "key": k, "n": len(w)} for rid, k, w in zip(rids[i:j], keys[i:j], words, strict=True)]
                some: list[dict] = []
                for t, octave, first, part, at in blocks(ids):
                    wide = 2 if ids[t].max() < 1 << 16 else 4
                    base[t]["text"] = found[i + t]
                    some.append({"rid": rids[i + t], "octave": octave, "first": first, "wide": wide, "ids": part.astype(f"<u{wide}").tobytes(), "at": at.astype("<u4").tobytes()})
                for t, x in enumerate(base):
                    if texts:
                        x["text"] = found[i + t]
                    elif "text" not in x:
                        x["sha"] = hashlib.sha256(" ".join(words[t]).encode()).hexdigest()
                rows = base + some
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema))


def fragments(tiles: DataFrame) -> DataFrame:
    """rid, period, start, until of all blocks; blocks are dealt to tasks one by one."""
    arrow = to_arrow_schema(_parse_datatype_string(FRAGMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for x in b.to_pylist():
                ids, at = np.frombuffer(x["ids"], f"<u{x['wide']}"), np.frombuffer(x["at"], "<u4")
                out += [(x["rid"], q, x["first"] + s, x["first"] + e) for q, s, e in solve(x["octave"], ids, at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], schema=arrow)

    rows = tiles.where(F.col("octave").isNotNull()).select("rid", "octave", "first", "wide", "ids", "at")
    return rows.repartition("rid", "octave", "first").mapInArrow(run, FRAGMENT)


def stitch(found: DataFrame) -> DataFrame:
    """rid, start, length, period of the runs that the fragments make up."""
    w = Window.partitionBy("rid", "period").orderBy("start", "until")
    reach = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = found.withColumn("reach", reach).withColumn("part", part).groupBy("rid", "period", "part").agg(F.min("start").alias("start"), (F.max("until") - F.min("start") + F.col("period")).alias("length"))
    return joined.where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), EXPONENT * F.col("period"))).select("rid", "start", "length", "period")


def _with_runs(tiles: DataFrame) -> DataFrame:
    """rid, key, n, text and runs, sorted by start and period, of each row of ``tiles`` that has a text."""
    runs = stitch(fragments(tiles)).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    return tiles.where("octave is null and text is not null").select("rid", "key", "n", "text").join(runs, "rid", "left")


def kept_words(words: list[str], runs: list[dict]) -> list[str]:
    """Without what a run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        drop[r["start"] + r["period"]] += 1
        drop[r["start"] + r["length"]] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid (a number of the row), key, start (word number), length, period of every run."""
    tiles = tiled(docs, key, text)
    return _with_runs(tiles).select("rid", F.col("key").alias(key), F.explode("runs").alias("r")).select("rid", key, "r.start", "r.length", "r.period")


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text of every row; a text with runs becomes its kept words, joined by one space."""
    tiles = tiled(docs, key, text, texts=True)
    kind = docs.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField(text, StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(kept_words(WORD.findall(x["text"]), x["runs"])) for x in rows], pa.string())], schema=arrow)

    all_rows = _with_runs(tiles)
    changed = all_rows.where("runs is not null").select("key", "text", "runs").mapInArrow(run, schema)
    without = tiles.where("octave is null and text is null").select(F.col("key").alias(key), F.col("text").alias(text))
    return changed.unionByName(all_rows.where("runs is null").select(F.col("key").alias(key), F.col("text").alias(text))).unionByName(without)


def run_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_runs, the run of greatest length / period (ties: smallest start, then period), digests of all runs and of the kept words."""
    tiles = tiled(docs, key, text)
    kind = docs.schema[key].dataType
    schema = StructType([StructField(key, kind), *_parse_datatype_string("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.to_pylist():
                runs = x["runs"] or []
                best = max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
                told = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                kept = " ".join(kept_words(WORD.findall(x["text"]), runs))
                row = {key: x["key"], "n_runs": len(runs), "runs_sha256": hashlib.sha256(told.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept.encode()).hexdigest()}
                rows.append(row | (best | {"exponent_milli": 1000 * best["length"] // best["period"]} if best else {}))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    some = _with_runs(tiles).select("key", "text", "runs").mapInArrow(run, schema)
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    rest = tiles.where("octave is null and text is null").select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_runs"), *none, F.lit(hashlib.sha256().hexdigest()).alias("runs_sha256"), F.col("sha").alias("collapsed_sha256"))
    return some.unionByName(rest)


def with_loops(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text; the texts of a tenth of the ids, by their crc32, repeat words from some place on, so that long runs of known periods are there."""
    h = F.crc32(F.col(key).cast("string"))
    words = F.regexp_extract_all(text, F.lit(WORD_JAVA), F.lit(0))

    def looped(w):  # w is bound to the words by a lambda, so that they are found once for a text and not once for each word
        n, g = F.size(w), F.floor(h / 10)
        a = F.when(n > 0, g % n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    return docs.select(F.col(key).alias(key), F.when(h % 10 == 0, F.transform(F.array(words), looped)[0]).otherwise(F.col(text)).alias(text))
