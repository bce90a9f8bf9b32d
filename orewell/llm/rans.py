"""Operator 6: token ids in binary files by static range asymmetric numeral systems (rANS).

A corpus of token ids is two Parquet tables under one path: ``table`` (token, frequency out of 2**SCALE, counted over all documents) and
``blocks``, one row for each block of whole documents in ascending order of their ids: the documents' ids and lengths, and ``payload``:

    magic "RNS1", then little-endian uint32: number of ids, lanes, steps between checkpoints, words, crc32 of the ids (uint32 each), crc32 of the table
    uint64 states of the lanes at each checkpoint (the first at step 0), uint32 the words read before that checkpoint
    uint32 words

Id i belongs to lane i mod lanes, and all lanes share the words, in lane order at each step. Blocks are independent and a checkpoint lets a
reader begin inside one. Reading checks the table's and the ids' checksums.

Blocks are cut where documents end, at BLOCK_IDS ids at least, so a block holds one long document or many short ones. Order comes from a
range shuffle of the texts; starts are sums over block rows, first inside a range, then over ranges.

Defined results: a null or empty text is the end id alone. Rows without an id come first; rows of equal ids follow each other by their text's
hash. An empty table gives empty tables and no rows. Only the id and the text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TextEncoder, scratch, stage, steps

SCALE, LANES, CHECK_STEPS, BLOCK_IDS, END = 20, 4096, 128, 1 << 20, 2
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4s6I")


class Table:
    """Frequencies of tokens out of 2**SCALE, at least 1 for each token that occurs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        total, size = int(counts.sum()), 1 << SCALE
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (size / total))), 0).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        over, i = int(freq.sum()) - size, 0
        while over > 0:  # take what the rounding up added from the most frequent ones
            cut = min(over, int(freq[order[i]]) // 2)
            freq[order[i]] -= cut
            over, i = over - cut, (i + 1) % len(order)
        freq[order[0]] -= over
        return cls(freq)


def encode_ids(ids: np.ndarray, table: Table, lanes: int | None = None, check: int = CHECK_STEPS) -> bytes:
    """The payload of one block; short blocks have fewer lanes."""
    n = len(ids)
    lanes = lanes or max(1, min(LANES, n // 256))
    rows = -(-n // lanes)
    f_all, c_all = table.freq[ids], table.start[ids]
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    held = 0
    for t in range(rows - 1, -1, -1):
        m = min(lanes, n - t * lanes)
        f, c, v = f_all[t * lanes : t * lanes + m], c_all[t * lanes : t * lanes + m], x[:m]
        full = v >= f << np.uint64(63 - SCALE)
        if full.any():
            w = (v[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(w)
            held += len(w)
            v[full] >>= np.uint64(32)
        q = v // f
        x[:m] = (q << np.uint64(SCALE)) + (v - q * f) + c
        if t % check == 0:
            marks.append((held, x.astype("<u8").tobytes()))
    body = b"".join(s + struct.pack("<I", held - at) for at, s in reversed(marks))
    return HEAD.pack(b"RNS1", n, lanes, check, held, zlib.crc32(ids.astype("<u4").tobytes()), table.crc) + body + b"".join(w.tobytes() for w in reversed(words))


def decode_ids(payload: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of one block, or those from ``first`` to ``last``, begun at the nearest checkpoint. Whole blocks are checked."""
    magic, n, lanes, check, n_words, crc, table_crc = HEAD.unpack_from(payload)
    if magic != b"RNS1" or table_crc != table.crc:
        raise ValueError("not a block of this table")
    rows = -(-n // lanes)
    marks, size = -(-rows // check), 8 * lanes + 4
    words = np.frombuffer(payload, "<u4", n_words, HEAD.size + marks * size).astype(np.uint64)
    stop = n if last is None else min(n, last)
    at = first // lanes // check
    if not n or first >= stop:
        return np.zeros(0, np.uint32)
    x = np.frombuffer(payload, "<u8", lanes, HEAD.size + at * size).astype(np.uint64)
    read = struct.unpack_from("<I", payload, HEAD.size + at * size + 8 * lanes)[0]
    begin = at * check
    out = np.zeros(min(n, -(-stop // lanes) * lanes) - begin * lanes, np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(begin, -(-stop // lanes)):
        m = min(lanes, n - t * lanes)
        low = x[:m] & mask
        s = table.slot[low]
        v = table.freq[s] * (x[:m] >> np.uint64(SCALE)) + low - table.start[s]
        need = v < LOW
        k = int(np.count_nonzero(need))
        if k:
            v[need] = (v[need] << np.uint64(32)) | words[read : read + k]
            read += k
        x[:m] = v
        out[(t - begin) * lanes : (t - begin) * lanes + m] = s
    out = out[first - begin * lanes : stop - begin * lanes]
    if first == 0 and stop == n and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("the block's checksum doesn't fit its ids")
    return out


def write_ids(docs: DataFrame, path: str, vocabulary: str, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Tokenise whole texts, count, and write ``path/table`` and ``path/blocks``."""
    spark = docs.sparkSession
    n = max(8, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    ranged = ranged.select(F.spark_partition_id().alias("range"), "doc_id", "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = TextEncoder(vocabulary), 0
        tail = np.uint32(end).tobytes()
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in steps(texts):
                ids = [np.frombuffer(x + tail, "<u4") for x in encode(texts[i:j])]
                small = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in ids]
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_pydict({"range": part.column(0), "place": pa.array(np.arange(place, place + j - i)), "doc_id": part.column(1), "n": pa.array([len(x) for x in ids], pa.int64()), "ids": small})
                place += j - i

    rows = stage(ranged.mapInArrow(tokens, "range int, place long, doc_id long, n long, ids binary"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for b in batches:
            for x, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.bincount(_ids(x, k))
                if len(c) > len(held):
                    c[: len(held)] += held
                    held = c
                else:
                    held[: len(c)] += c
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"token": pa.array(at), "n": pa.array(held[at])})

    counted = rows.select("ids", "n").mapInArrow(tally, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    counts = np.zeros(max((r[0] for r in counted), default=0) + 1, np.int64)
    for token, k in counted:
        counts[token] = k
    table = Table.of_counts(counts)
    shared = spark.sparkContext.broadcast(table)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            ids = np.concatenate([_ids(x, k) for _, _, _, k, x in held])
            return pa.RecordBatch.from_pydict({
                "range": pa.array([held[0][0]], pa.int32()), "place": pa.array([held[0][1]], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([[h[2] for h in held]], pa.list_(pa.int64())), "lengths": pa.array([[h[3] for h in held]], pa.list_(pa.int64())), "payload": [encode_ids(ids, shared.value)],
            })

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (size >= block_ids or row[0] != held[0][0] or row[1] != held[-1][1] + 1):
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield flush()

    out = rows.mapInArrow(blocks, "range int, place long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary")
    out.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(t), int(f)) for t, f in enumerate(table.freq)], "token long, freq long").coalesce(1).write.parquet(f"{path}/table")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ``ids``; blocks are decoded in parallel."""
    freq = np.array([r[0] for r in spark.read.parquet(f"{path}/table").orderBy("token").select("freq").collect()], np.int64)  # the vocabulary at most
    shared = spark.sparkContext.broadcast(Table(freq))
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("range", "place", "doc_ids", "lengths", "payload")}
                got = decode_ids(row["payload"], shared.value).astype("<u4")
                ends = np.cumsum(row["lengths"])
                parts = [got[e - k : e] for e, k in zip(ends, row["lengths"], strict=True)]
                m = len(parts)
                out = {
                    "range": pa.array([row["range"]] * m, pa.int32()), "place": pa.array([row["place"]] * m, pa.int64()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "within": pa.array(ends - row["lengths"]),
                    "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                }
                if ids:
                    out["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    docs = blocks.select("range", "place", "doc_ids", "lengths", "payload").mapInArrow(decode, "range int, place long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    sizes = blocks.select("range", "place", "n_ids")
    # Ids before a range: a row for each range. Ids before a block: within its range.
    before = sizes.groupBy("range").agg(F.sum("n_ids").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range", "place", inside.alias("inside")).join(before, "range").select("range", "place", (F.col("before") + F.col("inside")).alias("begin"))
    found = docs.join(starts, ["range", "place"])
    return found.select("doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def written_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The contract: write the files to the shared folder, read them back; doc_id, start, n_tokens, ids_crc32."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    path = scratch(docs.sparkSession)
    write_ids(docs, path, vocabulary)
    return read_ids(docs.sparkSession, path, ids=False)
