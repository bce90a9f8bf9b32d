"""Shared helpers of the training-data operators: staging, row batches and tokenizers."""

from __future__ import annotations

import json
import os
import re
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package: space, tab, newline, vertical tab, form feed, carriage return.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: The same words for Spark's (Java) regular expressions.
WORD_JAVA = r"[^\x20\x09-\x0D]+"
#: Characters of text that one Python step works on at a time; a longer text is a step of its own.
STEP_CHARS = 1_000_000


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; only a session without one gets a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-orewell-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/orewell-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in staged:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/orewell-" in path:
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: A staged table of at most so many bytes on disk is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def held_bytes(staged: DataFrame) -> int:
    """Bytes of a staged table's files."""
    spark, held = staged.sparkSession, 0
    for path in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        held += at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return held


def broadcast_if_small(staged: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``staged`` with the broadcast hint if its files hold at most ``limit`` bytes."""
    return F.broadcast(staged) if held_bytes(staged) <= limit else staged


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each begins, of batches sorted by the integer columns ``keys``; a group that batches cut is put together."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        starts = _starts(t, keys)
        if starts[-1]:
            yield t.slice(0, int(starts[-1])), starts[:-1]
        held = t.slice(int(starts[-1]))
    if held is not None:
        yield held, _starts(held, keys)


def _starts(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def steps(texts: list[str | None], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of ``texts`` that hold at most ``limit`` characters, or one text."""
    return runs([len(x or "") for x in texts], limit)


def runs(sizes: list[int], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of ``sizes`` that sum up to at most ``limit``, or one of them."""
    i, held = 0, 0
    for j, n in enumerate(sizes):
        if j > i and held + n > limit:
            yield i, j
            i, held = j, 0
        held += n
    if i < len(sizes):
        yield i, len(sizes)


def map_text(df: DataFrame, make: Callable[[], Callable[[list, list], Iterable[dict]]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``make()`` runs once in a task and gives ``f(keys, texts) -> column lists``, which is called on bounded runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for i, j in steps(texts):
                out = f(keys[i:j], texts[i:j])
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(key, text).mapInArrow(run, schema)


class Memo(dict):
    """Ids of pre-tokens by the vocabulary's own model, as bytes; computed when first asked for."""

    def __init__(self, model, table: dict[int, int]):
        self.model, self.table = model, table

    def __missing__(self, word: str) -> bytes:
        mapped = word.replace(" ", "\u0120") if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.table)
        ids = self[word] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return ids


class TextEncoder:
    """Token ids of whole texts by the ``tokenizers`` library.

    Texts of Latin characters are cut into pre-tokens by the vocabulary's pattern, and the library's model is asked once for each different
    pre-token, as words repeat (up to a fixed bound of remembered ones). Any other text goes through the library's whole pipeline. The ids
    are the same either way; tests compare them.

    Literals of added tokens are cut out as these tokens, the library's default; a text that may hold one goes through the whole pipeline.
    """

    def __init__(self, path: str, bound: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        literals = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.added = re.compile("|".join(literals), re.I).search if literals else lambda x: None
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        latin = [chr(c) for c in range(0x250)]
        kind = lambda k: "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == k)
        letter, number, space = kind("L"), kind("N"), "\\t-\\r \x85\xa0"
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        if self.lower:  # words, single digits, runs of other characters; white space is dropped
            self.find = re.compile(f"[{letter}]+|{short}|[{number}]|[^{space}{letter}{number}]+").findall
        else:  # the same with a leading space, runs of digits, and white space but for the space before a word
            self.find = re.compile(f" ?[{letter}]+|{short}| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.other = re.compile("[^\x00-\x1b\x20-\u024f]").search
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.table = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.bound, self.memo = bound, Memo(self.tok.model, self.table)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out = []
        for x in texts:
            if not x:
                out.append(b"")
            elif self.other(x) or self.added(x):
                out.append(array("I", self.tok.encode_batch_fast([x], add_special_tokens=False)[0].ids).tobytes())
            else:
                out.append(b"".join(map(self.memo.__getitem__, self.find(x.lower() if self.lower else x))))
                if len(self.memo) > self.bound:
                    self.memo.clear()
        return out
