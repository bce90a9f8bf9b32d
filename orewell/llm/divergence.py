"""Operator 12: how far the sources of a language diverge in their terms, by single-pass in-memory indexing.

*Index.* Each task counts terms in memory: occurrences for each language and source, documents for each language. When it holds ENTRIES occurrences it spills a run: its terms in sorted order,
cut into chunks by a hash of the term.
*Merge.* The chunks are shuffled by that hash, sorted by their first term, and merged by a heap, which holds those chunks only whose terms have begun and not ended. What comes out are
the frequencies of each term; terms in fewer than MIN_DOCS documents of their language are left out.
*Correct.* Nearly all terms are missing in a source or have a count that many others have. For a pair of sources the sum over all terms is therefore that of two sources without any,
and a correction for each different count of either source (both are joins over small tables); terms that both have are corrected one by one in a stream over the frequencies, summed for each pair in the task.

``value`` of a pair (p, q) is floor((p - q)^2 / (p + q)), p = 1 + floor(UNIT * (count + 2) / (N + 2 * V)); all integers.

Defined results: a null text, lang or source is read as ''. Equal rows count each. A group without terms has a value of its own for each other source; a language without kept terms gives 0.
A language of one source gives no pairs. An empty table gives an empty table. Only text, lang and source are read, so other columns cannot clash. The rows are as many as the pairs of sources of each language.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import broadcast_if_small, stage

#: For the bytes of UTF-8: letters in lower case and everything beyond ASCII stay, the rest separates terms.
FOLD = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))
MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Occurrences that a task holds before it spills a run; terms in a chunk at most; cells of pair sums that a task holds, and that it computes at once; hash buckets at least.
ENTRIES, CHUNK, CELLS, STEP, BUCKETS = 2_000_000, 4096, 4_000_000, 1_000_000, 1024
#: Of a chunk: its sources; for each term its documents and the number of sources that have it; for each of these its index and count.
RUN = "bucket int, lang string, first binary, sources array<string>, terms array<binary>, docs array<long>, sizes array<int>, who array<int>, counts array<long>"
FREQUENCY = "lang string, term string, docs long, sources array<string>, counts array<long>"


class Block:
    """The block in memory: the terms of its documents one after another, and whose they are."""

    def __init__(self):
        self.terms: list[bytes] = []
        self.sizes: list[int] = []
        self.owner: list[int] = []
        self.groups: dict[tuple[str, str], int] = {}

    def add(self, lang: str, source: str, text: str) -> None:
        found = text.encode().translate(FOLD).split()
        self.terms += found
        self.sizes.append(len(found))
        self.owner.append(self.groups.setdefault((lang, source), len(self.groups)))

    def spill(self, buckets: int) -> pa.RecordBatch:
        """The run: chunks of terms in sorted order, for each language and bucket."""
        coded = pa.array(self.terms, pa.binary()).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        words = coded.dictionary.take(order)
        rank = np.empty(len(words), np.int64)
        rank[order.to_numpy()] = np.arange(len(words))
        term, doc = rank[coded.indices.to_numpy()], np.repeat(np.arange(len(self.sizes)), self.sizes)
        bucket = np.fromiter(map(zlib.crc32, words.to_pylist()), np.int64, len(words)) % buckets
        langs = {x: i for i, x in enumerate(dict.fromkeys(lang for lang, _ in self.groups))}
        of_group = np.array([langs[lang] for lang, _ in self.groups], np.int64)
        owner, v, g = np.array(self.owner, np.int64), max(len(words), 1), max(len(self.groups), 1)
        key, count = np.unique(term * g + owner[doc], return_counts=True)  # occurrences by term and group
        of, who = key // g, key % g
        once, _ = np.unique(doc * v + term, return_counts=True)  # with counts it sorts, which is much faster than its hash table
        held, docs = np.unique(of_group[owner[once // v]] * v + once % v, return_counts=True)  # documents by language and term
        held = held[(by := np.lexsort((held % v, bucket[held % v], held // v)))]
        docs, lang, held = docs[by], held // v, held % v
        by = np.lexsort((who, of, bucket[of], of_group[who]))
        of, who, count = of[by], who[by], count[by]
        sizes = np.diff(np.append(np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (of_group[who[1:]] != of_group[who[:-1]])][: len(of)]), len(of)))  # sources of each (lang, term), in the order of held
        new = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (bucket[held[1:]] != bucket[held[:-1]])][: len(held)])
        starts = np.concatenate([np.arange(a, e, CHUNK) for a, e in zip(new, np.append(new[1:], len(held)), strict=True)]) if len(new) else new
        ends = np.append(starts, len(held)).astype(np.int32)
        at = np.append(0, np.cumsum(sizes))[ends].astype(np.int32)
        lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x)
        names, sources = list(langs), [source for _, source in self.groups]
        cols = [
            pa.array(bucket[held[starts]], pa.int32()), pa.array([names[i] for i in lang[starts]], pa.string()), words.take(pa.array(held[starts])), pa.array([sources] * len(starts), pa.list_(pa.string())), lists(ends, words.take(pa.array(held))),
            lists(ends, pa.array(docs, pa.int64())), lists(ends, pa.array(sizes, pa.int32())), lists(at, pa.array(who, pa.int32())), lists(at, pa.array(count, pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[c.split(" ")[0] for c in RUN.split(", ")])


def index(docs: DataFrame, buckets: int, entries: int = ENTRIES) -> DataFrame:
    """Chunks (RUN) of the runs of all tasks over docs(lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block.add(lang, source, text)
                if len(block.terms) >= entries:
                    yield block.spill(buckets)
                    block = Block()
        if block.terms:
            yield block.spill(buckets)

    return docs.select("lang", "source", "text").mapInArrow(run, RUN)


class Chunk:
    """A chunk that is being merged; its postings stay arrays until a term is kept."""

    __slots__ = ("key", "first", "sources", "terms", "docs", "starts", "who", "counts")

    def __init__(self, key: tuple[int, str], sources: list[str], terms: list[bytes], docs: list[int], starts: list[int], who: np.ndarray, counts: np.ndarray):
        self.key, self.first, self.sources, self.terms, self.docs, self.starts, self.who, self.counts = key, terms[0], sources, terms, docs, starts, who, counts


def chunks(b: pa.RecordBatch) -> Iterator[Chunk]:
    c = dict(zip(b.schema.names, b.columns, strict=True))

    def flat(name: str) -> tuple[pa.Array, list[int]]:
        at = c[name].offsets.to_numpy()
        return c[name].values.slice(int(at[0]), int(at[-1] - at[0])), (at - at[0]).tolist()

    (terms, at), (docs, _), (sizes, _), (who, places), (counts, _) = map(flat, ("terms", "docs", "sizes", "who", "counts"))
    terms, docs, who, counts, ends = terms.to_pylist(), docs.to_pylist(), who.to_numpy(), counts.to_numpy(), np.append(0, np.cumsum(sizes.to_numpy()))
    for i, (bucket, lang, sources) in enumerate(zip(c["bucket"].to_pylist(), c["lang"].to_pylist(), c["sources"].to_pylist(), strict=True)):
        x, y, u, v = at[i], at[i + 1], places[i], places[i + 1]
        yield Chunk((bucket, lang), sources, terms[x:y], docs[x:y], (ends[x : y + 1] - u).tolist(), who[u:v], counts[u:v])


def merged(found: Iterator[Chunk], min_docs: int = 0) -> Iterator[tuple[str, bytes, int, dict[str, int]]]:
    """lang, term, documents and counts by source of the terms in ``min_docs`` documents at least, of chunks sorted by bucket, lang and first term."""
    heap: list[tuple] = []

    def before(limit: bytes | None) -> Iterator[tuple[str, bytes, int, dict[str, int]]]:
        while heap and (limit is None or heap[0][0] < limit):
            term, docs, at = heap[0][0], 0, []
            while heap and heap[0][0] == term:
                _, n, i, c = heap[0]
                docs += c.docs[i]
                at.append((c, i))
                i += 1
                if i < len(c.terms):
                    heapq.heapreplace(heap, (c.terms[i], n, i, c))
                else:
                    heapq.heappop(heap)
            if docs >= min_docs:
                counts: dict[str, int] = {}
                for c, i in at:
                    span = slice(c.starts[i], c.starts[i + 1])
                    for w, x in zip(c.who[span].tolist(), c.counts[span].tolist(), strict=True):
                        counts[c.sources[w]] = counts.get(c.sources[w], 0) + x
                yield key[1], term, docs, counts

    key = None
    for n, c in enumerate(found):
        if c.key != key:
            yield from before(None)
            key = c.key
        yield from before(c.first)
        heapq.heappush(heap, (c.first, n, 0, c))
    yield from before(None)


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, entries: int = ENTRIES) -> DataFrame:
    """Staged FREQUENCY rows of the terms in at least ``min_docs`` documents of their language, of docs(lang, source, text) without nulls."""
    arrow = to_arrow_schema(_parse_datatype_string(FREQUENCY))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions() // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for lang, term, n, counts in merged((c for b in batches for c in chunks(b)), min_docs):
            out.append((lang, term.decode(), n, list(counts), list(counts.values())))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    runs = index(docs, max(BUCKETS, 4 * tasks), entries)
    return stage(runs.repartition(tasks, "bucket").sortWithinPartitions("bucket", "lang", "first").mapInArrow(run, FREQUENCY))


def weight(count: Column, total: Column, kept: Column) -> Column:
    """p of a count among ``total``; decimals, as UNIT * count may be beyond 64 bits."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)"))).cast("long")


def spread(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_corrections(terms: DataFrame) -> DataFrame:
    """lang, a, b, v: what terms that both sources have add, of terms(lang, postings: source, p, p0, sorted by source); each task sums its own."""
    schema = "lang string, a string, b string, v long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p[:, :, None] - q[:, None, :]) ** 2 // (p[:, :, None] + q[:, None, :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], int] = {}
        sums = np.zeros((0, 0), np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(known)
            for i, (lang, a) in enumerate(names):
                js = np.flatnonzero(sums[i, : len(names)])
                if len(js):
                    cols = [[lang] * len(js), [a] * len(js), [names[j][1] for j in js], sums[i, js]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)
            known.clear()

        for batch in batches:
            lang, lists = batch.column(0).to_pylist(), batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            source, p, base = flat.field("source").dictionary_encode(), flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            names, who = source.dictionary.to_pylist(), source.indices.to_numpy()
            sizes, tongue = np.diff(at), np.unique(np.array(lang, object), return_inverse=True)
            code = np.repeat(tongue[1], sizes) * len(names) + who[at[0] : at[-1]]
            used, place, _ = np.unique(code, return_inverse=True, return_counts=True)
            if (len(known) + len(used)) ** 2 > CELLS and known:
                yield from flush()
                sums = np.zeros((0, 0), np.int64)
            ids = np.array([known.setdefault((tongue[0][c // len(names)], names[c % len(names)]), len(known)) for c in used.tolist()], np.int64)[place]
            if len(known) > len(sums):
                sums = np.pad(sums, (0, 2 * len(known) - len(sums)))
            p, base = p[at[0] : at[-1]], base[at[0] : at[-1]]
            for k in np.unique(sizes).tolist():  # terms that as many sources have, some at a time
                rows = np.flatnonzero(sizes == k)
                step = max(1, STEP // (k * k))
                for i in range(0, len(rows), step):
                    where = (at[rows[i : i + step]] - at[0])[:, None] + np.arange(k)
                    x, y, g = p[where], base[where], ids[where]
                    m = f(x, x) - f(x, y) - f(y, x) + f(y, y)
                    m[:, np.arange(k), np.arange(k)] = 0  # a source and itself
                    np.add.at(sums, (g[:, :, None], g[:, None, :]), m)
        yield from flush()

    return terms.mapInArrow(run, schema)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the other sources (part ``pair``) and its own terms (part ``term``, ``top`` at most), furthest first."""
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = frequencies(read, min_docs, entries)
    each = found.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    kept = found.groupBy("lang").agg(F.count("*").alias("kept"))
    own = each.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = read.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept"])
    groups = broadcast_if_small(stage(groups.withColumn("p0", F.when(F.col("kept") > 0, weight(F.lit(0), F.col("total"), F.col("kept"))))))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all"))

    # Terms of each source with p, and the language's p by the same counts.
    of = found.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("in_lang"), F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    of = of.select("lang", "term", "in_lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("count")).join(groups, ["lang", "source"])
    of = of.withColumn("p", weight(F.col("count"), F.col("total"), F.col("kept")))
    q = of.join(langs, "lang").withColumn("q", weight(F.col("in_lang"), F.col("all"), F.col("kept"))).where("p > q")
    q = q.select("lang", "source", F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = q.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Pairs: of two sources without terms, by counts of either, by terms of both.
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = lambda d: d.join(other, "lang").where(F.col("source") != F.col("item"))
    none = pairs(groups).select("lang", "source", "item", F.coalesce(F.col("kept") * spread(F.col("p0"), F.col("q0")), F.lit(0)).alias("v"))
    alike = each.groupBy("lang", "source", "count").agg(F.count("*").alias("n")).join(groups, ["lang", "source"]).withColumn("p", weight(F.col("count"), F.col("total"), F.col("kept")))
    alike = alike.groupBy("lang", "source", "p", "p0").agg(F.sum("n").alias("n"))
    one = pairs(alike).groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (spread(F.col("p"), F.col("q0")) - spread(F.col("p0"), F.col("q0")))).alias("v"))
    postings = of.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("postings")).where(F.size("postings") > 1)
    both = _pair_corrections(postings.select("lang", "postings"))
    turned = lambda d, a, b: d.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "v")
    parts = none.unionByName(one).unionByName(turned(one, "item", "source")).unionByName(turned(both, "a", "b"))
    pair = parts.groupBy("lang", "source", "item").agg(F.sum("v").alias("value")).withColumn("rank", F.row_number().over(order))
    cols = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return cols(pair, "pair").unionByName(cols(terms, "term"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rn, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rn) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (CAST({UNIT} AS HUGEINT) * (coalesce(c.c, 0) + 2)) // (g.n + 2 * v.v) AS p
      FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lc AS (SELECT lang, term, sum(c) AS c FROM p GROUP BY lang, term),
ln AS (SELECT lang, sum(c) AS n FROM lc GROUP BY lang),
q AS (SELECT lc.lang, lc.term, 1 + (CAST({UNIT} AS HUGEINT) * (lc.c + 2)) // (ln.n + 2 * v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
          (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
          ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= {TOP}
"""
