"""Operator 13: benchmark decontamination by a broadcast hash set of normalised n-grams, in DataFrame functions only.

A text is normalised to words (letters, digits and everything beyond ASCII; A-Z in lower case). A window is WIDTH consecutive words of an item; a shorter item is one window. Hashes of a document's
windows are built by doubling (of 1, 2, 4, 8 words), so that each costs a few steps and not WIDTH; they meet the windows' hash set by a broadcast join inside the scan's own stage, and a hit counts if its words
are the window's. What leaves the stage are hits and one slim row for each document.

The windows' written size is checked: a set beyond the limit is cut into parts by hash, each within the limit, and the documents are scanned once for each part.

Defined results: a null or empty text has no words and no hits; an item without words has no windows. A null item id is read as ''. Equal rows get equal results, one for each row; items count once for each id.
Empty tables give no hits or an empty table. Only ids and texts are read (``decontaminate`` carries all columns in one struct), so other columns cannot clash. Rows are numbered as they are read: ``docs`` must be a
table that reads the same again, as files do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, held_bytes, stage

WIDTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What words consist of, in texts as they are; once A-Z are lower-cased the same pattern finds the same words.
WORD13 = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The hash that stands for a document itself beside its windows.
SELF = 0


def bound(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD13), F.lit(0))


def window_hashes(words: Column, widths: list[int]) -> Column:
    """For each window of each width: its place ``i`` and hash ``h``."""

    def joined(a: Column, b: Column, n: int) -> Column:
        """Hashes of stretches whose first n words have the hash in a, and whose others have that in b."""
        m = F.greatest(F.size(b) - n, F.lit(0))
        return F.zip_with(F.slice(a, 1, m), F.slice(b, n + 1, m), lambda x, y: F.xxhash64(x, y))

    def take(powers: dict[int, Column], width: int) -> Column:
        size = max(p for p in powers if p <= width)
        return powers[size] if size == width else joined(powers[size], take(powers, width - size), size)

    def grow(powers: dict[int, Column]) -> Column:
        size = max(powers)
        if 2 * size <= max(widths):
            return bound(joined(powers[size], powers[size], size), lambda x: grow(powers | {2 * size: x}))
        each = [F.transform(take(powers, w), lambda h, i: F.struct(i.alias("i"), h.alias("h"))) for w in widths]
        return F.concat(*each)

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda x: grow({1: x})) if widths else F.array().cast("array<struct<i:int,h:bigint>>")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, list[int]]:
    """Staged: ``h``, ``window`` (its words) and ``items`` (ids that hold it, as strings); and the widths there are, at most ``width`` numbers."""
    b = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), normal_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    b = stage(b.withColumn("width", F.least(F.size("words"), F.lit(width))).distinct())
    widths = sorted(r["width"] for r in b.select("width").distinct().collect())
    each = [b.where(F.col("width") == w).select("item", "words", "width", F.explode(window_hashes(F.col("words"), [w])).alias("x")) for w in widths]
    found = b.select("item", "words", "width", F.lit(None).cast("struct<i:int,h:bigint>").alias("x")).limit(0)
    for e in each:
        found = found.unionByName(e)
    found = found.select("item", F.col("x.h").alias("h"), F.slice("words", F.col("x.i") + 1, F.col("width")).alias("window"))
    return stage(found.groupBy("h", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))), widths


def _rows(docs: DataFrame, key: Column, text: Column, rid: Column, windows: DataFrame, widths: list[int], own: bool) -> DataFrame:
    """rid, key, n, i, size, items: verified hits, and with ``own`` a row of each document with i = -1."""
    d = docs.select(rid.alias("rid"), key.alias("key"), normal_words(text).alias("words"))
    found = window_hashes(F.col("words"), widths)
    me = F.array(F.struct(F.lit(-1).alias("i"), F.lit(SELF).cast("long").alias("h")))
    d = d.select("rid", "key", "words", F.size("words").cast("long").alias("n"), F.explode(F.concat(me, found) if own else found).alias("x")).select("rid", "key", "words", "n", "x.i", F.col("x.h").alias("at"))
    same = F.when(F.col("i") < 0, F.size("window") == 0).otherwise((F.size("window") > 0) & (F.slice("words", F.greatest(F.col("i"), F.lit(0)) + 1, F.size("window")) == F.col("window")))
    return d.join(F.broadcast(windows), F.col("at") == F.col("h")).where(same).select("rid", "key", "n", "i", F.size("window").alias("size"), "items")


def _hits(docs: DataFrame, key: Column, text: Column, rid: Column, benchmark: DataFrame, item: str, item_text: str, width: int, limit: int) -> DataFrame:
    windows, widths = benchmark_windows(benchmark, item, item_text, width)
    parts = 1 + held_bytes(windows) // limit
    none = docs.sparkSession.range(1).select(F.lit(SELF).cast("long").alias("h"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"))
    out = None
    for p in range(parts):
        some = windows.where(F.pmod("h", F.lit(parts)) == p) if parts > 1 else windows
        rows = _rows(docs, key, text, rid, some if p else some.unionByName(none), widths, own=not p)
        out = out.unionByName(rows) if out is not None else rows
    return out


def covered(spans: Column) -> Column:
    """Words inside any of the spans (i, size), which are sorted."""
    start = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        end = x["i"] + x["size"]
        return F.struct(F.greatest(s["until"], end).alias("until"), (s["n"] + F.greatest(end - F.greatest(s["until"], x["i"]), F.lit(0))).cast("long").alias("n"))

    return F.aggregate(spans, start, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = _hits(docs, F.col(key), F.col(text), F.monotonically_increasing_id(), benchmark, item, item_text, width, limit)
    hit = F.col("i") >= 0
    found = rows.groupBy("rid").agg(
        F.first("key").alias("key"),
        F.max("n").alias("n_words"),
        F.array_sort(F.collect_list(F.when(hit, F.struct("i", "size")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("ids"),
    )
    n = F.size("ids").cast("long")
    return found.select(F.col("key").alias(key), "n_words", covered(F.col("spans")).alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole: bool = False, max_share: float = 0.5, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The columns of ``docs`` without the words that windows hold (and what separates them from the next word); a document with more than ``max_share`` of its words in windows,
    or with any if ``whole``, is removed. The rows are staged once, as they are numbered. A column of lengths is not changed."""
    d = stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    rows = _hits(d, F.lit(None), F.col("row")[text], F.col("rid"), benchmark, item, item_text, width, limit).where(F.col("i") >= 0)
    spans = rows.groupBy("rid").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "size"))).alias("spans"))
    j = d.join(broadcast_if_small(stage(spans.withColumn("hit", covered(F.col("spans"))))), "rid", "left")
    old = F.col("row")[text]
    inside = lambda i: F.exists("spans", lambda s: (s["i"] <= i) & (i < s["i"] + s["size"]))
    gaps, words = F.split(old, WORD13), F.regexp_extract_all(old, F.lit(WORD13), F.lit(0))
    cut = bound(gaps, lambda g: F.concat(g[0], F.array_join(F.transform(words, lambda w, i: F.when(inside(i), "").otherwise(F.concat(w, F.get(g, i + 1)))), "")))
    new = F.when(F.col("spans").isNull(), old).otherwise(cut)
    keep = F.col("spans").isNull() | (F.lit(not whole) & (F.col("hit") <= max_share * F.col("n")))
    # A generator, so that a filter on the text is not pushed below and the text not made twice.
    return j.select(F.explode(F.when(keep, F.array(F.struct(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])))).alias("x")).select("x.*")


_NORMAL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_NORMAL} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS x FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT item, ws, least(len(ws), {WIDTH}) AS n FROM b WHERE len(ws) > 0))),
d AS (SELECT row_number() OVER () AS rn, doc_id, {_NORMAL} AS ws FROM documents),
dw AS (SELECT rn, n, i, array_to_string(ws[i:i + n - 1], ' ') AS x FROM (SELECT rn, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT rn, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
w AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rn, i, n FROM h)) GROUP BY rn),
t AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM h) GROUP BY rn)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (rn) LEFT JOIN t USING (rn)
"""
