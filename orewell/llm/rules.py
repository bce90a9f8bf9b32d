"""Operator 9: quality rules with cross-document line frequency, in DataFrame functions only.

A line is normalised (words joined by one space, lower case) and hashed together with its host. A host's distinct texts that hold the
line are counted: exact copies of one document count once, as a text that was copied often would else turn all its own lines into
boilerplate. A line that more of them hold than the host's limit is boilerplate; a document that is left with too few words without its
boilerplate is depleted and rejected.

Defined results: a null text has no words and fails the base rules. A null host is a host of its own. Equal rows get equal results, one
for each row. A document that is one line, however long, is handled like any other. An empty table gives an empty table. Only the id,
the text and the host are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_JAVA, broadcast_if_small, stage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50
#: A line is boilerplate of a host if more distinct texts hold it than this share of the host's texts, and more than MIN_DOCS.
MAX_SHARE, MIN_DOCS = 0.05, 20
#: A document is depleted if fewer than MIN_WORDS words, or less than this share of its words, remain.
MIN_LEFT = 0.3


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACES, " "))))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """``host`` and ``common``, the hashes of its lines beyond the limits: at most 1 / max_share times the lines of its average text."""
    d = docs.select(F.col(host).alias("host"), F.col(text).alias("t"))
    hashes = F.array_distinct(F.transform(lines_of(F.col("t")), line_hash))
    texts = d.select("host", F.xxhash64("t").alias("th")).distinct().groupBy("host").agg(F.count("*").alias("texts"))
    held = d.select("host", F.xxhash64("t").alias("th"), F.explode(hashes).alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    some = held.join(texts, held["host"].eqNullSafe(texts["host"])).where(F.col("docs") > max_share * F.col("texts"))
    return some.groupBy(held["host"]).agg(F.collect_list("h").alias("common"))


def verdicts(docs: DataFrame, text: str = "text", host: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row: ``row`` (all its columns), base counts, ``base_failed``, ``n_removed_words``, ``removed`` (hashes of its boilerplate lines), ``kept``.

    A row gets its host's boilerplate by a join, so its text goes nowhere while that table is small enough to broadcast; beyond that Spark shuffles by host,
    and adaptive execution splits a hot one.
    """
    common = broadcast_if_small(stage(boilerplate(docs, text, host, max_share, min_docs)))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.join(common, F.col("own").eqNullSafe(F.col("host")), "left").drop("own", "host")
    d = d.withColumn("words", F.transform(F.regexp_extract_all("t", F.lit(WORD_JAVA), F.lit(0)), lambda w: F.xxhash64(w)))
    d = d.withColumn("lines", lines_of(F.col("t")))
    m = F.greatest(F.size("words") - 2, F.lit(0))
    d = d.withColumn("windows", F.zip_with(F.zip_with(F.slice("words", 1, m), F.slice("words", 2, m), lambda a, b: F.xxhash64(a, b)), F.slice("words", 3, m), lambda p, c: F.xxhash64(p, c)))
    d = d.withColumn("repeated", F.size("windows") > F.size(F.array_distinct("windows")))
    d = d.withColumn("ranked", F.when(F.col("repeated"), F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    at = lambda i: F.get("ranked", i)["h"]  # noqa: E731  null outside
    twice = F.transform("ranked", lambda x, j: F.when(F.coalesce(at(j - 1) == x["h"], F.lit(False)) | F.coalesce(at(j + 1) == x["h"], F.lit(False)), x["i"]))
    d = d.withColumn("starts", F.when(F.col("repeated"), F.sort_array(F.array_compact(twice))))
    gaps = F.zip_with(F.slice("starts", 1, F.size("starts") - 1), F.slice("starts", 2, F.size("starts") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda s, x: s + x) + 3
    d = d.withColumn("sized", F.when(F.col("common").isNotNull(), F.transform("lines", lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD_JAVA)).alias("n")))))
    d = d.withColumn("removed", F.coalesce(F.array_intersect(F.transform("sized", lambda x: x["h"]), "common"), F.array().cast("array<bigint>")))
    cut = F.aggregate(F.filter("sized", lambda x: F.array_contains("removed", x["h"])), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    found = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("repeated"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.coalesce(F.when(F.size("removed") > 0, cut), F.lit(0)).cast("long").alias("n_removed_words"),
        F.col("removed"),
    )
    # A filter on any count would be pushed below the projections, and these would be put into each other; none is pushed below a generator.
    d = d.select("row", F.explode(F.array(found)).alias("found")).select("row", "found.*")
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    left = F.col("n_words") - F.col("n_removed_words")
    return d.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words")))


def line_rules(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """Per row: key, base counts, ``base_failed``, ``n_removed_words``, ``removed`` and ``kept``."""
    return verdicts(docs, **how).select(F.col("row")[key].alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "removed", "kept")


def apply_rules(docs: DataFrame, text: str = "text", length: str = "n_chars", **how) -> DataFrame:
    """The kept rows with all their columns, without their boilerplate lines; ``length``, if there, follows the text."""
    found = verdicts(docs, text, **how).where("kept")
    old = F.col("row")[text]
    cleaned = F.array_join(F.filter(F.split(old, "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("removed", line_hash(x)))), "\n")
    new = F.when(F.size("removed") > 0, cleaned).otherwise(old)
    cols = {text: new}
    if length in docs.columns:
        cols[length] = F.when(F.size("removed") > 0, F.char_length(new).cast(docs.schema[length].dataType)).otherwise(F.col("row")[length])
    return found.select(*[cols.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, text AS raw, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT rn, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, x) AS n FROM win) WHERE n >= 2),
rep AS (SELECT rn, count(DISTINCT p) AS n_repeat_words FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rn),
l AS (SELECT rn, source, raw, x, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS nx, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
      FROM (SELECT rn, source, raw, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT rn, count(*) - count(DISTINCT x) AS n_dup_lines FROM l GROUP BY rn),
texts AS (SELECT source, count(DISTINCT coalesce('t' || raw, 'n')) AS texts FROM d GROUP BY source),
common AS (SELECT h.source, h.nx FROM (SELECT source, nx, count(DISTINCT coalesce('t' || raw, 'n')) AS docs FROM l GROUP BY source, nx) h
           JOIN texts ON h.source IS NOT DISTINCT FROM texts.source WHERE docs > {MIN_DOCS} AND docs > {MAX_SHARE} * texts.texts),
cut AS (SELECT rn, sum(n) AS cut FROM l JOIN common c ON l.nx = c.nx AND l.source IS NOT DISTINCT FROM c.source GROUP BY rn),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(cut, 0) AS BIGINT) AS n_removed_words
      FROM d JOIN w USING (rn) LEFT JOIN dup USING (rn) LEFT JOIN rep USING (rn) LEFT JOIN cut USING (rn)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, n_words - n_removed_words AS n_left FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND n_left >= {MIN_WORDS} AND n_left >= {MIN_LEFT} * n_words AS kept FROM f
"""
