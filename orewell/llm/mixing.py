"""Operator 4: mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights are summed by cell (source, language, topic). Raking multiplies each cell's factor until the weighted tokens of every source,
language and topic have their target shares; a factor never passes ``trim`` times the mean, so that no rare cell rules the sample. A
document is drawn with the probability factor / largest factor, by a hash of its id: expected shares are the raked ones, and nothing is
drawn twice. So the cell of the largest factor sets the size of the sample. With ``hold`` the probability is the least of 1 and c * factor, where c is
solved so that the sample is expected to hold this share of all tokens: one rare cell moves it no more than its own tokens do, but
cells at 1 fall short of their raked shares, as nothing is drawn twice.

Only cells go through the rounds. They are cut after each round by a written table; marginal sums are aggregated before they are shuffled.

Defined results: a null source or language is a value of its own ("none"); a null or blank text has no tokens, counts nothing, and is drawn
with its cell's factor; equal rows share one fate; without any tokens all factors are 1. An empty table gives an empty table. A table
needs doc_id, text, lang and source only; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_JAVA, stage

#: Topics by content, first match wins: (name, pattern that Java and RE2 read alike).
TOPICS = (("legal", "(?i)licen[sc]e|copyright"), ("contact", "[^ \n]@[^ \n]"), ("technical", "[0-9a-f]{16}|[0-9]{5}"))
OTHER = "prose"
DIMS = ("source", "lang", "topic")
#: A target share is the observed share to this power, which lifts small values and lowers large ones.
SMOOTHING = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS, TRIM = 10, 8.0
#: Up to so many cells go through the rounds in one partition.
FEW_CELLS = 100_000
#: The share of all tokens that the pipeline's sample holds.
HOLD = 0.5


def topic_of(text: Column, topics: tuple = TOPICS, other: str = OTHER) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens (words) of each row."""
    none = lambda c: F.coalesce(F.col(c), F.lit("none")).alias(c)
    return docs.select("doc_id", none("source"), none("lang"), topic_of(F.coalesce("text", F.lit(""))).alias("topic"), F.coalesce(F.regexp_count("text", F.lit(WORD_JAVA)), F.lit(0)).cast("long").alias("n_tokens"))


def smoothed(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of one dimension: ``dim``, ``target``."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("held"))
    total = sums.agg(F.sum(F.pow("held", F.lit(power))).alias("all"))
    return sums.crossJoin(F.broadcast(total)).select(dim, F.coalesce(F.pow("held", F.lit(power)) / F.nullif(F.col("all"), F.lit(0.0)), F.lit(0.0)).alias("target"))  # total is one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, trim: float = TRIM) -> DataFrame:
    """``cells`` (dimensions, ``tokens``) with ``factor``. A target is a table (dimension, ``target``); values without one keep their weight."""
    n, total = cells.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("double")).first()  # two numbers
    # A few cells are kept in one partition, where sums and joins need no exchange; more of them are shuffled.
    near = (lambda df: df.coalesce(1)) if n <= FEW_CELLS else (lambda df: df)
    targets = {d: near(stage(near(t))) for d, t in targets.items()}
    out = near(stage(near(cells.withColumn("factor", F.lit(1.0)))))
    for _ in range(rounds if total else 0):
        for d, t in targets.items():
            sums = out.groupBy(d).agg(F.sum(F.col("tokens") * F.col("factor")).alias("held"))
            step = sums.join(t, d).select(d, F.when(F.col("held") > 0, F.col("target") * F.lit(total) / F.col("held")).alias("step"))
            out = out.join(step, d, "left").select(*DIMS, "tokens", F.least(F.col("factor") * F.coalesce("step", F.lit(1.0)), F.lit(trim)).alias("factor"))
        out = near(stage(near(out)))
    return out


def margins(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """dim, value, target, share: what each value of each dimension should hold of the weighted tokens, and what it holds. Their largest difference says how far the rounds have come, and what ``trim`` has cut off."""
    total = raked.agg(F.sum(F.col("tokens") * F.col("factor")).alias("all"))
    held = raked.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in targets])).alias("k"), (F.col("tokens") * F.col("factor")).alias("w")).groupBy("k.dim", "k.value").agg(F.sum("w").alias("w"))
    asked = None
    for d, t in targets.items():
        t = t.select(F.lit(d).alias("dim"), F.col(d).alias("value"), "target")
        asked = t if asked is None else asked.unionByName(t)
    return asked.join(held, ["dim", "value"], "left").crossJoin(F.broadcast(total)).select("dim", "value", "target", F.coalesce(F.col("w") / F.nullif(F.col("all"), F.lit(0.0)), F.lit(0.0)).alias("share"))  # total is one row


def scaled(raked: DataFrame, hold: float | None = None) -> DataFrame:
    """``raked`` with ``prob``: factor / largest factor, or with ``hold`` the least of 1 and c * factor for this share of all tokens."""
    if hold is None:
        most = raked.agg(F.max("factor").alias("most"))
        return raked.crossJoin(F.broadcast(most)).withColumn("prob", F.round(F.coalesce(F.col("factor") / F.nullif("most", F.lit(0.0)), F.lit(1.0)), 9)).drop("most")  # most is one row
    t, c, last = F.col("tokens").cast("double"), 0.0, -1.0
    while c > last * (1 + 1e-12):  # Newton's steps on a concave sum of ramps: c grows until no further cell reaches 1
        full = F.col("factor") * F.lit(c) >= 1
        row = raked.agg(F.sum(t).alias("all"), F.sum(F.when(full, t)).alias("whole"), F.sum(F.when(~full, t * F.col("factor"))).alias("rest")).first()  # three numbers
        last, c = c, max(c, (hold * row["all"] - (row["whole"] or 0.0)) / row["rest"]) if row["rest"] else c
    return raked.withColumn("prob", F.round(F.least(F.lit(1.0), F.col("factor") * F.lit(c)), 9) if c else F.lit(1.0))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, trim: float = TRIM, hold: float | None = None) -> DataFrame:
    """Per row: doc_id, source, lang, topic, n_tokens, ``factor``, ``prob`` and ``sampled``. Without targets the smoothed shares are used."""
    rows = stage(features(docs))
    cells = stage(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, targets or {d: smoothed(cells, d, SMOOTHING[d]) for d in DIMS}, rounds, trim)
    probs = scaled(raked, hold).drop("tokens")
    return rows.join(probs, list(DIMS)).select("doc_id", *DIMS, "n_tokens", F.round("factor", 6).alias("factor"), F.round("prob", 6).alias("prob"), (draw(F.col("doc_id")) < F.col("prob")).alias("sampled"))


def draw(key: Column) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("none")).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The drawn rows with all their columns. A row's fate depends on its cell and id alone, so cells are joined, not documents."""
    none = lambda c: F.coalesce(F.col(c), F.lit("none")).alias(c)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), none("source"), none("lang"), topic_of(F.coalesce("text", F.lit(""))).alias("topic"))
    return rows.join(mix_cells(docs, **how), list(DIMS)).where(draw(F.col("row.doc_id")) < F.col("prob")).select("row.*")


def mix_cells(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, trim: float = TRIM, hold: float | None = None) -> DataFrame:
    """The raked cells: source, lang, topic, ``prob``."""
    cells = stage(features(docs).groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, targets or {d: smoothed(cells, d, SMOOTHING[d]) for d in DIMS}, rounds, trim)
    return scaled(raked, hold).select(*DIMS, "prob")


def _sql() -> str:
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS) + f" ELSE '{OTHER}' END"
    out = [
        rf"""r AS MATERIALIZED (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, {topic} AS topic,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS factor FROM r GROUP BY ALL)",
    ]
    for d in DIMS:
        out.append(f"t_{d} AS MATERIALIZED (SELECT {d}, pow(held, {SMOOTHING[d]}) / sum(pow(held, {SMOOTHING[d]})) OVER () AS target FROM (SELECT {d}, sum(tokens) AS held FROM c0 GROUP BY {d}))")
    at = 0
    for _ in range(ROUNDS):
        for d in DIMS:
            out.append(
                f"""c{at + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, least(factor * CASE WHEN held > 0 THEN target * total / held ELSE 1 END, {TRIM}) AS factor FROM c{at} c
                JOIN (SELECT {d}, sum(tokens * factor) AS held FROM c{at} GROUP BY {d}) s USING ({d}) JOIN t_{d} USING ({d}) CROSS JOIN (SELECT sum(tokens) AS total FROM c0))"""
            )
            at += 1
    return f"""WITH {', '.join(out)},
    p AS (SELECT source, lang, topic, factor, round(factor / max(factor) OVER (), 9) AS prob FROM c{at})
    SELECT r.doc_id, source, lang, topic, n_tokens, round(factor, 6) AS factor, round(prob, 6) AS prob,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'none')), 1, 12) AS BIGINT) / {float(16**12)} < prob AS sampled
    FROM r JOIN p USING (source, lang, topic)"""


SQL = _sql()
