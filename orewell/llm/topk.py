"""Operator 7: exact top-k inner products by pivot-table elimination.

Inner products become distances: with m the largest squared norm, x gets one more component sqrt(m - |x|^2) and a query gets 0, so that
|q' - x'|^2 = |q|^2 + m - 2 q.x, and the nearest vectors are those of the largest products. A table, computed once and stored with the vectors, holds each
vector's distance to PIVOTS pivots. By the triangle inequality the largest difference of two vectors' pivot distances is a lower bound of their distance.
A query's candidates are evaluated in the order of their bounds, until the next bound is beyond the distance of its k-th best.

Vectors lie in blocks of about BLOCK rows by their nearest pivot. Each query first meets its own block, which gives it a threshold; it then goes to those
blocks only whose ranges of pivot distances allow a better product, and carries the threshold along. A block is a row, dealt to a task with the queries
sent to it, which pass one batch at a time; no product of blocks and queries is formed. Nothing is collected but pivots (a fixed number) and the blocks'
ranges, if these hold at most RANGE_BYTES; beyond that no block is ruled out as a whole. ``n_evaluated`` of a query reports the products taken.

Products are exact: vectors of a squared norm under 2**52 are multiplied in doubles, where every sum is exact; others ("large") in whole numbers of any
size, without bounds. A product beyond a long counts as the nearest long.

Defined results: vectors that are null, empty, or hold a null or a non-finite component take no part, nor do null ids. Only vectors of one length are
compared; those of another length than most have no pivots and meet all of their length. Ties go to the smaller id. A row is not its own candidate, but other rows
of the same id are. With fewer than k candidates all are returned. An empty table gives an empty table. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, groups, stage

PIVOTS, BLOCK, QUERIES, FIRST, RANGE_BYTES = 64, 8192, 65_536, 64, 32 << 20
#: Below this squared norm of both vectors every partial sum of a product is a whole number that a double holds.
PLAIN = 2.0**52
LARGE, WITHOUT = -2, -1  # cells of large vectors, and of lengths without pivots


def finite(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``rid`` (a number for each row), ``id``, ``v``, ``asks`` of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    return d.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"), v.alias("v"), is_query.alias("asks"))


class Table:
    """The pivots, and distances to them."""

    def __init__(self, pivots: np.ndarray, most: float, scale: float, cells: int):
        self.scale, self.most, self.cells = scale, most, max(1, min(cells, len(pivots)))
        self.p = np.hstack([pivots, np.sqrt(np.maximum(most - (pivots * pivots).sum(1), 0))[:, None]])
        self.slack = 4e-6 * most**0.5  # beyond what rounding moves a distance

    def distances(self, m: np.ndarray, lift: np.ndarray) -> np.ndarray:
        p = self.p
        return np.sqrt(np.maximum((m * m).sum(1)[:, None] + (lift**2)[:, None] + (p * p).sum(1) - 2 * (m @ p[:, :-1].T + lift[:, None] * p[:, -1]), 0)).astype(np.float32)

    def lift(self, m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (m * m).sum(1), 0))

    def reach(self, q: np.ndarray, score: float) -> float:
        """The distance of a candidate with this product."""
        return float(max((q * q).sum() + self.most - 2 * score, 0)) ** 0.5


def whole(m: np.ndarray, scale: float) -> list[list[int]]:
    return [[floor(Fraction(x) * Fraction(scale)) for x in row] for row in m.tolist()]


def placed(rows: DataFrame, table: Table, width: int) -> DataFrame:
    """``rows`` with ``width``, ``cell``, the table's distances ``t`` (as candidate) and ``own`` (as query); ``v`` as bytes, scaled to whole numbers unless large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").to_pylist()
            out = {"width": [len(x) for x in v], "cell": [], "v": [], "t": [], "own": []}
            for x in v:
                x = np.array(x)
                with np.errstate(over="ignore"):
                    y = np.floor(x * table.scale)
                    plain = (y * y).sum() < PLAIN
                out["v"].append((y if plain else x).tobytes())
                out["cell"].append(LARGE if not plain else WITHOUT)
            with_pivots = [i for i, (w, c) in enumerate(zip(out["width"], out["cell"], strict=True)) if w == width and c == WITHOUT]
            out["t"], out["own"] = [b""] * len(v), [b""] * len(v)
            if with_pivots:
                m = np.frombuffer(b"".join(out["v"][i] for i in with_pivots)).reshape(-1, width)
                for c, d in (("t", table.distances(m, table.lift(m))), ("own", table.distances(m, np.zeros(len(m))))):
                    for i, row in zip(with_pivots, d, strict=True):
                        out[c][i] = row.tobytes()
                        if c == "t":
                            out["cell"][i] = int(row[: table.cells].argmin())
            yield pa.RecordBatch.from_pydict({"rid": b.column("rid"), "id": b.column("id"), "asks": b.column("asks"), "width": pa.array(out["width"], pa.int32()), "cell": pa.array(out["cell"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("v", "t", "own")}})

    return rows.mapInArrow(run, "rid long, id long, asks boolean, width int, cell int, v binary, t binary, own binary")


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``placed`` as blocks: width, cell, part, ids, vectors and table as bytes, and for each pivot the least and largest distance."""
    sizes = rows.groupBy("width", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = rows.join(sizes, ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).drop("parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, "width", "cell", "part"):
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                g = t.slice(s, e - s)
                held = {c: [b"".join(g.column(c).to_pylist())] for c in ("v", "t", "own")}
                d = np.frombuffer(held["t"][0], np.float32).reshape(e - s, -1)
                yield pa.RecordBatch.from_pydict({c: pa.array(g.column(c).to_pylist()[:1], pa.int32()) for c in ("width", "cell", "part")} | {c: [g.column(c).to_numpy().astype(kind).tobytes()] for c, kind in (("rid", np.int64), ("id", np.int64), ("asks", bool))} | held | {"lo": [d.min(0).tobytes()], "hi": [d.max(0).tobytes()]})

    return dealt.repartition("width", "cell", "part").sortWithinPartitions("width", "cell", "part").mapInArrow(run, "width int, cell int, part int, rid binary, id binary, asks binary, v binary, t binary, own binary, lo binary, hi binary")


class Block:
    """A block's rows, by id, so that ties come in order."""

    def __init__(self, r: dict):
        self.ids, self.rids = np.frombuffer(r["id"], np.int64), np.frombuffer(r["rid"], np.int64)
        order = np.argsort(self.ids, kind="stable")
        n = len(order)
        self.ids, self.rids, self.large = self.ids[order], self.rids[order], r["cell"] == LARGE
        self.x = np.frombuffer(r["v"]).reshape(n, -1)[order]
        self.t = np.frombuffer(r["t"], np.float32).reshape(n, -1)[order]
        self.own = np.frombuffer(r["own"], np.float32).reshape(n, -1)[order]
        self.asks = np.frombuffer(r["asks"], bool)[order]
        self.exact: list[list[int]] | None = None

    def best(self, q: np.ndarray, large: bool, own: np.ndarray, rid: int, least: float | None, k: int, table: Table) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, products, evaluated) of the k best of at least the product ``least``."""
        n = len(self.ids)
        if large or self.large:
            if self.exact is None:
                self.exact = whole(self.x, table.scale) if self.large else [[int(y) for y in row] for row in self.x.tolist()]
            a = whole(q[None], table.scale)[0] if large else [int(y) for y in q.tolist()]
            limit = (1 << 63) - 1
            products = np.array([max(-limit - 1, min(limit, sum(x * y for x, y in zip(a, row, strict=True)))) for row in self.exact], np.int64)
            at = np.flatnonzero(self.rids != rid)
            at = at[np.argsort(-products[at].astype(object), kind="stable")[:k]]
            return at, products[at], n
        bound = np.abs(self.t - own).max(1) if self.t.shape[1] and len(own) else np.zeros(n, np.float32)
        near = np.flatnonzero(bound - table.slack <= table.reach(q, least)) if least is not None else np.arange(n)
        near = near[self.rids[near] != rid]
        near = near[np.argsort(bound[near], kind="stable")]
        at, products, done, step = near[:0], np.zeros(0), 0, FIRST
        while done < len(near):
            some = near[done : done + step]
            at, products = np.concatenate([at, some]), np.concatenate([products, self.x[some] @ q])
            keep = np.lexsort((at, -products))[:k]
            at, products, done, step = at[keep], products[keep], done + len(some), 4 * step
            # Stop when no later bound can reach the k-th product; ties are within the slack and so evaluated.
            if len(at) == k and done < len(near) and bound[near[done]] - table.slack > table.reach(q, max(float(products[-1]), -np.inf if least is None else least)):
                break
        if least is not None:
            at, products = at[products >= least], products[products >= least]
        return at, products.astype(np.int64), done


RESULT = "rid long, query_id long, id long, score long, n_evaluated long"


def _answers(rid: int, query: int, block: Block, found: tuple) -> dict:
    """A query's rows of one block; the first has the number of products taken."""
    at, products, n = found
    ids, scores = block.ids[at].tolist() or [None], products.tolist() or [None]
    return {"rid": [rid] * len(ids), "query_id": [query] * len(ids), "id": ids, "score": scores, "n_evaluated": [n] + [0] * (len(ids) - 1)}


def _batch(parts: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: [x for p in parts for x in p[f.name]] for f in schema}, schema=schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score, n_evaluated for the rows that ``is_query`` marks, against all other rows; components count as floor(scale * x)."""
    spark = vectors.sparkSession
    rows = stage(finite(vectors, is_query, key, vector))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(F.least(F.abs(x) * scale, F.lit(2.0**27)) + 1).cast("double") ** 2)
    widths = rows.withColumn("sq", squares).where(F.col("sq") < PLAIN).groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max("sq").alias("most")).orderBy(F.desc("n"), F.desc("w")).first()  # one row
    width, n, most = (widths["w"], widths["n"], widths["most"]) if widths else (0, 0, 0.0)
    chosen = rows.where((F.size("v") == width) & (squares < PLAIN)).orderBy(F.xxhash64("v"), "id").limit(pivots).collect() if n else []  # a fixed number
    table = Table(np.floor(np.array([r["v"] for r in chosen]).reshape(len(chosen), width) * scale), most, scale, -(-n // BLOCK)) if n else Table(np.zeros((1, 0)), 0.0, scale, 1)
    held = stage(blocks(placed(rows, table, width)))
    discard(rows)
    columns = ["width", "cell", "part", "lo", "hi"]
    ranges = held.select(*columns).collect() if held.count() * 8 * pivots <= RANGE_BYTES else None  # checked
    shared = spark.sparkContext.broadcast((table, ranges))
    result = pa.schema([(c, pa.int64()) for c in ("rid", "query_id", "id", "score", "n_evaluated")])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                block = Block(r)
                for i in np.flatnonzero(block.asks).tolist():
                    at, products, n = block.best(block.x[i], block.large, block.own[i], int(block.rids[i]), None, k, table)
                    yield pa.RecordBatch.from_pydict({
                        "rid": [int(block.rids[i])], "query_id": [int(block.ids[i])], "width": pa.array([r["width"]], pa.int32()), "cell": pa.array([r["cell"]], pa.int32()), "part": pa.array([r["part"]], pa.int32()),
                        "q": [block.x[i].tobytes()], "own": [block.own[i].tobytes()], "least": pa.array([int(products[-1]) if len(at) == k else None], pa.int64()),
                        "ids": [block.ids[at].tolist()], "scores": pa.array([products.tolist()], pa.list_(pa.int64())), "n": [n],
                    })

    home = "rid long, query_id long, width int, cell int, part int, q binary, own binary, least long, ids array<long>, scores array<long>, n long"
    first = stage(held.where(F.expr("instr(hex(asks), '01') > 0")).mapInArrow(at_home, home))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranges = shared.value
        where = np.array([(r["width"], r["cell"], r["part"]) for r in ranges], np.int32).reshape(-1, 3)
        pivoted = np.array([len(r["lo"]) > 0 for r in ranges])
        lo, hi = (np.array([np.frombuffer(r[c], np.float32) if r[c] else np.zeros(len(table.p), np.float32) for r in ranges]) for c in ("lo", "hi"))
        for b in batches:
            for r in b.to_pylist():
                go = (where[:, 0] == r["width"]) & ~((where[:, 1] == r["cell"]) & (where[:, 2] == r["part"]))
                if r["own"] and r["least"] is not None:
                    own = np.frombuffer(r["own"], np.float32)
                    bound = np.maximum(np.maximum(lo - own, own - hi), 0).max(1) - table.slack
                    go &= ~pivoted | (bound <= table.reach(np.frombuffer(r["q"]), r["least"]))
                to = where[go]
                yield pa.RecordBatch.from_pydict({"width": to[:, 0], "cell": to[:, 1], "part": to[:, 2]} | {c: pa.array([r[c]] * len(to), kind) for c, kind in (("rid", pa.int64()), ("query_id", pa.int64()), ("large", pa.bool_()), ("q", pa.binary()), ("own", pa.binary()), ("least", pa.int64()))})

    asked = first.withColumn("large", F.col("cell") == LARGE).select("width", "cell", "part", "rid", "query_id", "large", "q", "own", "least")
    if ranges is not None:
        sent = asked.mapInArrow(route, asked.schema)
    else:
        every = held.select("width", F.struct("cell", "part").alias("to"))
        sent = asked.alias("a").join(every, "width").where((F.col("to.cell") != F.col("a.cell")) | (F.col("to.part") != F.col("a.part"))).select("width", "to.cell", "to.part", "rid", "query_id", "large", "q", "own", "least")
    # A block's queries are split into parts of about QUERIES, each with the block; the block comes first in its group.
    splits = max(1, -(-first.count() // QUERIES))
    to_block = sent.withColumn("split", F.pmod(F.xxhash64("rid"), F.lit(splits)).cast("int")).select("width", "cell", "part", "split", F.lit(None).cast("binary").alias("block_rid"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("binary").alias("t"), "rid", "query_id", "large", "q", "own", "least")
    copies = held.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).select("width", "cell", "part", "split", F.col("rid").alias("block_rid"), "id", "t", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("boolean").alias("large"), F.col("v").alias("q"), "own", F.lit(None).cast("long").alias("least"))
    dealt = copies.unionByName(to_block).repartition("width", "cell", "part", "split").sortWithinPartitions("width", "cell", "part", "split", F.col("block_rid").isNull())

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, block = shared.value[0], None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["block_rid"] is not None:
                    block = Block({"id": r["id"], "rid": r["block_rid"], "cell": r["cell"], "v": r["q"], "t": r["t"], "own": r["own"], "asks": bytes(len(r["id"]) // 8)})
                else:
                    found = block.best(np.frombuffer(r["q"]), r["large"], np.frombuffer(r["own"], np.float32), r["rid"], r["least"], k, table)
                    out.append(_answers(r["rid"], r["query_id"], block, found))
            if out:
                yield _batch(out, result)

    away = dealt.mapInArrow(evaluate, RESULT)
    own = first.select("rid", "query_id", F.explode_outer(F.arrays_zip("ids", "scores")).alias("x"), "n").select("rid", "query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"), F.lit(0).cast("long").alias("n_evaluated"))
    counted = first.select("rid", "query_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("score"), F.col("n").alias("n_evaluated"))
    found = away.unionByName(own).unionByName(counted)
    w = Window.partitionBy("rid")
    ranked = found.withColumn("n_evaluated", F.sum("n_evaluated").over(w)).where(F.col("id").isNotNull()).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "n_evaluated")


def nearest_products(vectors: DataFrame) -> DataFrame:
    """The contract: queries are the ids divisible by 50; query_id, rank, vec_id, score."""
    return top_k(vectors, F.col("vec_id") % 50 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def evaluated_share(vectors: DataFrame, **how) -> float:
    """The share of all products of queries and candidates that was taken."""
    found = top_k(vectors, F.col("vec_id") % 50 == 0, **how).groupBy("query_id").agg(F.max("n_evaluated").alias("n"))
    queries, taken = found.agg(F.count("*"), F.sum("n")).first()
    return taken / (queries * max(1, vectors.count() - 1)) if queries else 0.0


SQL = """
WITH v AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rn, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
