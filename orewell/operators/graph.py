"""Module graphs: vertices (``node``, ``path``, ...) and edges (``src``, ``dst``), joined and walked by DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scores import severity_of, severity_ord
from ..session import staged

#: Edges that a round walks before its table is written.
STEPS = 4
#: Edges that one task finishes: a bound on its memory; the rows are the same either way.
FINISH = 200_000


def _met(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides. A walk has many rounds, and small sides that were broadcast in each of them would all pass through the driver."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def imported_by(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Per module the number of modules that import it; 0 for none. Edges are counted before they meet the modules."""
    n = edges.where("src <> dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("importers"))
    return modules.select("node").join(n, "node", "left").select("node", F.coalesce("importers", F.lit(0)).cast("long").alias("importers"))


def dangling(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is no module."""
    return edges.join(modules.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def layer_violations(modules: DataFrame, edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Edges whose source path matches a rule's first pattern and whose target path matches its second: (name, from, to). Rules are a few columns, no join."""
    a = modules.select(F.col("node").alias("src"), F.col("path").alias("from_path"))
    b = modules.select(F.col("node").alias("dst"), F.col("path").alias("to_path"))
    hits = F.array_compact(F.array(*[F.when(F.col("from_path").rlike(x) & F.col("to_path").rlike(y), F.lit(name)) for name, x, y in rules]))
    touched = a.where(F.col("from_path").rlike("|".join(f"(?:{x})" for _, x, _ in rules)))
    return edges.join(touched, "src").join(b, "dst").select("src", "dst", F.explode(hits).alias("rule"))


def reachable(modules: DataFrame, edges: DataFrame, is_entry: str = "is_entry", steps: int = STEPS, finish: int = FINISH) -> DataFrame:
    """``node``, ``depth``: modules that some entry point reaches, with the fewest steps.

    At most ``finish`` edges are walked in one task. Beyond that a round walks ``steps`` edges from the frontier in one plan and is cut by a written table; the next frontier is what the last of the steps found.
    """
    edges = staged(_met(edges.select("src", "dst").where("src <> dst").distinct(), modules.select(F.col("node").alias("dst")), "dst", "left_semi"))
    seen = front = staged(modules.where(is_entry).select("node").distinct().withColumn("depth", F.lit(0)))
    if edges.count() <= finish:
        return _walked(edges, seen)
    depth = 0
    while True:
        met, found = front.select("node"), None
        for k in range(1, steps + 1):
            met = _met(edges, met.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
            step = met.withColumn("depth", F.lit(depth + k))
            found = step if found is None else found.unionByName(step)
        new = staged(_met(found.groupBy("node").agg(F.min("depth").alias("depth")), seen, "node", "left_anti"))
        depth += steps
        seen = staged(seen.unionByName(new))
        front = new.where(F.col("depth") == depth)
        if front.isEmpty():
            return seen


def _walked(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries`` (node, depth 0) that the few edges touch and what they reach, in one task; entries without an edge stay where they are."""
    kind = edges.schema["src"].dataType
    schema = StructType([StructField("node", kind), StructField("depth", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x
        front, whole, depth = {}, {}, 0
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole[plain(y)] = y
                (front if x is None else out.setdefault(plain(x), {}))[plain(y)] = None
        met, rows = set(front), []
        while front:
            depth += 1
            front = {b: None for a in front for b in out.get(a, ()) if b not in met}
            met.update(front)
            rows += [{"node": whole[b], "depth": depth} for b in front]
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    touched = entries.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(F.lit(None).cast(kind).alias("src"), F.col("node").alias("dst"))
    beyond = edges.join(entries.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return entries.unionByName(touched.unionByName(beyond).coalesce(1).mapInArrow(run, schema))


def scan_reachable(modules: DataFrame, edges: DataFrame, local: int = 200_000) -> DataFrame:
    """scan_id, path: modules (scan_id, path, is_entry) that an entry point of their scan reaches by its edges (scan_id, src, dst). A scan of at most ``local`` edges is one group; larger ones go through ``reachable``."""
    sizes = edges.groupBy("scan_id").agg(F.count("*").alias("n_edges"))
    starts = modules.where("is_entry").select("scan_id", F.lit(None).cast("string").alias("src"), F.col("path").alias("dst"))

    def run(rows: pa.Table) -> pa.Table:
        out: dict[str, list[str]] = {}
        for a, b in zip(rows["src"].to_pylist(), rows["dst"].to_pylist(), strict=True):
            out.setdefault(a, []).append(b)
        front = met = set(out.pop(None, ()))
        while front:
            front = {b for a in front for b in out.get(a, ())} - met
            met = met | front
        scan = pa.array([rows["scan_id"][0]] * len(met), rows.schema.field("scan_id").type)
        return pa.table({"scan_id": scan, "path": pa.array(sorted(met), pa.string())})

    kind = modules.schema["scan_id"].dataType.simpleString()
    sized = starts.unionByName(edges.select("scan_id", "src", "dst")).join(sizes, "scan_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    small = sized.where(F.col("n_edges") <= local).select("scan_id", "src", "dst").groupBy("scan_id").applyInArrow(run, f"scan_id {kind}, path string")
    large = sized.where(F.col("n_edges") > local)
    if large.isEmpty():
        return small
    node = lambda c: F.struct("scan_id", F.col(c).alias("path"))
    walked = large.where("src is not null").select(node("src").alias("src"), node("dst").alias("dst"))
    found = reachable(modules.join(large.select("scan_id").distinct(), "scan_id", "left_semi").select(node("path").alias("node"), "is_entry"), walked, finish=local)
    return small.unionByName(found.select("node.scan_id", "node.path"))


def degrees(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Per module its different sources (``n_in``) and targets (``n_out``)."""
    own = edges.where("src <> dst").distinct()
    # One grouping for both directions.
    ends = own.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    n = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return modules.select("node").join(n, "node", "left").select("node", F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"), F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"))


def large_modules(modules: DataFrame, loc: int = 500, n_exports: int = 12, top: int = 4, high: int = 1000) -> DataFrame:
    """The ``top`` modules by lines among those with many lines and many exports; ties to the smaller node."""
    big = modules.where((F.col("loc") > loc) & (F.col("n_exports") >= n_exports)).orderBy(F.desc("loc"), "node").limit(top)
    return big.select("node", "loc", "n_exports", F.when(F.col("loc") > high, "high").otherwise("medium").alias("severity"))


def component(path: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first rule (name, pattern) that matches the path."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(path.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def collapse(modules: DataFrame, edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Import edges between different components: ``from``, ``to``, ``weight``."""
    named = modules.select("node", component(F.col("path"), rules).alias("c"))
    a, b = named.select(F.col("node").alias("src"), F.col("c").alias("from")), named.select(F.col("node").alias("dst"), F.col("c").alias("to"))
    return edges.join(a, "src").join(b, "dst").where(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count("*").alias("weight"))


def component_risk(findings: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Per component its live findings and their worst severity; dismissed ones do not count."""
    live = findings.where("validation <> 'dismissed'").withColumn("component", component(F.col("path"), rules))
    return live.groupBy("component").agg(F.count("*").alias("findings"), severity_of(F.min(severity_ord(F.col("severity")))).alias("worst"))


def components_of(edges: dict) -> Iterator[list]:
    """Strongly connected components of two or more: nodes in the order in which a walk leaves them, then walks against the edges from the last one back."""
    back: dict = {}
    for a, to in edges.items():
        for b in to:
            back.setdefault(b, []).append(a)

    def walk(start, nexts: dict, seen: set) -> list:
        left, stack = [], [(start, iter(nexts.get(start, ())))]
        seen.add(start)
        while stack:
            node, more = stack[-1]
            new = next((x for x in more if x not in seen), None)
            if new is None:
                left.append(node)
                stack.pop()
            else:
                seen.add(new)
                stack.append((new, iter(nexts.get(new, ()))))
        return left

    seen: set = set()
    order = [n for start in sorted(edges) if start not in seen for n in walk(start, edges, seen)]
    seen = set()
    for start in reversed(order):
        if start not in seen:
            met = walk(start, back, seen)
            if len(met) > 1:
                yield sorted(met)


def _finish(edges: DataFrame) -> DataFrame:
    """Components of few edges, in one task."""
    kind = edges.schema["src"].dataType
    arrow = to_arrow_schema(StructType([StructField("node", kind), StructField("cycle", kind)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x  # noqa: E731  nodes of several fields
        whole: dict = {}
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole.setdefault(plain(x), x), whole.setdefault(plain(y), y)
                out.setdefault(plain(x), []).append(plain(y))
        found = [{"node": whole[n], "cycle": whole[c[0]]} for c in components_of(out) for n in c]
        yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, StructType([StructField("node", kind), StructField("cycle", kind)]))


def _trimmed(edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """Without the edges that lie on no cycle because an end has no way in or no way out, ``steps`` times."""
    for _ in range(steps):
        ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = _met(_met(edges, ins, "src", "left_semi"), outs, "dst", "left_semi").select("src", "dst")
    return staged(edges)


def _chains(edges: DataFrame) -> DataFrame:
    """Nodes with one edge in and one out: ``node``, the first nodes ``b`` and ``f`` without that before and after them, and ``least``, the least node from here to ``f``.

    Pointers jump twice as far in each round, so a chain takes the logarithm of its length. On a ring of such nodes ``f`` is one of them, and ``least`` the least of the ring.
    """
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.first("src").alias("b"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.first("dst").alias("f"))
    c = staged(_met(ins, outs, "node").where("i = 1 and o = 1").select("node", "b", "f", F.col("node").alias("least")))
    rounds = max(1, c.count()).bit_length() + 1
    for _ in range(rounds):
        ahead = c.select(F.col("node").alias("f"), F.col("f").alias("f2"), F.col("least").alias("least2"))
        behind = c.select(F.col("node").alias("b"), F.col("b").alias("b2"))
        c = staged(_met(_met(c, ahead, "f", "left"), behind, "b", "left").select("node", F.coalesce("b2", "b").alias("b"), F.coalesce("f2", "f").alias("f"), F.least("least", F.coalesce("least2", "least")).alias("least"), (F.col("f2").isNotNull() | F.col("b2").isNotNull()).alias("moved")))
        if c.where("moved").isEmpty():
            break
    return c.drop("moved")


def cycles(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """``node``, ``cycle``: strongly connected components of two nodes or more, named by their least node. Nodes may have several fields, as a struct.

    A round trims what cannot lie on a cycle. If many nodes stand in chains, these become single edges, by doubling, and their nodes follow the edges' ends afterwards. Else every node takes the least node
    that reaches it, and walks back from those least nodes inside their own colour meet one component for each colour. What is left is the next round's graph; at most ``finish`` edges are finished in
    one task. All rounds are joins, cut by written tables.
    """
    return _named(_cycles(staged(edges.where("src <> dst").select("src", "dst").distinct()), finish))


def _named(found: DataFrame) -> DataFrame:
    """Components of two or more by their least node."""
    sizes = found.groupBy("cycle").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    return _met(found, sizes, "cycle").select("node", F.col("least").alias("cycle"))


def _cycles(live: DataFrame, finish: int) -> DataFrame:
    if live.count() <= finish:
        return _finish(live)
    live = _trimmed(live)
    n = live.count()
    if n <= finish:
        return _finish(live)
    chains = _chains(live)
    return _without_chains(live, chains, finish) if 4 * chains.count() >= n else _coloured(live, finish)


def _without_chains(live: DataFrame, chains: DataFrame, finish: int) -> DataFrame:
    own = chains.select(F.col("node").alias("f"))
    rings, chains = _met(chains, own, "f", "left_semi"), staged(_met(chains, own, "f", "left_anti").select("node", "b", "f"))
    rest = _met(_met(live, own.select(F.col("f").alias("src")), "src", "left_anti"), own.select(F.col("f").alias("dst")), "dst", "left_anti").select("src", "dst")
    found = staged(_cycles(staged(rest.unionByName(chains.where("b <> f").select(F.col("b").alias("src"), F.col("f").alias("dst"))).distinct()), finish))
    # A chain lies on a cycle if its ends are one node or in one component.
    loops = _met(chains.where("b = f").select(F.col("b").alias("node")).distinct(), found.select("node"), "node", "left_anti").select("node", F.col("node").alias("cycle"))
    held = found.unionByName(loops)
    at_b, at_f = held.select(F.col("node").alias("b"), F.col("cycle").alias("x")), held.select(F.col("node").alias("f"), F.col("cycle").alias("y"))
    inner = _met(_met(chains, at_b, "b"), at_f, "f").where("x = y").select("node", F.col("x").alias("cycle"))
    return held.unionByName(inner).unionByName(rings.select("node", F.col("least").alias("cycle")))


def _coloured(live: DataFrame, finish: int) -> DataFrame:
    colour = staged(live.select(F.col("src").alias("node")).union(live.select(F.col("dst").alias("node"))).distinct().withColumn("cycle", F.col("node")))
    while True:
        new = colour.withColumn("old", F.col("cycle"))
        for _ in range(STEPS):
            seen = _met(live, new.select(F.col("node").alias("src"), "cycle"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("cycle").alias("least"))
            new = _met(new, seen, "node", "left").select("node", "old", F.least("cycle", F.coalesce("least", "cycle")).alias("cycle"))
        new = staged(new)
        colour = new.select("node", "cycle")
        if new.where("old <> cycle").isEmpty():
            break
    a, b = colour.select(F.col("node").alias("src"), "cycle"), colour.select(F.col("node").alias("dst"), F.col("cycle").alias("c"))
    inside = staged(_met(_met(live, a, "src"), b, "dst").where("cycle = c").select("src", "dst", "cycle"))
    met = front = staged(colour.where("node = cycle"))
    while True:
        step, steps = front, None
        for _ in range(STEPS):
            step = _met(inside, step.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "cycle").distinct()
            steps = step if steps is None else steps.unionByName(step)
        front = staged(_met(steps.distinct(), met, "node", "left_anti"))
        if front.isEmpty():
            break
        met = staged(met.unionByName(front))
    rest = _met(_met(live, met.select(F.col("node").alias("src")), "src", "left_anti"), met.select(F.col("node").alias("dst")), "dst", "left_anti")
    return met.unionByName(_cycles(staged(rest.select("src", "dst")), finish))
