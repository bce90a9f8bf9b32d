"""Decontamination against its SQL, odd tables, removal of spans and documents."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa

from orewell.llm import decontaminate

from .test_operators import docs, documents, empty, prose  # noqa: F401

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string, words string")


def sql_rows(df, bench):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([r.asDict() for r in df.select("doc_id", "text").collect()], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())])))
    con.register("benchmark", pa.Table.from_pylist([r.asDict() for r in bench.select("item_id", "text").collect()], schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())])))
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({decontaminate.SQL})").fetchall(), key=str)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def planted(spark):
    r = random.Random(4)
    bench = [(i, prose(500 + i, r.choice([1, 2, 3, 4, 7, 9, 10, 11, 30]))) for i in range(20)] + [(3, prose(503, 15)), (77, prose(505, 30)), (78, None), (79, " .,; "), (80, "ÉTÉ à la 日本 x1")]
    texts = []
    for i in range(120):
        words = prose(900 + i, r.randrange(0, 60)).split(" ")
        for _ in range(r.randrange(0, 3)):
            found = (r.choice(bench)[1] or "").upper().replace(" ", r.choice([" ", ", ", "--"]))
            words.insert(r.randrange(len(words) + 1), found)
        texts.append((i, " ".join(words)))
    same = prose(505, 30)
    texts += [(5, same), (5, same), (None, same), (6, (same + " ") * 20), (7, None), (8, ""), (9, "Été À la 日本 X1")]
    return documents(spark, texts), items(spark, [(i, t, "clash", "clash") for i, t in bench])


def test_contamination_equals_sql(spark, docs, empty):  # noqa: F811
    df, bench = planted(spark)
    want = sql_rows(df, bench)
    assert sum(r[5] for r in want) > 30 and rows(decontaminate.contamination(df, bench)) == want
    short = docs.where("doc_id is null or doc_id <> 8")  # the SQL copies all words for each window
    assert rows(decontaminate.contamination(short, bench)) == sql_rows(short, bench)
    assert decontaminate.contamination(docs.where("doc_id = 8"), bench).first()["n_words"] == 60_000
    assert decontaminate.contamination(empty, bench).collect() == []
    none = rows(decontaminate.contamination(df, items(spark, [])))
    assert len(none) == df.count() and not any(r[2] or r[3] or r[5] for r in none)


def test_windows_beyond_the_limit_are_met_in_parts(spark):
    df, bench = planted(spark)
    assert rows(decontaminate.contamination(df, bench, limit=2000)) == sql_rows(df, bench)


def test_an_item_without_an_id_counts(spark):
    got = decontaminate.contamination(documents(spark, [(1, "a b c")]), items(spark, [(None, "B", "", "")])).first()
    assert (got["n_hit"], got["n_items"], got["contaminated"]) == (1, 1, True)


def test_a_filter_on_the_result_gives_the_same_rows(spark):
    df, bench = planted(spark)
    assert rows(decontaminate.contamination(df, bench).where("contaminated")) == [r for r in sql_rows(df, bench) if r[5]]


def test_spans_and_documents_are_removed(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    other = " ".join(f"v{i}" for i in range(30))
    df = documents(spark, [(1, f"Before, {passage.upper()}. after\n{other}"), (2, passage), (3, other), (4, None), (5, "")])
    bench = items(spark, [(1, passage, "", "")])
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {1: f"Before, after\n{other}", 3: other, 4: None, 5: ""}
    whole = decontaminate.decontaminate(df, bench, whole=True)
    assert sorted(r["doc_id"] for r in whole.collect()) == [3, 4, 5] and whole.columns == df.columns
    assert decontaminate.decontaminate(df, bench).where("text like 'Before%'").count() == 1
