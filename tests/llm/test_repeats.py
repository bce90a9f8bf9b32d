"""One id and text that stands very many times must neither take a sample nor gather in one group."""

from __future__ import annotations

from pyspark.sql import functions as F

from orewell.llm import language, packing

N = 100_000


def test_repeated_rows_take_one_place_of_the_language_sample(spark):
    many = spark.range(N).select(F.lit(1).cast("long").alias("doc_id"), F.lit("aaa bbb aaa").alias("text"), F.lit("x").alias("lang"))
    rest = spark.range(2, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit("ccc ddd "), F.col("id").cast("string")).alias("text"), F.lit("y").alias("lang"))
    once = language.fit(many.limit(1).unionByName(rest), sample=100)
    often = language.fit(many.unionByName(rest), sample=100)
    assert once.langs == often.langs and set(often.langs) == {"x", "y"}
    assert language.identify(rest, often).where("lang_pred = 'y'").count() == rest.count()
    assert language.identify(rest, once).collect() == language.identify(rest, often).collect()


def test_null_texts_and_two_texts_of_one_id_are_learned(spark):
    rows = spark.createDataFrame([(1, "aaa", "x"), (1, "bbb", "x"), (1, None, "x"), (2, "ccc", None), (None, "ddd", "y")], "doc_id long, text string, lang string")
    assert language.fit(rows).langs == ["x"]


def test_equal_rows_are_packed_by_many_groups(spark):
    rows = spark.range(N).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    packed = packing.pack(rows).cache()
    assert packed.count() == N and packed.select("sequence_id", "offset").distinct().count() == N
    per = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.max("offset").alias("last"))
    assert per.where("last <> 300 * (n - 1)").count() == 0 and per.agg(F.max("n")).first()[0] == 6
    assert per.count() == -(-N // 6)
