"""The corpus pipeline: each stage keeps what its operator keeps, with the columns of documents."""

from pyspark.sql import functions as F

import corpus_pipeline
from oxidara.llm import exact_dedup, ngram_join

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "exact_dedup", "ngram_join", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        if name == "exact_dedup":
            assert after.count() == docs.select(F.regexp_replace(F.coalesce("text", F.lit("")), exact_dedup.BLANK, "")).distinct().count()
        if name == "ngram_join":
            assert after.count() == ngram_join.ngram_join(docs).select("component_id").distinct().count()


def test_run(spark):
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.count() > 0 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


WORDS = "the old river ran past a quiet mill where seven people met every week to talk about the price of bread and salt and the weather of the coming year".split()


def odd(spark, rows):
    """Rows with the columns of documents, in several partitions."""
    like = spark.read.parquet(f"{DATA}/documents.parquet")
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], like.schema).select(*like.columns).repartition(3)


def passed(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_rows_without_or_with_equal_ids(spark):
    """Filters judge each row by its own text: a null id does not lose it, and a good row does not bring back a bad one of its id."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = corpus_pipeline.classify(spark, corpus_pipeline.language(spark, docs, DATA), DATA).first()["text"]
    extra = odd(spark, [(None, good), (-7, good), (-7, "%%%% 1234 !!!"), (-7, None)])
    for stage in (corpus_pipeline.language, corpus_pipeline.classify):
        after = stage(spark, docs.unionByName(extra), DATA).where("doc_id IS NULL OR doc_id = -7")
        assert passed(after) == sorted([(None, good), (-7, good)], key=str), stage.__name__


def test_one_row_of_each_group(spark):
    """The exact and near stages keep exactly one row of a group, whatever its ids."""
    text, spaced, other = " ".join(WORDS), "  ".join(WORDS), " ".join(reversed(WORDS))
    one_off = " ".join([*WORDS[:-1], "month"])
    repeated = [(1, text), (1, text), (2, text), (None, text), (None, other), (None, other), (3, "%"), (3, " %"), (3, " %"), (None, None), (None, "")]
    found = passed(corpus_pipeline.exact(spark, odd(spark, repeated), DATA))
    assert [x for x in found if x[1]] == sorted([(1, text), (None, other), (3, " %")], key=str) and len(found) == 4
    rows = [(5, text), (5, text), (4, one_off), (4, one_off), (4, other), (None, spaced), (None, "alone here"), (9, one_off)]
    assert passed(corpus_pipeline.near(spark, odd(spark, rows), DATA)) == sorted([(4, one_off), (4, other), (None, "alone here")], key=str)


def test_empty_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0, name


def test_columns_of_any_name(spark):
    """Columns named like the stages' own ones, or with dots and backticks, pass all stages with their values; a very long text is one row among others."""
    names = ["_key", "_row", "_text", "a.b", "c`d", "doc_id_2", "key", "component_id"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(odd(spark, [(-1, " ".join(WORDS * 4000))]))
    wide = docs.select("*", *[F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in names])
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, wide, DATA)
        if name == "packing":
            assert after.select("doc_id").distinct().count() == wide.count()
            break
        assert after.columns == wide.columns, name
        rows = after.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name
        assert len(rows) == stage(spark, docs, DATA).count(), name
