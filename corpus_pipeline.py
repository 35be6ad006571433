"""From raw documents to packed sequences: language, quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) with the columns of documents and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes each stage's rows as Parquet in the shared folder and reads them
again, so a lost executor never makes a stage start over.

Stages decide about rows, not ids: a row without an id is a document of its own, rows that repeat an id are judged each by
its own text, and of rows that repeat id and text (or have copies) exactly one passes the exact and near stages.  Other columns pass as they
are, with any names: whole rows are handed on as one column, so names that operators use inside do not clash.

Results for unusual rows, by stage: language rejects null and empty texts and texts without a letter; so does quality with null and empty ones.
Exact keeps one row of all texts without any character but white space, near keeps every row without words.  Packing gives a null text one piece.
An empty table passes every stage as an empty table.  Of rows with equal preference (repeated ids, all ids null) the one whose columns have
the smaller digest stays; very long texts are judged whole.

What language rejects: undetermined texts, and mixtures in which no language has half of the words.  A share is relative to the languages that were
learned, so a text in another language is taken for the nearest one and stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oxidara.llm import exact_dedup, language_id, ngram_join, packing, quality
from oxidara.llm.rows import limit_batches, shared_folder

#: A document stays if its language is known and makes up at least this share of it.
LEAST_SHARE = 0.5


#: Names of the columns that the stages work on.  The columns of documents, whatever their names, are fields of ROW meanwhile.
KEY, ROW, ID, TEXT = "_key", "_row", "_id", "_text"


def _named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def _carried(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, which operators hand on as if it were the id, and the text."""
    return docs.select(F.struct(*map(_named, docs.columns)).alias(ROW), F.col("text").alias(TEXT))


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows with their text and the KEY of each: made of its content alone, so rows have one key only if all their columns are equal.

    The first bytes order rows by id, those without one last; then come 128 bits of SHA-256 over all columns."""
    number = F.col("doc_id").cast("bigint")
    by_id = F.concat(F.when(number.isNull(), "01").otherwise("00"), F.lpad(F.hex(F.coalesce(number, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    cells = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (_named(c).cast("string") for c in docs.columns)]
    key = F.unhex(F.concat(by_id, F.substring(F.sha2(F.concat(*cells), 256), 1, 32)))
    return docs.select(key.alias(KEY), F.struct(*map(_named, docs.columns)).alias(ROW), F.col("doc_id").alias(ID), F.col("text").alias(TEXT))


def _take(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of each key in keys, with the columns of documents.

    Equal rows are combined in each task before they are shuffled; the join then has them where they are."""
    once = keyed.groupBy(KEY).agg(F.first(ROW).alias(ROW))
    return once.join(keys.select(KEY), KEY, "left_semi").select(f"{ROW}.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language that dominates them: each row by its own text, with any id or none."""
    found = language_id.predict(_carried(docs), language_id.fit(docs), ROW, TEXT)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select("doc_id.*")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier takes for good: each row by its own text, with any id or none."""
    return quality.score(_carried(docs), quality.fit(docs), ROW, TEXT).where("predicted = 1").select("doc_id.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts, also if rows repeat an id or have none."""
    keyed = _keyed(docs)
    return _take(keyed, exact_dedup.survivors(keyed, KEY, ID, TEXT))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of near copies; one row, also if rows repeat an id or have none."""
    keyed = _keyed(docs)
    return _take(keyed, ngram_join.ngram_join(keyed, id_col=KEY, text_col=TEXT).where("doc_id = component_id").select(F.col("doc_id").alias(KEY)).distinct())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _limited(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(limit_batches(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("language", _limited(language)),
    ("quality", _limited(classify)),
    ("exact_dedup", _limited(exact)),
    ("ngram_join", _limited(near)),
    ("packing", _limited(pack)),
]

#: Language, quality and token ids are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
