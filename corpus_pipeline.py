"""The corpus pipeline: language ID, toxicity, near duplicates, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and works on all rows that the stage before
it kept. All but the last return these columns, extra ones included; rows travel inside a struct meanwhile, so extra
columns may have any name. Null texts have no language and go in the first stage; repeated rows are copies, of which
one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, langid, mixing, simhash, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def held(docs: DataFrame) -> DataFrame:
    """docs as one struct column, doc."""
    return docs.select(F.struct("*").alias("doc"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages that the labelled ones are in; those without a letter (und) and those
    that fit no language twice as well as the others together go."""
    model = langid.fit(docs.where(langid.may_learn()))
    told = held(docs).withColumn("got", langid.language(F.col("doc.text"), model, spark))
    return told.where((F.col("got.lang") != "und") & (F.col("got.score") >= 2 / 3)).select("doc.*")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity is below one half."""
    model = toxicity.learn(spark, sf_dir, docs)
    return held(docs).where(toxicity.toxicity(F.col("doc.text"), model, spark)["score"] < 0.5).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each near-duplicate group, one row of it if rows repeat; a group without
    any doc_id keeps one row."""
    return simhash.one_of_each(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix(docs)
    return mixed.where("copies > 0").select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, token_ids and a digest of the decoded bytes of each document."""
    ids = docs.select("doc_id", "source", "lang", bpe.encoded(F.col("text")).alias("token_ids"))
    return ids.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(bpe.decoded(F.col("token_ids")), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("mixing", target_weights),
    ("encoding", encoded),
]

#: Language ID, toxicity and near duplicates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
