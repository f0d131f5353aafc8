"""Cleaning and packing of a corpus, stage by stage.

Every stage reads what the one before it wrote, works on all of it, and returns
the columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.llm import common, jaccard, language, packing, queries, secrets, toxicity
from hemline.session import materialize

#: Share of the held-out, rightly predicted documents that the language stage may reject; their scores set its threshold.
REJECTED_LANGUAGES = 0.002


def toxic_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents scored below the toxicity threshold, learned from the labels of those given."""
    common.prepare(spark)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = docs.columns
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    # a name that the table may have itself is set aside
    packed = docs.select(F.struct(*kept).alias("row"), "text")
    scored = toxicity.score(packed, model).where(F.col("score") < toxicity.THRESHOLD)
    return scored.select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a letter whose language is predicted as surely as that of held-out ones."""
    common.prepare(spark)
    net = language.fit(docs.select("doc_id", "text", "lang"))
    least = language.least_score(docs, net, REJECTED_LANGUAGES)
    found = language.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), net)
    if net is not None:
        found = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= least))
    return found.select("row.*")


def one_of_each_class(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies."""
    common.prepare(spark)
    return jaccard.one_of_each(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.masked(secrets.scan(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    common.prepare(spark)
    return packing.report(docs.select("doc_id", "text"), queries.tokenizer_path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents),
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_class),
    ("secret_scans", masked_secrets),
    ("best_fit_packing", packed_sequences),
]

#: No SQL: models are trained in two stages, and packing is a heuristic.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
