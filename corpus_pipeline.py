"""From raw documents to packed batches: quality, language, near duplicates, privacy, packing.

Defined cases, for every stage: null and empty texts, and those without letters, are rejected by the first two stages; repeated
rows are judged alike, and near_duplicates leaves one of them; ties go to the smaller id; very long texts are read whole; an empty
table gives an empty result; columns beside doc_id, text and lang are handed on untouched, but for the names that a
stage's operator gives its verdict (perplexity, kept, lang_pred, score, accepted), which must not come in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import jaccard, langid, packing, privacy, quality_kn
from parlance.llm.common import remove, shared_dir
from parlance.llm.queries import PSEUDONYM_KEY, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's limit."""
    model = quality_kn.train(docs, table(spark, sf_dir, "labels"))
    return quality_kn.classify(docs, model).where("kept").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those that no language explains go."""
    return langid.identify(docs, langid.train(docs), keep_text=True).where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Repeated rows leave one; rows without id stay."""
    linked = jaccard.link(docs, k=5, num=80, den=100)
    first = linked.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return privacy.pseudonymise(docs, key=PSEUDONYM_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces in token-budget batches."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("private", private), ("packed", packed)]

#: The models of the first stages have no SQL. Tests hold each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again. Each stage's input goes when its output is there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
