"""A training corpus from raw documents: five stages, each written as a table and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns of documents.
Null texts: kept by the toxicity stage (nothing toxic in them), rejected by language ID (no letter). Repeated rows with one id: one stays after
near-duplicate removal for each of its different texts. Columns of any name are returned as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import decontam, langid, minhash, spm, toxicity
from textquarry.llm.common import crc_mod, set_aside, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from their labels outside the held-out fifth, scores at least 0.5 go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod("doc_id", 5) != 0)
    model = toxicity.learn(docs, labels)
    inside, back = set_aside(docs, toxicity.FOUND)
    return back(toxicity.score_texts(inside, model).filter(f"{toxicity.FOUND[1]} = 0"))


def reject_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose two best languages compress them equally well, go."""
    dictionaries = langid.learn(docs.filter(crc_mod("doc_id", 5) != 0))
    inside, back = set_aside(docs, langid.FOUND)
    return back(langid.classify(inside, dictionaries).filter(langid.FOUND[2]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge-dropout, and whether they decode to the text."""
    import public_tokenizers

    coded = spm.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), lossless="lossless")
    return coded.select("doc_id", "lang", "source", "ids", "n_ids", "lossless")


STAGES = [
    ("toxicity", reject_toxic),
    ("language_id", reject_unclear_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: No stage but the fourth can be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
