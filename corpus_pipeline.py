"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of documents; where a text changes, n_chars follows it.

Defined cases, in every stage: null and empty texts are rows like others (they are never toxic, are copies of each other, lose no words,
hold no secrets, and have a row without a bin in the end). Very long texts are taken whole. Rows that repeat are one group of copies;
of equal ids in one group, the row with the least hash of id and text stays. Columns that documents doesn't have pass through, whatever they
are called. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bin_packing, passages, secret_grammar, shingle_join, toxicity_fst
from marginalia.llm.common import materialize, read
from marginalia.llm.entries import tokenizer

#: Width of the shingles of near duplicates; texts whose shingle sets have a Jaccard similarity of 0.8 or more are near.
SHINGLE_WORDS = 5
#: Bits of 64 in which the SimHash fingerprints of a group of near texts may differ from one to the next, in the first of the stage's steps.
NEAR_BITS = 2
#: Runs of so many words that start in more than one place are repeated passages.
PASSAGE_WORDS = 51


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model is learnt from the labelled rows of docs that aren't held out."""
    model = toxicity_fst.train(docs, read(spark, sf_dir, "labels"))
    return docs.filter(toxicity_fst.score_column(model, "text") < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, one of its copies if it is repeated. SimHash
    groups come first; similarity decides, and completes them to every pair at 0.8 or more."""
    return shingle_join.keep_one(docs, SHINGLE_WORDS, NEAR_BITS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a run of 51 that also starts elsewhere go from every text. Texts that lost all their words stay."""
    return _measured(passages.remove_passages(docs, PASSAGE_WORDS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _measured(secret_grammar.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per training sequence: its length, its token ids, and which pieces of which documents they are."""
    return bin_packing.pack_bins(docs, tokens=tokenizer(), keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packing),
]

#: The stages learn a classifier, hash fingerprints and infer automata, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
