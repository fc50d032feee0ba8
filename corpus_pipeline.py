"""The corpus pipeline: five stages from documents to tokens, each written as Parquet and read again as the next one's input.

1. toxicity: documents predicted toxic go; the classifier learns from the labels of the documents at hand.
2. exact dedup: of equal texts one row stays.
3. MinHash near-dedup: of each component of near-duplicates one document stays.
4. benchmark decontamination: documents with a window of a benchmark item go.
5. SentencePiece: each document left as token ids, with the text decoded from them, and the digests of both.

Stages 1 to 4 return the columns of documents, also further ones than the given tables have. Rows that repeat an id and a text are copies of
which the exact dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heldout.llm.catalog import piece_model
from heldout.llm.decontaminate import decontaminate
from heldout.llm.exact_dedup import keep_exact
from heldout.llm.minhash_dedup import keep_first
from heldout.llm.registry import query, table
from heldout.llm.sentencepiece_codec import digests, encode
from heldout.llm.toxicity import reject_toxic
from heldout.plans.storage import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(encode(docs.select("doc_id", "text"), piece_model(), decoded="decoded", share=0.4).drop("text"), keep=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", tokens),
]
# The classifier and the tokens are not SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the tables between them go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
