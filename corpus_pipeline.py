"""A corpus from raw documents to packed sequences; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import stored, table
from cellweave.llm.decontaminate import decontaminate
from cellweave.llm.exact_dedup import exact_dedup
from cellweave.llm.minhash_dedup import near_duplicates
from cellweave.llm.packing import pack
from cellweave.llm.queries import TOXIC, tokenizer
from cellweave.llm.toxicity import toxicity, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows not predicted toxic by a model fitted on the labelled rows among docs.

    Null and empty texts stay unless labels say that texts without words are toxic; repeated rows go or stay together; a
    null doc_id is no example; without labels, or with labels of one kind, that kind's prior decides. An empty table gives none.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model, TOXIC).filter("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (null is empty, A-Z as a-z) those with the largest doc_id: all rows that repeat it, and all rows of a group without any doc_id. An empty table gives none."""
    return exact_dedup(docs, keep="largest").filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the rows with the smallest doc_id. Rows without words or doc_id are in no group and stay. An empty table gives none."""
    kept = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold less than half of each benchmark item. Null and empty texts stay, repeated rows alike; an empty benchmark drops none. An empty table gives none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 ids; null and empty texts give their end id alone, repeated rows are packed each. An empty table gives none."""
    return pack(docs, tokenizer("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack_sequences)]

#: SQL has no counterpart of most stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs.drop("ids")
