"""A training-corpus pipeline over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder of ``spark.checkpoint.dir`` and hands the
table read back to the next stage. All but the last return the columns of
``documents``; the last returns the encoded and decoded rows.

Empty tables pass through every stage; null ids, texts, languages and sources
are handled as the operators' docstrings say; extra columns are kept up to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, common, exact_dedup, mixing, simhash_dedup, toxicity
from quire.llm.queries import tokenizer_content


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score at or above the threshold
    of their language) go."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    return toxicity.score(scored, model, "_text", "_lang").where("not rejected").select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints stays."""
    return simhash_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the decoded text."""
    content = tokenizer_content()
    # written, so that no task holds both an encoding and a decoding worker
    ids = common.written(bpe.encode(docs.select("doc_id", "text", "lang", "source"), content), "pipeline-ids")
    return bpe.decode(ids, content).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies),
          ("source mixing", mix_sources), ("BPE", encode)]

#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
