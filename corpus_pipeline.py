"""The training-data pipeline over documents: toxic documents go, shared lines go, one of each group of near copies stays, sources are mixed, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import free_name
from tessera.llm.bpe import bpe_decode, bpe_encode
from tessera.llm.common import Scratch
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mixed_documents
from tessera.llm.ngram_join import near_duplicates_removed
from tessera.llm.toxicity import toxicity, train_toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = free_name("toxicity", docs.columns)
    return toxicity(docs, model, own).where(F.col(own) < 0.5).select(*[f"`{c}`" for c in docs.columns])


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other columns travel packed, so that none can clash with the operator's own; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = line_dedup(docs.select("doc_id", "text", F.struct(F.lit(0), *[f"`{c}`" for c in others]).alias("rest")), keep=["rest"])
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return kept.select(*[(new[c] if c in new else F.col("rest")[c]).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates_removed(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to; one row for each copy of a document."""
    found = bpe_decode(bpe_encode(docs))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_shared_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("source mixing", mixed),
    ("BPE", encoded),
]
#: Compression lengths can't be had in SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes once the next one is written; the one that the result is made of stays."""
    docs, own, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for _, stage in STAGES[:-1]:
        docs = own.stored(stage(spark, docs, sf_dir))
        if before is not None:
            own.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
