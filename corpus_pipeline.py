"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read back for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import labelled, near_dup, packing, quality, queries, substring_dedup, toxicity
from helixlake.llm.store import complete, remove, scratch, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more for toxicity go.

    Null and empty texts score near 0 and stay; very long texts are scored whole; repeated rows are
    judged alike; without labels of both classes nothing goes; null ids are never learned from but
    scored; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(labelled.known(docs, labels, "toxic", labelled.remainder("doc_id", 5) != 0))
    return toxicity.score(docs.select(*COLUMNS), model, name="__score").where("__score < 0.5").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 for quality go.

    Null and empty texts score the bias; very long texts are scored whole; repeated rows are judged
    alike; without labels of both classes every score is 0.5 and nothing goes; null ids are never
    learned from but scored; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(labelled.sample(docs, labels, "quality", labelled.remainder("doc_id", 3) != 1, queries.PER_CLASS))
    return quality.score(docs.select(*COLUMNS), weights, name="__score").where("__score >= 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document with the smallest id stays.

    Null and empty texts are one group; a null id stays only where its whole group has null ids; of
    rows that share id and text one stays; an empty table stays empty.
    """
    return near_dup.keep_one(docs.select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that stand elsewhere too are cut out; other texts stay as they are.

    A null text becomes an empty one; a text all of which is repeated stays as an empty document;
    repeated rows are documents of their own, so both lose what they share; an empty table stays empty.
    """
    cut = substring_dedup.substring_dedup(docs.select(*COLUMNS), with_text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    Null and empty texts are the lone end id; repeated rows are packed one by one; an empty table
    gives no pieces.
    """
    return packing.pack(docs, queries.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("packing", pack),
]

#: No stage of it is expressible in SQL; tests/llm holds stages and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread.

    With ``folder``, a place in shared storage for one run over one input, a stage whose output is
    complete there is read instead of run again, so a failed run goes on where it stopped. What
    operators write on the way is removed with their stage; without ``folder`` so is each stage's
    output once the next stage has been written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = folder or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = f"{own}/{i}"
        if not complete(spark, out):
            with scratch(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
        if i and not folder:
            remove(spark, f"{own}/{i - 1}")
    return docs
