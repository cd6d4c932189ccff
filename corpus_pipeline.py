"""From raw documents to packed sequences: five stages, each of which works on all that the one before kept.

Stages take ``(spark, docs, sf_dir)`` and return a table; all but the last return the columns of
``docs``. Between stages the table is written as Parquet and read again.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm import language_id, line_dedup, minhash_dedup, packing, toxicity
from reachlake.llm.spread import only_ids
from reachlake.llm.textvec import held_out
from reachlake.session import written, written_with_count

# A document whose likeliest language has a lower mean probability is rejected.
LEAST_LANGUAGE_SCORE = 0.4


def _judged(judge, docs: DataFrame, model, keep) -> DataFrame:
    """Rows of ``docs`` whose verdict columns meet ``keep``; columns travel under names that can't clash."""
    hidden = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    out = judge(docs, model, id_col="doc_id", text_col="text", keep=hidden)
    return out.where(keep).select(*[F.col(h).alias(c) for h, c in hidden.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language can't be told.

    Learns from the texts and non-null languages of the stage's own input, without the held-out rows.
    """
    rows = docs.where(~held_out(F.col("doc_id"), 4, 2)).select(F.col("doc_id").alias("id"), "text", "lang")
    model = language_id.train(rows)
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return _judged(language_id.identify, docs, model, known)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns from the labelled documents of the stage's own input."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(toxicity.score_texts, docs, model, F.col("predicted") == 0)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes lines aligned with an earlier document; a document of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs, "doc_id", "text")
    out = out.where(F.col("_removed").isNull() | F.col("text").rlike(r"\S"))
    changed = F.when(F.col("_removed").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    groups = minhash_dedup.near_duplicates(docs.select(key.alias("doc_key"), "text"), "doc_key", "text")
    gone, n = written_with_count(groups.where("not kept").select("doc_key").distinct(), "near-duplicates")
    return only_ids(docs.withColumn("doc_key", key), gone, "doc_key", n, inside=False).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of token ids in sequences of 2048."""
    return packing.pack_documents(docs, packing.default_vocabulary(), columns={"ids_crc32": ("long", zlib.crc32)})


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

# The networks, the alignment and the packing have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
