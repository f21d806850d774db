"""Corpus pipeline: quality rules, language, near duplicates, personal data,
packing. Each stage calls one operator and is stored before the next reads it."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.llm import language, packing, pii, quality, simhash, similar
from packetlake.llm.common import connected_components, read_table
from packetlake.session import apply_sql_defaults, drop_stages, store_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed and the certified rules. Null and empty
    texts fail; very long ones are measured whole; repeated rows are judged
    alike; an empty table stays empty; other columns are kept as they are."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Null and empty texts have none; ties go to the
    language declared most; rows without an id stay; very long texts are read
    whole; an empty table stays empty; other columns are kept as they are."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, whose links are those of
    SimHash fingerprints (op6's operator) and, which these mostly miss, those of
    similarity 0.8 or more on shingles of five words. The smallest id stays, and of repeated rows
    one; null texts are alike to wordless ones; rows without an id stay; very
    long texts are compared whole; an empty table stays empty; other columns are
    kept as they are."""
    found = simhash.near_duplicates(docs), similar.near_copies(docs)
    return simhash.keep_one(docs, merged_components(docs, *found))


def merged_components(docs: DataFrame, *members: DataFrame) -> DataFrame:
    """(doc_id, component_id) of the rows of ``docs``, linked if a table of
    ``members`` (doc_id, component_id) has them in one component. Rows without an
    id have no component."""
    links = [m.where("doc_id <> component_id").select(
        F.col("doc_id").alias("a"), F.col("component_id").alias("b")
    ) for m in members]
    found = connected_components(reduce(DataFrame.union, links).distinct())
    return docs.select(F.col("doc_id").cast("bigint")).join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. Null texts stay null;
    very long ones are masked whole; repeated rows are masked alike; an empty
    table stays empty; other columns are kept as they are."""
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens. A null text is an
    empty one; very long texts are cut freely, nothing is dropped; repeated rows
    are packed each; an empty table gives no pieces; other columns are left."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.piece_digests(packing.pack_documents(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

# Signatures need XXH64 and packing is sequential: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored as Parquet and read again. The
    table of a stage goes when the next one is stored."""
    apply_sql_defaults(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store_stage(stage(spark, docs, sf_dir), name)
        drop_stages(before)
    return STAGES[-1][1](spark, docs, sf_dir)
