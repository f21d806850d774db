"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.llm import (
    backtrack, bpe, html, language, licenses, packing, pii, quality, repair, sharding, simhash, topk,
    whitening,
)
from packetlake.llm.common import read_table
from packetlake.llm.oracles import ORACLES  # noqa: F401
from packetlake.session import apply_sql_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        apply_sql_defaults(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(read_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs, pages = read_table(spark, folder, "documents"), read_table(spark, folder, "pages")
    return language.identify(language.all_rows(docs, pages))


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = read_table(spark, folder, "documents")
    return packing.piece_digests(packing.pack_documents(docs, path, public_tokenizers.PATTERN))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(
        read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    )


@query
def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_text(read_table(spark, folder, "pages"))


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.span_digests(pii.find_spans(read_table(spark, folder, "documents")))


@query
def op8_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(read_table(spark, folder, "embeddings"))


@query
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return licenses.scan_licenses(docs, licenses.known_digests(spark))


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.assign_shards(read_table(spark, folder, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return backtrack.round_trip(read_table(spark, folder, "documents"), path)


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"))


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damage(read_table(spark, folder, "conversations")))
