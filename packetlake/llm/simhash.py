"""SimHash fingerprints and near-duplicate components by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the radius differ,
in one segment at least, by no more than that segment's share, as the shares
add up to the radius minus the number of segments plus one. Each fingerprint is
stored under its segments; the small Hamming balls around its segments are
enumerated as probes; matches of a probe are verified by their whole distance
inside the join, so only links come out of it. Copies of a fingerprint are one
entry: a group of copies, however large, costs one probe set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.llm.common import connected_components, spare_names
from packetlake.session import store_stage

BITS = 64
SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
SEGMENTS = 3
# Shingles whose bits are added up at a time.
BLOCK = 1 << 16


def fingerprint_of(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The 64 bits as a signed number; zero without a word."""
    tokens = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(token) + 1 for token in tokens])
    starts = [0, *ends[:-words].tolist()] if len(tokens) > words else [0]
    stops = (ends[words - 1:] - 1).tolist() if len(tokens) >= words else [len(joined)]
    digest, n = xxhash.xxh64_digest, len(starts)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        packed = b"".join([
            digest(joined[a:b], SEED)
            for a, b in zip(starts[at:at + BLOCK], stops[at:at + BLOCK], strict=True)
        ])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint bigint) of each whole text. A null or wordless text
    has fingerprint zero; fewer words than a shingle are one shingle; repeated
    rows and null ids stay; other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                fingerprint_of((text.as_py() or "").encode("utf-8"), words)
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, fingerprint bigint"
    )


def segment_plan(radius: int = RADIUS, segments: int = SEGMENTS) -> list[tuple[int, int, int]]:
    """(lowest bit, width, share) of each segment. The shares add up to
    radius - segments + 1: with all shares exceeded, at least radius + 1 bits
    would differ."""
    total = max(0, radius - segments + 1)
    plan, low = [], 0
    for k in range(segments):
        width = BITS // segments + (k < BITS % segments)
        plan.append((low, width, total // segments + (k < total % segments)))
        low += width
    return plan


def _key(segment: int, low: int, width: int):
    part = F.shiftrightunsigned("fingerprint", low).bitwiseAND((1 << width) - 1)
    return part.bitwiseXOR(F.lit(segment << 56))


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints within the radius."""
    plan = segment_plan(radius, segments)
    stored = [_key(k, low, width) for k, (low, width, _) in enumerate(plan)]
    probes = [
        _key(k, low, width).bitwiseXOR(F.lit(sum(1 << bit for bit in flips)))
        for k, (low, width, share) in enumerate(plan)
        for size in range(share + 1)
        for flips in combinations(range(width), size)
    ]
    table = distinct.select(F.explode(F.array(*stored)).alias("key"), F.col("fingerprint").alias("b"))
    asked = distinct.select(F.explode(F.array(*probes)).alias("key"), F.col("fingerprint").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return (
        asked.join(table, (asked["key"] == table["key"]) & (F.col("a") < F.col("b")) & near)
        .select("a", "b")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, segments: int = SEGMENTS
) -> DataFrame:
    """(doc_id, fingerprint bigint, component_id) for every document: the
    component is the smallest doc_id reachable over links within the radius;
    it is null where every document of a component has a null id. Wordless
    documents share fingerprint zero and are linked like any others. Texts of
    any length are read whole; an empty table gives no rows.
    """
    marked = store_stage(fingerprints(docs, words), "fingerprints")
    classes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    found = connected_components(links(classes.select("fingerprint"), radius, segments))
    labelled = classes.join(
        found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("component", F.coalesce("component", "fingerprint"))
    labelled = store_stage(labelled, "classes")
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(least, "component").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One document of each component of ``members`` (see ``near_duplicates``),
    the one of smallest id, with all columns of ``docs``. Of repeated rows (same
    id and text) one stays. Rows without an id stay, as nothing can name them.
    Columns of ``docs`` may have any names; an empty table gives no rows."""
    kept_id, rows = spare_names(docs, "kept_id", "rows")
    kept = (
        members.where("doc_id = component_id")
        .groupBy(F.col("doc_id").alias(kept_id))
        .agg(F.count("*").alias(rows))
    )
    chosen = docs.join(kept, F.col("doc_id") == F.col(kept_id))
    single = chosen.where(F.col(rows) == 1).select(docs.columns)
    again = chosen.where(F.col(rows) > 1).dropDuplicates(["doc_id", "text"]).select(docs.columns)
    nameless = docs.where("doc_id IS NULL")
    return single.unionByName(again).unionByName(nameless)
