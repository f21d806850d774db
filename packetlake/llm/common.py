"""Helpers that several operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.session import drop_stages, store_stage

# White space of the word pattern [^\x20\x09-\x0D]+.
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, the empty one for null."""
    return F.coalesce(F.col(column), F.lit(""))


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def worker_state(key: Any, build: Callable[[], Any]) -> Any:
    """``build()`` once per Python worker. A module of its own holds the values,
    as functions sent by value get fresh module globals for each task."""
    home = sys.modules.setdefault(
        "packetlake_worker_state", types.ModuleType("packetlake_worker_state")
    )
    values = home.__dict__.setdefault("values", {})
    if key not in values:
        values[key] = build()
    return values[key]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the undirected ``edges`` (a, b); the component is
    its smallest node. Alternating large-star and small-star steps until the
    edges are stars; each step is stored in the shared folder, so a lost
    executor costs one step, and deleted once the next one is. Loops and repeated edges do no harm, edges with a
    null end are left out.
    """
    pairs = (
        edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        .where("a IS NOT NULL AND b IS NOT NULL AND low < high")
        .distinct()
    )
    pairs, before = store_stage(pairs, "edges"), None
    while True:
        now = pairs.agg(
            F.count("*"),
            F.sum(F.xxhash64("low", "high").cast("decimal(20,0)")),
        ).first()
        if now == before:
            break
        before, last = now, pairs
        pairs = store_stage(_small_star(_large_star(last)), "edges")
        drop_stages(last)
    members = pairs.select(F.col("high").alias("node"), F.col("low").alias("component"))
    centres = pairs.select("low").distinct().select(
        F.col("low").alias("node"), F.col("low").alias("component")
    )
    found = members.unionByName(centres)
    found.stage_paths = pairs.stage_paths
    return found


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's smallest one."""
    both = pairs.select(F.col("low").alias("u"), F.col("high").alias("v")).union(
        pairs.select(F.col("high"), F.col("low"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    tied = both.where("v > u").join(least, "u")
    return tied.select(
        F.least("u", "m").alias("low"), F.col("v").alias("high")
    ).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is tied to the smallest."""
    least = pairs.groupBy("high").agg(F.min("low").alias("m"))
    tied = pairs.join(least, "high")
    return (
        tied.select(F.col("m").alias("low"), F.col("low").alias("high"))
        .union(least.select("m", "high"))
        .where("low < high")
        .distinct()
    )
