"""Ground-truth labels: normalisation, assignment and class statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.functions.columns import strip
from packetlake.schemas import ATTACK_LABELS, BENIGN

# External label text -> label code.
LABEL_CODES = {
    "benign": "BENIGN",
    "normal": "BENIGN",
    "dos": "DOS",
    "ddos": "DOS",
    "dos hulk": "DOS",
    "dos goldeneye": "DOS",
    "dos slowloris": "DOS",
    "dos slowhttptest": "DOS",
    "heartbleed": "DOS",
    "portscan": "PROBE",
    "port scan": "PROBE",
    "probe": "PROBE",
    "infiltration": "R2L",
    "r2l": "R2L",
    "web attack": "R2L",
    "web attack – brute force": "R2L",
    "web attack – xss": "R2L",
    "web attack – sql injection": "R2L",
    "ftp-patator": "R2L",
    "ssh-patator": "R2L",
    "bot": "R2L",
    "u2r": "U2R",
}


def normalize_label(raw: Column) -> Column:
    """Label code of external text; unknown, empty or null text is BENIGN."""
    text = F.lower(strip(raw))
    codes = F.create_map(*[F.lit(part) for pair in LABEL_CODES.items() for part in pair])
    own = F.upper(text)
    known = [code for _, code, _, _ in ATTACK_LABELS]
    return F.coalesce(codes[text], F.when(own.isin(known), own), F.lit(BENIGN))


def label_ids(coded: DataFrame, labels: DataFrame, code: str = "label_code") -> DataFrame:
    """``coded`` with label_id, null where the dimension lacks the code.

    The dimension is the five-row label table, so it is broadcast.
    """
    dimension = labels.select(F.col("label_code").alias("_code"), "label_id")
    return coded.join(
        F.broadcast(dimension), F.col(code) == F.col("_code"), "left"
    ).drop("_code")


def _last_label(raw_labels: DataFrame, labels: DataFrame) -> DataFrame:
    coded = raw_labels.select(
        "session_id", "row_no", normalize_label(F.col("label")).alias("label_code")
    )
    return (
        label_ids(coded, labels)
        .filter(F.col("label_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.max_by("label_id", "row_no").alias("_label_id"),
            F.count("*").alias("_rows"),
        )
    )


def apply_labels(features: DataFrame, raw_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with the label of the last raw row per session (by ``row_no``);
    sessions without a raw row keep what they had."""
    return (
        features.join(_last_label(raw_labels, labels), "session_id", "left")
        .withColumn(
            "ground_truth_label_id", F.coalesce("_label_id", "ground_truth_label_id")
        )
        .select(*features.columns)
    )


def label_load_stats(
    features: DataFrame, raw_labels: DataFrame, labels: DataFrame
) -> DataFrame:
    """One row: raw rows that updated a session and rows that were skipped."""
    per_session = raw_labels.groupBy("session_id").agg(F.count("*").alias("_all"))
    usable = _last_label(raw_labels, labels).select("session_id", "_rows")
    joined = (
        per_session.join(usable, "session_id", "left")
        .join(features.select("session_id", F.lit(True).alias("_hit")), "session_id", "left")
    )
    updated = F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_rows"))), F.lit(0))
    return joined.agg(
        updated.alias("updated"),
        (F.coalesce(F.sum("_all"), F.lit(0)) - updated).alias("skipped"),
    )


def class_distribution(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled sessions per code with their percentage, largest first."""
    counts = (
        features.groupBy("ground_truth_label_id")
        .agg(F.count("*").alias("sessions"))
        .join(
            F.broadcast(labels), F.col("ground_truth_label_id") == F.col("label_id")
        )
        .select("label_code", "sessions")
    )
    # At most one row per label of the dimension reaches this window.
    share = F.col("sessions") / F.sum("sessions").over(W.partitionBy()) * 100
    return counts.withColumn("percent", share).orderBy(F.desc("sessions"), "label_code")


def imbalance_ratio(distribution: DataFrame) -> DataFrame:
    """Largest class over smallest; null below two classes."""
    return distribution.agg(
        F.when(
            F.count("*") >= 2,
            F.max("sessions") / F.greatest(F.min("sessions"), F.lit(1)),
        ).alias("imbalance_ratio")
    )
