"""Training-set preparation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.columns import MICROS
from packetlake.functions.ordered import hashed_row_number
from packetlake.operators.quality import one_row_to_long
from packetlake.schemas import BENIGN, FEATURE_COLS, FLAG_FEATURES

# Flow-export header -> column.
FLOW_COLUMNS = {
    "Flow Duration": "duration_sec",
    "TotLen Fwd Pkts": "fwd_bytes",
    "TotLen Bwd Pkts": "bwd_bytes",
    "Tot Fwd Pkts": "fwd_pkts",
    "Tot Bwd Pkts": "bwd_pkts",
    "Flow Byts/s": "bytes_per_sec",
    "Flow Pkts/s": "packets_per_sec",
    "Flow IAT Mean": "iat_mean",
    "Flow IAT Std": "iat_std",
    "Flow IAT Min": "iat_min",
    "Flow IAT Max": "iat_max",
    "Pkt Size Avg": "avg_packet_size",
    "Pkt Len Std": "packet_size_std",
    "SYN Flag Cnt": "has_syn",
    "FIN Flag Cnt": "has_fin",
    "RST Flag Cnt": "has_rst",
    "Dst Port": "unique_dst_ports",
    "Label": "label_code",
}
# Rows sampled per flow file.
SAMPLE_ROWS = 50_000
MIN_CLASS_ROWS = 10
SPLIT_SEED = 42
FALLBACK_ENTROPY = 0.8


def flow_columns(records: DataFrame, *extra: str) -> DataFrame:
    """The 18 mapped columns of a flow export under their own names."""
    return records.select(
        *extra, *[F.col(f"`{header}`").alias(name) for header, name in FLOW_COLUMNS.items()]
    )


def sample_per_file(
    records: DataFrame, file_col: str, row_digest: Column,
    rows: int = SAMPLE_ROWS, overrides: dict[str, int] | None = None,
) -> DataFrame:
    """Exactly ``rows`` rows of each larger file, chosen by a digest, so the
    choice repeats; smaller files are kept whole. ``overrides`` gives other
    numbers of rows for file names that end so."""
    overrides = overrides or {}
    most = max([rows, *overrides.values()])
    numbered = hashed_row_number(records, [file_col], row_digest, "_rank", at_most=most)
    limit = F.lit(rows)
    for name, special in overrides.items():
        limit = F.when(F.col(file_col).endswith(name), special).otherwise(limit)
    return numbered.filter(F.col("_rank") <= limit).drop("_rank")


def coerce_numbers(flows: DataFrame) -> DataFrame:
    """Numbers from text, other text as null; rows without a duration (such as
    repeated headers) are dropped."""
    names = [n for n in FLOW_COLUMNS.values() if n != "label_code"]
    return flows.withColumns(
        {n: F.col(n).try_cast("double") for n in names}
    ).dropna(subset=["duration_sec"])


def derive_flow_features(flows: DataFrame) -> DataFrame:
    """Totals, ratio and unit changes. Durations become seconds; inter-arrival
    columns keep the unit of the export."""
    backward = F.when(F.col("bwd_bytes") == 0, 1.0).otherwise(F.col("bwd_bytes"))
    return flows.withColumns({
        "duration_sec": F.col("duration_sec") / MICROS,
        "total_bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
        "total_packets": F.col("fwd_pkts") + F.col("bwd_pkts"),
        "fwd_bwd_byte_ratio": F.col("fwd_bytes") / backward,
        "payload_entropy": F.lit(0.0),
    })


def drop_unusable(flows: DataFrame) -> DataFrame:
    """Rows without null, NaN or infinite values.

    Zero times a finite number is 0, times anything else NaN or null: one
    mention per column, so the parsing behind it runs once per filter.
    """
    numbers = [F.col(n) * 0.0 for n, kind in flows.dtypes if kind == "double"]
    others = [n for n, kind in flows.dtypes if kind != "double"]
    return flows.dropna(subset=others).filter(reduce(add, numbers) == 0.0)


def to_training_columns(flows: DataFrame, *extra: str) -> DataFrame:
    return flows.select(
        *extra, *FEATURE_COLS, F.upper("label_code").alias("label_code")
    )


def process_flows(records: DataFrame, *extra: str) -> DataFrame:
    """Flow-export text rows to the 17 features and the label."""
    flows = derive_flow_features(coerce_numbers(flow_columns(records, *extra)))
    return to_training_columns(drop_unusable(flows), *extra)


def drop_rare_classes(rows: DataFrame, min_rows: int = MIN_CLASS_ROWS,
                      label: str = "label_code") -> DataFrame:
    """Rows whose label occurs at least ``min_rows`` times.

    The rare labels are the joined side: fewer rows than the common ones, and
    rows of a frequent label are not moved once AQE broadcasts them.
    """
    rare = rows.groupBy(label).agg(F.count("*").alias("_n")).filter(
        F.col("_n") < min_rows
    ).select(label)
    return rows.join(rare, label, "left_anti")


def export_labeled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled sessions with their features and label code."""
    codes = F.broadcast(labels.select("label_id", "label_code"))
    return features.join(
        codes, F.col("ground_truth_label_id") == F.col("label_id")
    ).select("session_id", *FEATURE_COLS, "label_code")


def fallback_labels(features: DataFrame) -> DataFrame:
    """Labels guessed from the entropy, for a table without any label."""
    guess = F.when(F.col("payload_entropy") > FALLBACK_ENTROPY, "DOS").otherwise(BENIGN)
    return features.select("session_id", *FEATURE_COLS, guess.alias("label_code"))


def training_export(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows, or guessed labels if no row has one."""
    labeled = export_labeled(features, labels)
    return fallback_labels(features) if labeled.isEmpty() else labeled


def stratified_split(rows: DataFrame, row_id: str, label: str = "label_code",
                     seed: int = SPLIT_SEED) -> DataFrame:
    """``split`` = train/val/test at 70/15/15 percent of every label.

    Rows are ranked per label by a digest of id and seed: exact and repeatable.
    """
    digest = F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed))))
    ranked = hashed_row_number(rows, [label], digest, "_rank", total="_size")
    place = 100 * F.col("_rank")
    split = (
        F.when(place <= 70 * F.col("_size"), "train")
        .when(place <= 85 * F.col("_size"), "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_rank", "_size")


def flags_to_int(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("int") for c in FLAG_FEATURES})


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a zero deviation scales by 1."""

    mean: dict[str, float]
    scale: dict[str, float]

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            c: (F.col(c).cast("double") - self.mean[c]) / self.scale[c] for c in self.mean
        })


def fit_scaler(train: DataFrame, columns: list[str] = FEATURE_COLS) -> Scaler:
    numbers = train.select(*[F.col(c).cast("double").alias(c) for c in columns])
    stats = numbers.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    ).first()
    return Scaler(
        {c: stats[f"mean_{c}"] or 0.0 for c in columns},
        {c: stats[f"std_{c}"] or 1.0 for c in columns},
    )


def drift_baseline(train: DataFrame) -> DataFrame:
    """(feature, mean, std) of the training rows, sample deviation."""
    numbers = train.select(*[
        F.col(c).cast("int" if c in FLAG_FEATURES else "double").cast("double").alias(c)
        for c in FEATURE_COLS
    ])
    means = numbers.agg(*[F.avg(c).alias(c) for c in FEATURE_COLS])
    stds = numbers.agg(*[F.stddev_samp(c).alias(c) for c in FEATURE_COLS])
    return one_row_to_long(means, FEATURE_COLS, "mean").join(
        one_row_to_long(stds, FEATURE_COLS, "std"), "feature"
    )


def drift_compare(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """Shift of the live mean per feature, in baseline deviations."""
    now = live.select("feature", F.col("mean").alias("live_mean"), F.col("std").alias("live_std"))
    shift = F.when(
        F.coalesce("std", F.lit(0.0)) > 0, (F.col("live_mean") - F.col("mean")) / F.col("std")
    ).otherwise(F.lit(0.0))
    return baseline.join(now, "feature").withColumn("shift", shift)
