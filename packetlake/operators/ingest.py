"""Load cleaned packets into the packet table, with staging and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.columns import bounded_int, fingerprint
from packetlake.schemas import ALERT_STATUSES, RUN_STATUSES

PACKET_KEY = ["captured_at", "fingerprint"]


def stage_rows(checked: DataFrame, run_id: int) -> DataFrame:
    """Valid and rejected rows as they go to the staging table of a run."""
    return checked.select(F.lit(run_id).cast("bigint").alias("run_id"), "*")


def first_per_key(rows: DataFrame, order_col: str) -> DataFrame:
    """The row with the lowest ``order_col`` per packet key.

    An aggregate, not a window: copies collapse before the shuffle, so a
    packet that was received very often is one row per task.
    """
    others = [c for c in rows.columns if c not in PACKET_KEY]
    return (
        rows.groupBy(*PACKET_KEY)
        .agg(F.min_by(F.struct(*others), order_col).alias("_row"))
        .select(*PACKET_KEY, "_row.*")
        .select(*rows.columns)
    )


def dedup_insert(new: DataFrame, existing: DataFrame, order_col: str) -> DataFrame:
    """The rows of ``new`` that an insert adds: the first per packet key whose
    key is not in ``existing`` yet."""
    return first_per_key(new, order_col).join(
        existing.select(*PACKET_KEY), PACKET_KEY, "left_anti"
    )


def append_packets(rows: DataFrame, existing: DataFrame, row_id: str) -> DataFrame:
    """Row-level append: each row with its fingerprint, ``status`` (created,
    duplicate or invalid) and ``message`` for the invalid ones.

    Ports must be whole numbers but have no range check here.
    """
    required = ["captured_at", "src_ip", "dst_ip", "protocol", "packet_size"]
    missing = F.array_compact(
        F.array(*[F.when(F.col(name).isNull(), name) for name in required])
    )
    size = bounded_int(F.col("packet_size").cast("string"))
    port_bad = lambda name: (
        F.col(name).isNotNull() & bounded_int(F.col(name).cast("string")).isNull()
    )
    message = (
        F.when(F.size(missing) > 0, F.concat(
            F.lit("Missing required fields: "), F.array_join(missing, ", ")))
        .when(size.isNull(), "packet_size must be an integer")
        .when(size < 0, "packet_size must be >= 0")
        .when(port_bad("src_port"), "src_port must be an integer")
        .when(port_bad("dst_port"), "dst_port must be an integer")
    )
    checked = rows.withColumn("message", message)
    typed = checked.withColumns({
        "protocol": F.upper("protocol"),
        "packet_size": size,
        "src_port": bounded_int(F.col("src_port").cast("string")),
        "dst_port": bounded_int(F.col("dst_port").cast("string")),
    }).withColumn("fingerprint", F.when(F.col("message").isNull(), fingerprint()))
    # The first row per key wins. Its id, not the key, joins back, so rows
    # with a much-repeated key stay where they are.
    winners = (
        typed.filter(F.col("message").isNull())
        .groupBy(*PACKET_KEY)
        .agg(F.min(row_id).alias(row_id))
        .join(existing.select(*PACKET_KEY), PACKET_KEY, "left_anti")
        .select(row_id, F.lit(True).alias("_created"))
    )
    status = (
        F.when(F.col("message").isNotNull(), "invalid")
        .when(F.col("_created"), "created").otherwise("duplicate")
    )
    return (
        typed.join(winners, row_id, "left").withColumn("status", status).drop("_created")
    )


def delete_packets(packets: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining packets, one ``packet_id, status`` row per requested id)."""
    wanted = ids.select("packet_id").distinct()
    found = packets.select("packet_id", F.lit(True).alias("_found"))
    outcome = wanted.join(found, "packet_id", "left").select(
        "packet_id",
        F.when(F.col("_found"), "deleted").otherwise("not_found").alias("status"),
    )
    return packets.join(wanted, "packet_id", "left_anti"), outcome


def ingestion_run_row(
    checked: DataFrame,
    inserted: DataFrame,
    run_id: int,
    source_name: str,
    source_path: str,
    started_at: Column,
    finished_at: Column,
    error_message: str | None = None,
) -> DataFrame:
    """The audit row of one finished run."""
    spark_inserted = inserted.agg(F.count("*").alias("n")).scalar()
    return checked.agg(
        F.count("*").alias("rows_received"),
        F.count_if(~F.col("is_valid")).alias("rows_rejected"),
    ).select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(source_name).alias("source_name"),
        F.lit(source_path).alias("source_path"),
        started_at.alias("started_at"),
        finished_at.alias("finished_at"),
        "rows_received",
        spark_inserted.alias("rows_inserted"),
        "rows_rejected",
        F.lit("failed" if error_message else "success").alias("status"),
        F.lit(error_message).cast("string").alias("error_message"),
    )


def start_run(runs: DataFrame, source_name: str, source_path: str,
              rows_received: int, now: Column) -> DataFrame:
    """A one-row ``running`` entry with the next run id."""
    return runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("run_id")).select(
        "run_id",
        F.lit(source_name).alias("source_name"),
        F.lit(source_path).alias("source_path"),
        now.alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit(rows_received).cast("bigint").alias("rows_received"),
        F.lit(0).cast("bigint").alias("rows_inserted"),
        F.lit(0).cast("bigint").alias("rows_rejected"),
        F.lit("running").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def finish_run(runs: DataFrame, run_id: int, status: str, rows_inserted: int,
               rows_rejected: int, now: Column, error_message: str | None = None) -> DataFrame:
    """The audit table with one run closed."""
    if status not in RUN_STATUSES:
        raise ValueError(f"status must be one of {RUN_STATUSES}")
    this = F.col("run_id") == run_id
    values = {
        "finished_at": now,
        "rows_inserted": F.lit(rows_inserted).cast("bigint"),
        "rows_rejected": F.lit(rows_rejected).cast("bigint"),
        "status": F.lit(status),
        "error_message": F.lit(error_message).cast("string"),
    }
    return runs.withColumns(
        {name: F.when(this, value).otherwise(F.col(name)) for name, value in values.items()}
    )


def _counted(df: DataFrame, keys: list[str], broken: dict[str, Column]) -> DataFrame:
    """Rows per key and how many of them break each rule: all that the checks of
    a table look at, so its rows are read and shuffled once."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.count_if(rule).alias(name) for name, rule in broken.items()]
    )


def _totals(counted: DataFrame, totals: dict[str, Column]) -> DataFrame:
    one = counted.agg(*[
        F.coalesce(total, F.lit(0)).cast("bigint").alias(name) for name, total in totals.items()
    ])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in totals
    ])).alias("_found")).select("_found.*")


def _orphans(counted: DataFrame, rule: str, key: str, parent: DataFrame) -> DataFrame:
    # Rows per key first: a key with very many rows joins as one row.
    per_key = counted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("_n").alias("_n"))
    orphans = per_key.join(parent.select(key).distinct(), key, "left_anti")
    return _totals(orphans, {rule: F.sum("_n")})


def constraint_violations(
    packets: DataFrame, sessions: DataFrame, predictions: DataFrame,
    alerts: DataFrame, runs: DataFrame, labels: DataFrame,
) -> DataFrame:
    """Rows (or repeated keys) that break each rule of the table definitions."""
    repeated = F.count_if(F.col("_n") > 1)
    packet_keys = _counted(packets, PACKET_KEY, {"bad_size": F.col("packet_size") < 0})
    packet_sessions = _counted(packets, ["session_id"], {})
    flows = _counted(sessions, ["flow_hash"], {"bad_end": F.col("ended_at") < F.col("started_at")})
    scored = _counted(
        predictions, ["session_id", "model_version"], {"bad_confidence": ~F.col("confidence").between(0, 1)}
    )
    coded = _counted(labels, ["label_code"], {"bad_severity": ~F.col("severity").between(1, 5)})
    raised = _counted(alerts, ["session_id", "prediction_id"], {
        "bad_severity": ~F.col("severity").between(1, 5),
        "bad_status": ~F.col("status").isin(*ALERT_STATUSES),
    })
    audited = _counted(runs, ["status"], {"bad_status": ~F.col("status").isin(*RUN_STATUSES)})
    checks = [
        _totals(packet_keys, {"packet_size_not_negative": F.sum("bad_size"), "packet_key_unique": repeated}),
        _totals(scored, {"confidence_in_unit_range": F.sum("bad_confidence"), "prediction_unique": repeated}),
        _totals(coded, {"label_severity_1_to_5": F.sum("bad_severity"), "label_code_unique": repeated}),
        _totals(raised, {
            "alert_severity_1_to_5": F.sum("bad_severity"), "alert_status_known": F.sum("bad_status"),
        }),
        _totals(audited, {"run_status_known": F.sum("bad_status")}),
        _totals(flows, {"session_ends_after_start": F.sum("bad_end"), "flow_hash_unique": repeated}),
        _orphans(packet_sessions, "packet_session_exists", "session_id", sessions),
        _orphans(scored, "prediction_session_exists", "session_id", sessions),
        _orphans(raised, "alert_session_exists", "session_id", sessions),
        _orphans(raised, "alert_prediction_exists", "prediction_id", predictions),
    ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result
