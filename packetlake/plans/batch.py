"""The batch pipeline: file -> packets -> sessions -> features -> predictions
-> alerts, one stored table per stage."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlake.functions.ordered import hashed_row_number
from packetlake.operators import alerts as alert_ops
from packetlake.operators import features as feature_ops
from packetlake.operators import labels as label_ops
from packetlake.operators import models as model_ops
from packetlake.operators import sessions as session_ops
from packetlake.operators.cleaning import check_packets, strict_gate
from packetlake.operators.ingest import PACKET_KEY, dedup_insert, ingestion_run_row
from packetlake.operators.retention import (
    RUN_DAYS,
    STAGING_DAYS,
    expired_runs,
    expired_staging_runs,
)
from packetlake.plans import membership
from packetlake.plans.keyed import MOST_COMMITS
from packetlake.plans.warehouse import Warehouse
from packetlake.schemas import (
    ALERTS_SCHEMA,
    FEATURE_COLS,
    FLAG_FEATURES,
    INGESTION_RUNS_SCHEMA,
    PACKETS_SCHEMA,
    PREDICTIONS_SCHEMA,
    SESSIONS_SCHEMA,
    attack_labels,
)
from packetlake.session import drop_stages, store_stage
from packetlake.sources.readers import read_packets

SESSION_KEY = ["flow_hash"]
FEATURE_KEY = ["session_id"]
PREDICTION_KEY = ["session_id", "model_version"]
ALERT_KEY = ["alert_id"]
KEYED = ("sessions", "session_features", "predictions", "alerts")

_FEATURE_TYPES = {"total_bytes": T.LongType(), "total_packets": T.LongType(),
                  "unique_dst_ports": T.IntegerType()}
FEATURES_SCHEMA = T.StructType(
    [T.StructField("session_id", T.LongType())]
    + [
        T.StructField(c, T.BooleanType() if c in FLAG_FEATURES
                      else _FEATURE_TYPES.get(c, T.DoubleType()))
        for c in FEATURE_COLS
    ]
    + [
        T.StructField("ground_truth_label_id", T.IntegerType()),
        T.StructField("computed_at", T.TimestampType()),
    ]
)
PACKET_TABLE_SCHEMA = T.StructType(
    PACKETS_SCHEMA.fields
    + [T.StructField("capture_date", T.DateType()), T.StructField("run_id", T.IntegerType())]
)
LINKS_SCHEMA = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("run_id", T.IntegerType()),
])


def _now() -> Column:
    """The time at which a job starts, the same in all its rows."""
    return F.lit(datetime.datetime.now(datetime.timezone.utc))


def _existing_keys(house: Warehouse, valid: DataFrame, run_id: int) -> DataFrame:
    """Keys of stored packets of other runs that the new rows may repeat.

    Other capture dates are pruned. Of runs with a stored filter only keys count
    that a new row may have by the filters; where there is none such, as in a
    file of new packets, these runs' packets are not read at all.
    """
    stored = house.read_runs("packets", PACKET_TABLE_SCHEMA).filter(F.col("run_id") != run_id)
    span = valid.agg(
        F.to_date(F.min("captured_at")).alias("low"), F.to_date(F.max("captured_at")).alias("high")
    ).first()
    if span.low is None:
        return stored.select(*PACKET_KEY).limit(0)
    stored = stored.filter(F.col("capture_date").between(span.low, span.high))
    filtered = [run for run in house.run_ids(membership.FILTERS) if run != run_id]
    plain = stored.filter(~F.col("run_id").isin(filtered)).select(*PACKET_KEY)
    if not filtered:
        return plain
    suspects = store_stage(membership.may_be_known(house, valid, "staged_id", run_id), "suspects")
    if suspects.isEmpty():
        return plain
    seen = stored.filter(F.col("run_id").isin(filtered)).select(*PACKET_KEY)
    return plain.unionByName(seen.join(suspects.select(*PACKET_KEY).distinct(), PACKET_KEY, "left_semi"))


def ingest(
    house: Warehouse, raw: DataFrame, run_id: int, source_name: str, source_path: str,
    strict: bool = False,
) -> DataFrame:
    """Clean, stage and insert one input; returns the run's audit row.

    Running the same ``run_id`` again replaces that run's rows. A failed run
    leaves a ``failed`` audit row; a strict run that is refused leaves none.
    """
    started = _now()
    numbered = raw.withColumn("staged_id", F.monotonically_increasing_id())
    received = house.receive_run("staging", check_packets(numbered, "staged_id"), run_id)
    if strict:
        try:
            strict_gate(received)
        except ValueError:
            house.refuse_run("staging", run_id)
            raise
    try:
        checked = house.accept_run("staging", run_id)
        # Without what only staging keeps: whole rows are shuffled twice.
        valid = checked.filter("is_valid").drop("is_valid", "validation_errors")
        # A filter of an earlier attempt no longer fits.
        house.remove(f"{membership.FILTERS}/run_id={run_id}")
        fresh = dedup_insert(valid, _existing_keys(house, valid, run_id), "staged_id")
        last_id = house.read_runs("packets", PACKET_TABLE_SCHEMA).filter(
            F.col("run_id") != run_id
        ).agg(F.coalesce(F.max("packet_id"), F.lit(0)).alias("m")).first().m
        inserted = (
            hashed_row_number(fresh, [], F.col("fingerprint"), "_rank")
            .withColumn("packet_id", (F.col("_rank") + last_id).cast("bigint"))
            .withColumn("session_id", F.lit(None).cast("bigint"))
            .select(*PACKETS_SCHEMA.fieldNames(), F.to_date("captured_at").alias("capture_date"))
        )
        house.write_run("packets", inserted, run_id, "capture_date")
        written = house.read_runs("packets", PACKET_TABLE_SCHEMA).filter(F.col("run_id") == run_id)
        membership.write_filter(house, written, run_id)
        audit = ingestion_run_row(
            checked, written, run_id, source_name, source_path, started, _now()
        )
        house.write_run("ingestion_runs", audit, run_id)
    except Exception as problem:
        none = received.limit(0)
        audit = ingestion_run_row(
            none, none, run_id, source_name, source_path, started, _now(), str(problem)[:2000]
        )
        house.write_run("ingestion_runs", audit, run_id)
        raise
    return ingestion_runs(house).filter(F.col("run_id") == run_id)


def ingest_file(house: Warehouse, path: str, run_id: int, strict: bool = False) -> DataFrame:
    return ingest(house, read_packets(house.spark, path), run_id, "file", path, strict)


def ingestion_runs(house: Warehouse) -> DataFrame:
    return house.read_runs("ingestion_runs", INGESTION_RUNS_SCHEMA)


def sessionize(house: Warehouse, idle_seconds: float = session_ops.IDLE_SECONDS) -> int:
    """Sessionize the runs that have no links yet; returns how many runs.

    Only those runs' packets are read. Links are stored per run instead of
    rewriting the packet table. A version of the sessions notes the runs it
    took in: where a job ended between sessions and links, the next one writes
    the links of those runs and does not add them again.
    """
    done, finished = set(house.run_ids("links")), 0
    for note in house.keyed("sessions").notes:
        # Commits of live batches have negative numbers and no packets of runs.
        unlinked = [run for run in note.runs if run >= 0]
        if not done.issuperset(unlinked):
            finished += len(set(unlinked) - done)
            _write_links(house, unlinked, idle_seconds)
            done |= set(unlinked)
    waiting = [r for r in house.run_ids("packets") if r not in done]
    if waiting:
        new = store_stage(
            session_ops.build_sessions(_packets_to_scan(house, waiting), idle_seconds), "new-sessions"
        )
        # Only the stored sessions that the new ones meet are read and written.
        changed = session_ops.upsert_sessions(
            house.matching("sessions", new, SESSIONS_SCHEMA), new, house.keyed("sessions").last_id
        )
        merge_changed(house, "sessions", SESSION_KEY, changed, "session_id", waiting)
        _write_links(house, waiting, idle_seconds)
    return finished + len(waiting)


def merge_changed(
    house: Warehouse, table: str, key: list[str], rows: DataFrame, id_column: str | None = None,
    runs: list[int] | None = None,
) -> DataFrame:
    """Commit changed rows; the note keeps the highest id, so that no later job
    looks for it."""
    stored = store_stage(rows, f"changed-{table}")
    last_id = stored.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0] if id_column else 0
    merged = house.merge(table, key, stored, runs, last_id)
    drop_stages(stored)
    return merged


def compact(house: Warehouse, most: int = MOST_COMMITS) -> dict[str, list[int]]:
    """Rewrite the buckets of the keyed tables that many jobs changed, and
    delete what no reader needs; returns the buckets by table. Predictions that
    wait for their alerts are raised first."""
    raise_alerts(house)
    done = {}
    for table in KEYED:
        if house.exists(f"{table}_commits"):
            stored = house.keyed(table)
            done[table] = stored.compact(most)
            stored.vacuum(keep=1)
    return done


def _packets_to_scan(house: Warehouse, runs: list[int]) -> DataFrame:
    packets = house.read_runs("packets", PACKET_TABLE_SCHEMA).filter(F.col("run_id").isin(runs))
    return session_ops.scan_unsessionized(packets)


def _write_links(house: Warehouse, runs: list[int], idle_seconds: float) -> None:
    """Links of runs that were sessionized together."""
    packets = house.read_runs("packets", PACKET_TABLE_SCHEMA).filter(F.col("run_id").isin(runs))
    assigned = store_stage(
        session_ops.packet_assignments(
            session_ops.assign_sessions(_packets_to_scan(house, runs), idle_seconds)
        ),
        "assigned",
    )
    linked = store_stage(
        session_ops.link_packets(
            packets.select("packet_id", "run_id", "session_id"), assigned,
            house.read("sessions", SESSIONS_SCHEMA),
        ),
        "links",
    )
    for run_id in runs:
        house.write_run("links", linked.filter(F.col("run_id") == run_id), run_id)


def linked_packets(house: Warehouse) -> DataFrame:
    """The packet table with session ids; null for packets of deleted sessions."""
    links = house.read_runs("links", LINKS_SCHEMA).select("packet_id", "run_id", "session_id")
    links = links.join(house.read("sessions", SESSIONS_SCHEMA).select("session_id"), "session_id", "left_semi")
    return house.read_runs("packets", PACKET_TABLE_SCHEMA).drop("session_id").join(
        links, ["packet_id", "run_id"], "left"
    )


def compute_features(house: Warehouse) -> DataFrame:
    """Features of sessions that have none, added to the feature table. Only
    runs that hold a packet of such a session are read."""
    features = house.read("session_features", FEATURES_SCHEMA)
    waiting = feature_ops.sessions_without_features(house.read("sessions"), features)
    links = store_stage(
        house.read_runs("links", LINKS_SCHEMA)
        .select("packet_id", "run_id", "session_id")
        .join(waiting.select("session_id"), "session_id", "left_semi"),
        "waiting-links",
    )
    runs = [row.run_id for row in links.select("run_id").distinct().collect()]
    packets = (
        house.read_runs("packets", PACKET_TABLE_SCHEMA)
        .filter(F.col("run_id").isin(runs))
        .drop("session_id")
        .join(links, ["packet_id", "run_id"])
    )
    kept = [
        "session_id", "captured_at", "src_ip", "dst_port", "packet_size", "tcp_flags",
    ]
    stored = store_stage(packets.select(*kept), "to-extract")
    new = feature_ops.extract_features(waiting, stored)
    known = house.matching("session_features", waiting, FEATURES_SCHEMA)
    return merge_changed(
        house, "session_features", FEATURE_KEY, feature_ops.upsert_features(known, new, _now())
    )


def load_labels(house: Warehouse, raw_labels: DataFrame) -> DataFrame:
    """Labels of the sessions in ``raw_labels``; other rows are not touched."""
    known = house.matching("session_features", raw_labels, FEATURES_SCHEMA)
    return merge_changed(
        house, "session_features", FEATURE_KEY,
        label_ops.apply_labels(known, raw_labels, attack_labels(house.spark)),
    )


def score(house: Warehouse, model: model_ops.DetectionModel) -> DataFrame:
    """Score what ``model`` has not scored, then raise the alerts that are
    due; returns the predictions table."""
    labels = attack_labels(house.spark)
    scored = house.read("predictions", PREDICTIONS_SCHEMA)
    new = store_stage(
        model_ops.batch_score(house.read("session_features"), scored, labels, model, _now()),
        "scored",
    )
    changed = model_ops.number_predictions(
        model_ops.upsert_predictions(house.matching("predictions", new, PREDICTIONS_SCHEMA), new),
        house.keyed("predictions").last_id,
    )
    merged = merge_changed(house, "predictions", PREDICTION_KEY, changed, "prediction_id")
    raise_alerts(house)
    return merged


def raise_alerts(house: Warehouse) -> DataFrame:
    """Alerts of the prediction commits that have none yet; returns the alerts.

    A commit of alerts notes the commits of predictions it took in. So a job
    that ended before the alerts leaves them to the next one, and only
    predictions that changed are read. A prediction keeps its alert: rescored
    ones that have one get no second.
    """
    predictions = house.keyed("predictions")
    taken = house.keyed("alerts").all_runs()
    # Compaction writes rows again that others wrote before.
    # Live batches raise their own.
    waiting = [
        n.commit for n in predictions.notes
        if n.commit not in taken and not n.rewritten and not any(run < 0 for run in n.runs)
    ]
    inserted = predictions.read_commits(waiting)
    if inserted is None:
        return house.read("alerts", ALERTS_SCHEMA)
    due = store_stage(
        alert_ops.alerts_from_predictions(inserted, attack_labels(house.spark), _now()), "due-alerts"
    )
    raised = house.read("alerts", ALERTS_SCHEMA).filter(
        F.col("rule_name") == alert_ops.PREDICTION_RULE
    )
    due = due.dropDuplicates(["prediction_id"]).join(
        raised.select("prediction_id"), "prediction_id", "left_anti"
    )
    digest = F.md5(F.col("prediction_id").cast("string"))
    numbered = (
        hashed_row_number(due, [], digest, "_rank")
        .withColumn("alert_id", (F.col("_rank") + house.keyed("alerts").last_id).cast("bigint"))
        .withColumn("acknowledged_at", F.lit(None).cast("timestamp"))
        .select(*ALERTS_SCHEMA.fieldNames())
    )
    return merge_changed(house, "alerts", ALERT_KEY, numbered, "alert_id", waiting)


def update_alerts(house: Warehouse, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Status updates of stored alerts; only these alerts are read and written."""
    known = house.matching("alerts", updates, ALERTS_SCHEMA)
    return merge_changed(house, "alerts", ALERT_KEY, alert_ops.update_alert_status(known, updates, _now(), order))


def delete_sessions(house: Warehouse, session_ids: DataFrame) -> None:
    """Delete sessions with their features, predictions and alerts; their
    packets stay, unlinked. Of each table only the rows that go are rewritten,
    as deletion marks; the table of links, which has no key, loses them when it
    is read (see ``linked_packets``)."""
    gone = store_stage(session_ids.select("session_id").distinct(), "gone-sessions")
    for table in ("alerts", "predictions", "session_features", "sessions"):
        if house.exists(f"{table}_commits"):
            stored = house.keyed(table)
            rows = stored.read()
            if rows is not None:
                stored.delete(rows.join(gone, "session_id", "left_semi").select(*stored.key))


def expire(house: Warehouse, now: Column, staging_days: int = STAGING_DAYS, run_days: int = RUN_DAYS) -> dict:
    """Drop staged rows of successful runs that finished ``staging_days`` ago,
    and runs with their staged rows after ``run_days``. Only the audit rows are
    read, one for each run; returns the dropped runs by table."""
    runs = ingestion_runs(house)
    old_runs = [r.run_id for r in expired_runs(runs, now, run_days).collect()]
    old_staging = [r.run_id for r in expired_staging_runs(runs, now, staging_days).collect()]
    staged = {
        int(name.removeprefix("run_id=")) for name in house.children("staging") if name.startswith("run_id=")
    }
    # Staged rows first: while the audit row is there, a job that ended here is repeated.
    return {
        "staging": house.drop_runs("staging", sorted(staged & {*old_staging, *old_runs})),
        "ingestion_runs": house.drop_runs("ingestion_runs", old_runs),
    }
