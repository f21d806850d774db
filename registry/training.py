"""Training-set queries."""

from pyspark.sql import functions as F

from packetlake.operators import training as T
from packetlake.schemas import FEATURE_COLS, FLAG_FEATURES
from registry.base import FEATURE_LIST, query, with_tables
from registry.features import FEATURE_OUT

FLOW_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_COLS)
FLOW_TEXT_SQL = """SELECT row_key, is_header,
  CASE WHEN is_header THEN 'Flow Duration' ELSE CAST(price * 100 AS VARCHAR) END AS duration_sec,
  CASE WHEN is_header THEN 'TotLen Fwd Pkts' ELSE CAST(qty * 40 AS VARCHAR) END AS fwd_bytes,
  CASE WHEN is_header THEN 'TotLen Bwd Pkts' ELSE CAST(CASE WHEN qty % 5 = 0 THEN 0 ELSE qty * 7 END AS VARCHAR) END AS bwd_bytes,
  CASE WHEN is_header THEN 'Tot Fwd Pkts' ELSE CAST(qty AS VARCHAR) END AS fwd_pkts,
  CASE WHEN is_header THEN 'Tot Bwd Pkts' ELSE CAST(qty % 9 AS VARCHAR) END AS bwd_pkts,
  CASE qty WHEN 13 THEN 'Infinity' WHEN 17 THEN 'NaN' ELSE CAST(price % 1000 AS VARCHAR) END AS bytes_per_sec,
  CASE qty WHEN 19 THEN '-Infinity' ELSE CAST(price % 100 AS VARCHAR) END AS packets_per_sec,
  CASE WHEN is_header THEN 'Flow IAT Mean' ELSE CAST(price % 11 AS VARCHAR) END AS iat_mean,
  CASE WHEN is_header THEN 'Flow IAT Std' ELSE CAST(price % 13 AS VARCHAR) END AS iat_std,
  CASE WHEN is_header THEN 'Flow IAT Min' ELSE CAST(price % 3 AS VARCHAR) END AS iat_min,
  CASE WHEN is_header THEN 'Flow IAT Max' ELSE CAST(price % 17 AS VARCHAR) END AS iat_max,
  CASE WHEN is_header THEN 'Pkt Size Avg' ELSE CAST(qty * 2 AS VARCHAR) END AS avg_packet_size,
  CASE WHEN is_header THEN 'Pkt Len Std' ELSE CAST(qty % 4 AS VARCHAR) END AS packet_size_std,
  CASE WHEN is_header THEN 'SYN Flag Cnt' ELSE CAST(qty % 2 AS VARCHAR) END AS has_syn,
  CASE WHEN is_header THEN 'FIN Flag Cnt' ELSE CAST(price % 2 AS VARCHAR) END AS has_fin,
  CASE WHEN is_header THEN 'RST Flag Cnt' ELSE CAST((qty + price) % 2 AS VARCHAR) END AS has_rst,
  CASE WHEN is_header THEN 'Dst Port' ELSE CAST(port AS VARCHAR) END AS unique_dst_ports,
  CASE WHEN is_header THEN 'Label' ELSE label END AS label_code
FROM flow_text"""
# The same as numbers; NaN is shown as -1.
FLOW_NUMBERS_SQL = "SELECT row_key, label_code, " + ", ".join(
    f"CASE WHEN {c} = 'NaN' THEN -1 ELSE try_cast({c} AS DOUBLE) END AS {c}"
    for c in T.FLOW_COLUMNS.values() if c != "label_code"
) + f" FROM ({FLOW_TEXT_SQL}) WHERE NOT is_header"
FLOW_DERIVED_SQL = f"""SELECT * REPLACE (duration_sec / 1e6 AS duration_sec), fwd_bytes + bwd_bytes AS total_bytes,
  fwd_pkts + bwd_pkts AS total_packets,
  round(fwd_bytes / CASE WHEN bwd_bytes = 0 THEN 1 ELSE bwd_bytes END, 6) AS fwd_bwd_byte_ratio,
  0.0::DOUBLE AS payload_entropy FROM ({FLOW_NUMBERS_SQL})"""
SPLIT_SQL = """SELECT session_id, label_code, CASE WHEN 100 * rn <= 70 * n THEN 'train' WHEN 100 * rn <= 85 * n
    THEN 'val' ELSE 'test' END AS split
  FROM (SELECT session_id, label_code, count(*) OVER (PARTITION BY label_code) AS n,
    row_number() OVER (PARTITION BY label_code ORDER BY md5(session_id || '|42')) AS rn
    FROM labeled JOIN attack_labels ON label_id = ground_truth_label_id)"""
NUM = {c: f"CAST(CAST({c} AS INTEGER) AS DOUBLE)" if c in FLAG_FEATURES else f"CAST({c} AS DOUBLE)"
       for c in FEATURE_COLS}
BASELINE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({NUM[c]}) AS mean, stddev_samp({NUM[c]}) AS std FROM {{rows}}"
    for c in FEATURE_COLS
)


def digest(name):
    return F.md5(F.col(name).cast("string"))


def train_rows(t):
    rows = T.stratified_split(T.export_labeled(t.labeled, t.labels), "session_id")
    return T.flags_to_int(rows.filter(F.col("split") == "train"))


def numbers(t):
    return T.coerce_numbers(T.flow_columns(t.flow_records, "row_key"))


def nan_shown(flows):
    return flows.withColumn(
        "bytes_per_sec", F.when(F.isnan("bytes_per_sec"), -1.0).otherwise(F.col("bytes_per_sec"))
    )


@query("flow_columns", with_tables("flow_text", f"SELECT * EXCLUDE (is_header) FROM ({FLOW_TEXT_SQL})"))
def _(t):
    return T.flow_columns(t.flow_records, "row_key")


@query("sample_per_file", with_tables("flow_text", """
SELECT row_key, source_file FROM flow_text
QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY md5(row_key)) <=
  CASE WHEN source_file = 'flows_o_1995.csv' THEN 2000 ELSE 1000 END"""))
def _(t):
    return T.sample_per_file(
        t.flow_records, "source_file", digest("row_key"), 1000, {"flows_o_1995.csv": 2000}
    ).select("row_key", "source_file")


@query("coerce_numbers", with_tables("flow_text", FLOW_NUMBERS_SQL))
def _(t):
    return nan_shown(numbers(t))


@query("derive_flow_features", with_tables("flow_text", FLOW_DERIVED_SQL))
def _(t):
    return nan_shown(T.derive_flow_features(numbers(t)))


@query("drop_unusable", with_tables("flow_text", f"""
SELECT * FROM ({FLOW_NUMBERS_SQL})
WHERE bytes_per_sec <> -1 AND isfinite(bytes_per_sec) AND isfinite(packets_per_sec)"""))
def _(t):
    return T.drop_unusable(numbers(t))


@query("process_flows", with_tables("flows", f"SELECT row_key, {FLOW_OUT}, label_code FROM flows"))
def _(t):
    return T.process_flows(t.flow_records, "row_key")


@query("drop_rare_classes", """
SELECT label_code, count(*) AS rows FROM (
  SELECT 'C' || CAST(floor(l_extendedprice / 15) AS BIGINT) AS label_code FROM lineitem)
GROUP BY label_code HAVING count(*) >= 10""")
def _(t):
    rows = t.table("lineitem").select(
        F.concat(F.lit("C"), F.floor(F.col("l_extendedprice") / 15).cast("string")).alias("label_code")
    )
    return T.drop_rare_classes(rows).groupBy("label_code").agg(F.count("*").alias("rows"))


@query("export_labeled", with_tables("labeled attack_labels", f"""
SELECT {FEATURE_OUT}, label_code FROM labeled JOIN attack_labels ON label_id = ground_truth_label_id"""))
def _(t):
    return T.training_export(t.labeled, t.labels).select("session_id", *FEATURE_COLS, "label_code")


@query("fallback_labels", with_tables("features", """
SELECT session_id, CASE WHEN payload_entropy > 0.8 THEN 'DOS' ELSE 'BENIGN' END AS label_code FROM features"""))
def _(t):
    bare = t.features.withColumn("ground_truth_label_id", F.lit(None).cast("int"))
    return T.training_export(bare, t.labels).select("session_id", "label_code")


@query("stratified_split", with_tables("labeled attack_labels", SPLIT_SQL))
def _(t):
    rows = T.export_labeled(t.labeled, t.labels)
    return T.stratified_split(rows, "session_id").select("session_id", "label_code", "split")


@query("flags_to_int", with_tables("features", """
SELECT session_id, CAST(has_syn AS INTEGER) AS has_syn, CAST(has_fin AS INTEGER) AS has_fin,
  CAST(has_rst AS INTEGER) AS has_rst FROM features"""))
def _(t):
    return T.flags_to_int(t.features).select("session_id", *FLAG_FEATURES)


@query("scale_features", with_tables("features labeled attack_labels", f""",
split AS ({SPLIT_SQL}),
fit AS (SELECT {", ".join(f"avg({NUM[c]}) AS m_{c}, coalesce(nullif(stddev_pop({NUM[c]}), 0), 1) AS s_{c}"
                          for c in FEATURE_COLS)}
  FROM labeled WHERE session_id IN (SELECT session_id FROM split WHERE split = 'train'))
SELECT session_id, {", ".join(f"round(({NUM[c]} - m_{c}) / s_{c}, 6) AS {c}" for c in FEATURE_COLS)}
FROM features, fit"""))
def _(t):
    scaler = T.fit_scaler(train_rows(t))
    return scaler.apply(T.flags_to_int(t.features))


@query("drift_baseline", with_tables("labeled attack_labels", f""",
split AS ({SPLIT_SQL}),
train AS (SELECT {FEATURE_LIST} FROM labeled WHERE session_id IN
  (SELECT session_id FROM split WHERE split = 'train')), b AS ({BASELINE_SQL.format(rows="train")})
SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM b"""))
def _(t):
    return T.drift_baseline(train_rows(t))


@query("drift_compare", with_tables("features sessions", f""",
base AS (SELECT f.* FROM features f JOIN sessions s USING (session_id) WHERE protocol = 'TCP'),
live AS (SELECT f.* FROM features f JOIN sessions s USING (session_id) WHERE protocol = 'UDP'),
b AS ({BASELINE_SQL.format(rows="base")}), l AS ({BASELINE_SQL.format(rows="live")})
SELECT feature, round(b.mean, 6) AS mean, round(b.std, 6) AS std, round(l.mean, 6) AS live_mean,
  round(l.std, 6) AS live_std,
  round(CASE WHEN b.std > 0 THEN (l.mean - b.mean) / b.std ELSE 0 END, 6) AS shift
FROM b JOIN l USING (feature)"""))
def _(t):
    of = lambda protocol: T.drift_baseline(t.features.join(
        t.sessions.filter(F.col("protocol") == protocol).select("session_id"), "session_id"
    ))
    return T.drift_compare(of("TCP"), of("UDP"))
