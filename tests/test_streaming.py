import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from helpers import packet, packets
from packetlake import schemas
from packetlake.operators import sessions as S
from packetlake.operators.features import extract_features
from packetlake.schemas import FEATURE_COLS
from packetlake.sources import streams as src
from packetlake.streaming import sessions as XS
from packetlake.streaming import trends as XT


class Replay:
    """A message folder that can be fed and drained step by step."""

    def __init__(self, spark, folder, transform):
        self.spark, self.folder, self.transform = spark, folder, transform
        (folder / "in").mkdir()
        self.batch = 0

    def feed(self, rows):
        frame = src.packet_messages(packets(self.spark, rows))
        self.feed_text([r.value for r in frame.collect()])

    def feed_text(self, lines):
        self.batch += 1
        (self.folder / "in" / f"{self.batch:03d}.json").write_text("\n".join(lines) + "\n")

    def drain(self):
        stream = self.transform(src.read_packet_stream(self.spark, str(self.folder / "in")))
        query = (
            stream.writeStream.format("parquet").option("path", str(self.folder / "out"))
            .option("checkpointLocation", str(self.folder / "ckpt"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return self.spark.read.schema(stream.schema).parquet(str(self.folder / "out"))


FAR = packet(999, 100_000, src="192.0.2.1", dst="192.0.2.2", protocol="ICMP")


def test_messages_round_trip_and_bad_ones_are_dropped(spark, tmp_path):
    replay = Replay(spark, tmp_path, lambda s: s)
    replay.feed([packet(1, 0.25, sport=None, flags="SYN")])
    replay.feed_text(["not json", json.dumps({"packet_id": "x"}), "[1]"])
    (row,) = replay.drain().collect()
    assert tuple(row) == packet(1, 0.25, sport=None, flags="SYN")


def far(k):
    return packet(900 + k, 100_000 + 100 * k, src="192.0.2.1", dst="192.0.2.2", protocol="ICMP")


def test_state_is_kept_across_batches(spark, tmp_path):
    replay = Replay(spark, tmp_path, XS.online_sessions)
    replay.feed([packet(1, 0, size=100), packet(2, 4, size=50)])
    assert replay.drain().count() == 0
    replay.feed([packet(3, 8, "10.0.0.2", "10.0.0.1", 443, 12345, size=10)])
    assert replay.drain().count() == 0
    replay.feed([packet(4, 13.5, size=1)])  # 5.5 s later: another session
    replay.feed([packet(5, 14, flags="FIN,ACK", size=2), packet(6, 14.2, size=7)])
    assert replay.drain().count() == 0  # earlier packets may still come
    replay.feed([packet(7, 25.5, size=9)])  # the watermark passes the terminator
    rows = XS.closed_sessions(replay.drain()).orderBy("started_at").collect()
    assert [(r.packet_count, r.total_bytes) for r in rows] == [(3, 160), (2, 3)]
    replay.feed([FAR])
    rows = XS.closed_sessions(replay.drain()).orderBy("started_at").collect()
    assert [(r.packet_count, r.total_bytes) for r in rows] == [(3, 160), (2, 3), (1, 7), (1, 9)]


def test_watermark_closes_idle_sessions(spark, tmp_path):
    replay = Replay(spark, tmp_path, XS.online_sessions)
    replay.feed([packet(1, 0)])
    replay.feed([FAR])
    replay.drain()
    replay.feed([packet(998, 100_001, src="192.0.2.1", dst="192.0.2.2", protocol="ICMP")])
    (row,) = replay.drain().collect()
    assert (row.low_ip, row.packets) == ("10.0.0.1", 1)


def test_any_cut_gives_the_batch_sessions(spark, tmp_path):
    import random

    rng = random.Random(21)
    rows = sorted(
        (packet(
            # A third of the packets are of one flow.
            i, round(rng.uniform(0, 240), 2), src=rng.choice(["10.0.0.1"] * 2 + ["10.0.0.3", "10.0.0.4"]),
            dport=rng.choice([80] * 2 + [443]), size=rng.choice([40, 60, 1500]),
            flags=rng.choice([None, "ACK", "SYN", "FIN"] + [None] * 6),
        ) for i in range(500)),
        key=lambda r: r[1],
    )
    built = S.build_sessions(packets(spark, rows), XS.IDLE_SECONDS)
    key = lambda df: sorted(map(tuple, df.select(*S.SESSION_COLS).fillna("").collect()))
    want = key(built)
    for cut in range(2):
        folder = tmp_path / str(cut)
        folder.mkdir()
        replay = Replay(spark, folder, XS.online_sessions)
        # Late by up to 9 s: packets of several batches are mixed.
        mixed = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 9))
        at = 0
        while at < len(mixed):
            n = rng.choice([60, 120, 200])
            replay.feed(mixed[at:at + n])
            at += n
            replay.drain()
        replay.feed([FAR])
        assert key(XS.closed_sessions(replay.drain())) == want


def test_many_sizes_and_ports_stay_exact(spark, tmp_path):
    replay = Replay(spark, tmp_path, lambda s: XS.online_sessions(s, inline=3))
    # To one address without ports of its own, so that all is one flow.
    rows = [
        packet(k, 0.5 * k, sport=None, dport=None, protocol="ICMP", size=k % 11) for k in range(60)
    ]
    for at in range(0, 60, 20):
        replay.feed(rows[at:at + 20])
        replay.drain()
    replay.feed([packet(70, 60, sport=None, dport=None, protocol="ICMP", size=1)])
    replay.drain()
    replay.feed([FAR])
    first, second = replay.drain().filter("low_ip = '10.0.0.1'").orderBy("first_at").collect()
    assert dict(zip(first.sizes, first.size_counts, strict=True)) == {k: 6 - (k > 4) for k in range(11)}
    # The maps of the first session are gone.
    assert (second.sizes, second.size_counts, second.packets) == ([1], [1], 1)


class Store:
    """A state variable of one key, which counts what is written."""

    def __init__(self):
        self.values, self.written = {}, 0

    def get(self):
        return self.values.get("one")

    def update(self, value):
        self.values["one"] = value

    def clear(self):
        self.values.clear()

    def getValue(self, key):
        return self.values.get(key)

    def containsKey(self, key):
        return key in self.values

    def updateValue(self, key, value):
        self.values[key], self.written = value, self.written + 1

    def iterator(self):
        return iter(list(self.values.items()))

    def keys(self):
        return iter(list(self.values))


def test_a_flow_of_many_ports_writes_only_changes():
    class Handle:
        timers = set()
        registerTimer, deleteTimer = timers.add, timers.discard

        def getValueState(self, *_):
            return Store()

        def getMapState(self, *_):
            return Store()

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    def fragment(at, ports):
        values = dict.fromkeys(XS.SUMS, 0) | {
            "first_at": at, "last_at": at, "initiator": "a", "packets": 1, "gap_min": None,
            "gap_max": None, "sizes": [40], "size_counts": [1], "ports": ports, "ends": False,
        }
        return {"slice_end": at, "fragments": [values]}

    sessions = XS.OnlineSessions(5.0)
    sessions.init(Handle())
    key = tuple("abcde")
    assert not list(sessions.handleInputRows(key, [fragment(1, list(range(60_000)))], Clock()))
    assert sessions.ports.written == 60_000 and not sessions.state.get()[XS.STATE.index("ports")]
    assert not list(sessions.handleInputRows(key, [fragment(2, [5, 70_000])], Clock()))
    assert sessions.ports.written == 60_001
    (closed,) = sessions.handleExpiredTimer(key, Clock(), None)
    assert len(closed.ports) == 60_001 and closed.size_counts == [2]
    assert sessions.state.get() is None and not sessions.ports.values


def test_text_gives_the_same_sessions_as_nested_rows():
    class Handle:
        registerTimer = deleteTimer = staticmethod(lambda timer: None)
        getValueState = getMapState = staticmethod(lambda *_: Store())

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 10**15

    def fragment(at, squares):
        return dict.fromkeys(XS.SUMS, 0) | {
            "first_at": at, "last_at": at, "initiator": 'a"\u00e9', "packets": 1, "gap_min": None,
            "gap_max": None, "gap_squares": squares, "sizes": [40, 7], "size_counts": [1, 2],
            "ports": [9, 8], "ends": False,
        }

    rows = [
        {"slice_end": at, "fragments": [fragment(at, 10**30)]} for at in (9_000_000, 1, 4_000_000)
    ]
    found = []
    for sessions, given in (
        (XS.OnlineSessions(4.5), rows),
        (XS.TextSessions(4.5), [{**r, "fragments": json.dumps(r["fragments"])} for r in rows]),
    ):
        sessions.init(Handle())
        found.append(list(sessions.handleInputRows(("flow",) * 5, given, Clock())))
    nested, text = found
    assert len(nested) == 2 and [t.flow for t in text] == ["flow"] * 2
    for plain, coded in zip(nested, text, strict=True):
        sums = json.loads(coded.sums)
        assert [sums[name] for name in XS.SUMS] == list(plain[len(S.FLOW_KEY):])
        assert type(sums["gap_squares"]) is int


def test_stream_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(11)
    rows = sorted(
        (packet(
            i, round(rng.uniform(0, 300), 3), src=rng.choice(["10.0.0.1", "10.0.0.3"]),
            dport=rng.choice([80, 443]), size=rng.choice([40, 60, 1500]),
            flags=rng.choice([None, "ACK", "SYN", "FIN"]),
        ) for i in range(400)),
        key=lambda r: r[1],
    )
    replay = Replay(spark, tmp_path, XS.online_sessions)
    for start in range(0, 400, 100):
        replay.feed(rows[start:start + 100])
        replay.drain()
    replay.feed([FAR])
    closed = replay.drain()
    batch = packets(spark, rows)
    built = S.build_sessions(batch, XS.IDLE_SECONDS)
    key = lambda df: sorted(map(tuple, df.select(*S.SESSION_COLS).fillna("").collect()))
    assert key(XS.closed_sessions(closed)) == key(built)

    # The same 17 features as the batch path.
    empty = spark.createDataFrame([], schemas.SESSIONS_SCHEMA)
    sessions = S.upsert_sessions(empty, built)
    linked = S.link_packets(
        batch.withColumn("session_id", F.lit(None).cast("bigint")),
        S.packet_assignments(S.assign_sessions(batch, XS.IDLE_SECONDS)), sessions,
    )
    want = {
        r.flow_hash: r
        for r in extract_features(sessions, linked)
        .join(sessions.select("session_id", "flow_hash"), "session_id").collect()
    }
    got = XS.closed_features(closed).collect()
    assert len(got) == len(want)
    for row in got:
        for name in FEATURE_COLS:
            assert math.isclose(row[name], want[row.flow_hash][name], rel_tol=1e-9, abs_tol=1e-9), name


def test_initiator_direction(spark, tmp_path):
    replay = Replay(spark, tmp_path, XS.online_sessions)
    replay.feed([
        packet(1, 0, "10.0.0.2", "10.0.0.1", 443, 12345, size=300),
        packet(2, 1, size=100, flags="RST"), FAR,
    ])
    closed = replay.drain().filter("low_ip = '10.0.0.1'")
    ratio = lambda d: XS.closed_features(closed, d).first().fwd_bwd_byte_ratio
    assert ratio("initiator") == 3.0 and ratio("canonical") == pytest.approx(1 / 3)


def test_session_window_gap(spark, tmp_path):
    replay = Replay(spark, tmp_path, XS.gap_sessions)
    replay.feed([packet(1, 0), packet(2, 4), packet(3, 10), FAR])
    rows = replay.drain().collect()
    assert sorted(r.packet_count for r in rows) == [1, 2]


def test_minutes_rates_and_active_flows(spark, tmp_path):
    rows = [packet(i, i * 0.5, src=f"10.0.0.{i % 3}", size=10) for i in range(200)] + [FAR]
    for name, transform in (
        ("minutes", XT.stream_traffic_trends), ("rate", XT.stream_rate),
        ("flows", XT.stream_active_flows),
    ):
        folder = tmp_path / name
        folder.mkdir()
        replay = Replay(spark, folder, transform)
        replay.feed(rows)
        out = replay.drain()
        if name == "minutes":
            got = [tuple(r)[1:] for r in out.orderBy("minute_bucket").collect()]
            assert got == [(120, 1200, 3), (80, 800, 3)]
        elif name == "rate":
            assert out.count() == 100 and {r.pps for r in out.collect()} == {2}
        else:
            assert out.agg(F.max("active_sessions")).first()[0] == 3
            # 100 s of traffic stay visible for two minutes.
            assert out.count() == 219


def test_active_flows_are_exact_for_any_cut(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [
        packet(i, round(rng.uniform(0, 900), 1), src=f"10.0.0.{rng.choice([1, 1, 2, 3, 4, 5])}")
        for i in range(60)
    ]
    mixed = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 9))
    replay = Replay(spark, tmp_path, XT.stream_flow_steps)
    for at in range(0, 60, 25):
        replay.feed(mixed[at:at + 25])
        replay.drain()
    replay.feed([FAR])
    got = {r.as_of: r.active_sessions for r in XT.active_flows(replay.drain()).collect()}
    want = {}
    for _, at, src, *_ in rows:
        second = at.replace(microsecond=0) + datetime.timedelta(seconds=1)
        for k in range(120):
            want.setdefault(second + datetime.timedelta(seconds=k), set()).add(src)
    assert got == {at: len(sources) for at, sources in want.items()}
