"""Sessions, flow rows and windows on small frames, ties and edges included."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import asof, sessions, windows

PACKET = "source_file string, packet_index long, ts double, protocol string, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags string, payload binary"


def packets(spark, rows):
    """rows: (ts, forward?, flags, payload)"""
    ends = ("10.0.0.1", "10.0.0.2", 1000, 80)
    made = []
    for k, (ts, forward, flags, payload) in enumerate(rows):
        a, b, p, q = ends if forward else (ends[1], ends[0], ends[3], ends[2])
        made.append(("d/cap.pcap", k, ts, "tcp", a, b, p, q, flags, payload))
    return sessions.keyed(spark.createDataFrame(made, PACKET))


def flow_rows(spark, rows, closing=False, cap=32, idle=120.0):
    p = packets(spark, rows)
    keys = ["source_file", "protocol", "endpoint_a", "endpoint_b"]
    p = sessions.closing_sessions(p, idle) if closing else sessions.idle_sessions(p, keys, "ts", "packet_index", idle)
    return sorted(sessions.flows(p, cap).collect(), key=lambda r: r["session"])


def test_idle_gap_splits_and_equal_gap_does_not(spark):
    assert [r["packet_count"] for r in flow_rows(spark, [(1.0, True, "PA", b"x"), (200.0, True, "PA", b"x")])] == [1, 1]
    assert [r["packet_count"] for r in flow_rows(spark, [(1.0, True, "PA", b"x"), (121.0, True, "PA", b"x")])] == [2]


def test_closing_flags(spark):
    rows = [(1.0, True, "PA", b"x"), (2.0, True, "FA", b""), (3.0, True, "S", b""), (4.0, True, "PA", b"x")]
    assert [r["packet_count"] for r in flow_rows(spark, rows, closing=True)] == [2, 2]
    assert [r["packet_count"] for r in flow_rows(spark, [(1.0, True, "R", b""), (2.0, True, "S", b"")], closing=True)] == [1, 1]
    fins = [(1.0, True, "FA", b""), (2.0, False, "FA", b""), (3.0, True, "A", b"")]
    assert [r["packet_count"] for r in flow_rows(spark, fins, closing=True)] == [2, 1]


def test_resets_end_a_session_only_if_asked_to(spark):
    rows = [(10.0, True, "S", b""), (10.2, False, "R", b""), (13.0, True, "PA", b"hello"), (13.5, False, "A", b"")]
    (one,) = flow_rows(spark, rows)
    assert (one["packet_count"], one["payload_byte_length"], one["start_time"], one["end_time"], one["connection_type"]) == (4, 5, 10.0, 13.5, "tcp_payload")
    assert [r["packet_count"] for r in flow_rows(spark, rows, closing=True)] == [2, 2]


def test_cap_keeps_counting(spark):
    (r,) = flow_rows(spark, [(1.0, True, "PA", b"a"), (2.0, False, "PA", b"bb"), (3.0, True, "PA", b"c")], cap=2)
    assert (r["packet_count"], r["observed_packet_count"], r["was_packet_truncated"], r["end_time"]) == (2, 3, True, 3.0)
    assert (r["packet_directions"], r["packet_lengths"], bytes(r["bytes"])) == (["fwd", "bwd"], [1, 2], b"abb")
    assert r["flow_id"].startswith("cap_") and r["flow_id"].endswith("_000000")


def test_reset_without_payload(spark):
    (r,) = flow_rows(spark, [(1.0, True, "S", b""), (1.1, False, "R", b"")])
    assert r["connection_type"] == "tcp_reset_or_refused"


def test_context_with_ties(spark):
    random.seed(2)
    rows = [(k, "h", random.choice([0, 30, 60, 61, 100]) * 1_000_000, random.choice(["a", "b", "c", None])) for k in range(60)]
    df = spark.createDataFrame(rows, "o long, h string, t long, v string")
    got = windows.with_prior_distinct(df.withColumn("n", windows.prior(F.lit(1), ["h"], "t", "o", 60)), "d", "v", ["h"], "t", "o", 60).collect()
    assert len(got) == len(rows)
    for r in got:
        _, _, t, _ = rows[r["o"]]
        before = [x for x in rows if t - 60_000_000 <= x[2] and (x[2], x[0]) < (t, r["o"])]
        assert (r["n"], r["d"]) == (len(before), len({x[3] for x in before}))


def test_context_counts(spark):
    rows = [(0, "f", "h", 100_000_000, "tcp_payload", 1, "80", "x"), (1, "f", "h", 130_000_000, "tcp_reset_or_refused", 0, "80", "x"), (2, "f", "h", 170_000_000, "tcp_payload", 1, "81", "x")]
    df = spark.createDataFrame(rows, "o long, file string, host string, t long, kind string, p int, port string, dst string")
    got = windows.flow_context(df, ["file", "host"], "t", "o", "kind", "p", "port", "dst").orderBy("o").collect()
    assert [r["context_host_flow_count_60s"] for r in got] == [0, 1, 1]
    assert (got[2]["context_host_flow_count_300s"], got[2]["context_host_reset_count_60s"], got[2]["context_host_distinct_dport_60s"]) == (2, 1, 1)


def test_trailing_max(spark):
    rows = [(0, "a", 100_000_000, 0.9), (1, "a", 110_000_000, 0.2), (2, "b", 115_000_000, 0.1), (3, "a", 170_500_000, 0.3)]
    df = spark.createDataFrame(rows, "o long, h string, t long, s double")
    assert [r[0] for r in df.select(windows.trailing_max("s", ["h"], "t", "o", 60), "o").orderBy("o").collect()] == [0.9, 0.9, 0.1, 0.3]


def test_nearest_label_ties(spark):
    flows = spark.createDataFrame([(0, "k", 100.0), (1, "k", None), (2, "z", 100.0), (3, "k", 500.0)], "f long, k string, t double")
    labels = spark.createDataFrame([("k", 90.0, "before", 0), ("k", 110.0, "after2", 2), ("k", 110.0, "after1", 1)], "k string, lt double, l string, o long")
    got = {r["f"]: (r["label"], r["delta"]) for r in asof.nearest_label(flows, labels, ["k"], "f", "t", "lt", "l", "o", 60.0).collect()}
    assert got == {0: ("after1", 10.0), 1: ("before", None)}


def test_nearest_label_of_a_hot_key(spark):
    """Against all pairs, with many equal times, records without time and keys without timed records."""
    random.seed(7)
    flows = [(k, random.choice("aaab"), random.choice([None, *range(0, 400, 7)])) for k in range(300)]
    labels = [(random.choice("aaa"), random.choice([None, *range(0, 400, 5)]), f"l{k}", k) for k in range(200)] + [("b", None, "only", 1000), ("b", None, "later", 1001)]
    f = spark.createDataFrame([(k, key, None if t is None else float(t)) for k, key, t in flows], "f long, k string, t double")
    m = spark.createDataFrame([(key, None if t is None else float(t), name, o) for key, t, name, o in labels], "k string, lt double, l string, o long")
    got = {r["f"]: (r["label"], r["delta"]) for r in asof.nearest_label(f, m, ["k"], "f", "t", "lt", "l", "o", 9.0).collect()}
    want = {}
    for k, key, t in flows:
        own = [x for x in labels if x[0] == key]
        timed = [x for x in own if x[1] is not None]
        if t is None or not timed:
            want[k] = (min(own, key=lambda x: x[3])[2], None)
        elif near := [x for x in timed if abs(x[1] - t) <= 9]:
            best = min(near, key=lambda x: (abs(x[1] - t), -x[1], x[3] if x[1] >= t else -x[3]))
            want[k] = (best[2], float(abs(best[1] - t)))
    assert got == want


def test_afternoon_times(spark):
    df = spark.createDataFrame([("Friday-Afternoon.csv", 3600.0 * 3), ("full.csv", 3600.0 * 9), ("full.csv", 3600.0 * 7), ("x.csv", 3600.0)], "file string, s double")
    got = [r[0] / 3600 for r in df.select(asof.afternoon(F.col("s"), F.col("file"), {"afternoon": 12, "full": 8})).collect()]
    assert got == [15, 9, 19, 1]


def test_two_way_label(spark):
    flows = spark.createDataFrame([(0, "a", "b", 103.0), (1, "a", "b", 101.5)], "f long, x string, y string, t double")
    labels = spark.createDataFrame([("a", "b", 100.0, "ddos", 0), ("b", "a", 103.0, "benign", 1)], "p string, q string, lt double, l string, o long")
    got = {r["f"]: (r["label"], r["mode"], r["delta"]) for r in asof.two_way_label(flows, labels, ("x", "y"), ("p", "q"), "f", "t", "lt", "l", "o", 900.0).collect()}
    assert got == {0: ("benign", "directional_reversed", 0.0), 1: ("ddos", "directional", 1.5)}


def test_label_records_and_times(spark):
    raw = spark.createDataFrame([(" BENIGN ", "3/7/2017 9:00"), ("", "x"), (None, "2017-07-03 09:00:05")], "`Label` string, `Time Stamp` string")
    got = asof.label_records(raw, {"timestamp": ("time_stamp",)}, ("label", "timestamp"))
    assert [tuple(r) for r in got.collect()] == [("BENIGN", "3/7/2017 9:00")]
    assert got.select(asof.label_time(F.col("timestamp"))).first()[0] == 1499072400.0
    with pytest.raises(ValueError):
        asof.label_records(raw, {}, ("missing",))


def test_shape_signature_text(spark):
    import hashlib

    df = spark.createDataFrame([("tcp_payload", [10, 600], 40, ["fwd", "BWD"]), ("udp_payload", [5], 0, ["x"]), ("tcp_empty", [], None, [])], "c string, l array<int>, p int, d array<string>")
    got = [r[0] for r in df.select(C.shape_signature(F.col("c"), F.col("l"), F.col("p"), F.col("d"))).collect()]
    want = [("tcp_payload", "2", "32-127", "fb", ("1-63", "512-1500")), ("udp_payload", "1", "0", "?", ("1-63",)), ("tcp_empty", "0", "0", "", ())]
    assert got == [hashlib.sha1(repr(w).encode()).hexdigest()[:16] for w in want]
