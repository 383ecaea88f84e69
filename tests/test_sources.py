"""Captures, tables, sinks, streams and models."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, models
from millrace.sources import pcap, sinks, tables
from millrace.streaming import flows as streams


def frame(payload=b"hi", tags=0, fragment=0, number=6, options=0, ethertype=0x0800):
    l4 = (struct.pack(">HHIIBBHHH", 1000, 80, 1, 2, (5 + options) << 4, 0x18, 10, 7, 0) + bytes(4 * options)) if number == 6 else struct.pack(">HHHH", 1000, 53, 8 + len(payload), 9)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4) + len(payload), 5, fragment, 64, number, 99, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return bytes(range(1, 13)) + b"\x81\x00\x00\x05" * tags + struct.pack(">H", ethertype) + ip + l4 + payload + b"pad"


def capture(rows, order="<", nano=False):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1"}[order, nano]
    body = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1)
    for ts, f in rows:
        body += struct.pack(order + "IIII", int(ts), round((ts - int(ts)) * (1e9 if nano else 1e6)), len(f), len(f)) + f
    return body


def test_parse_frame():
    got = pcap.parse_frame(frame(tags=2, options=1))
    assert (got["protocol"], got["src_ip"], got["dst_port"], got["tcp_flags"], got["payload"], got["l3"]) == ("tcp", "10.0.0.1", 80, 0x18, b"hi", 22)
    assert pcap.parse_frame(frame(number=17))["payload"] == b"hi"
    for bad in (frame()[:30], frame(fragment=5), frame(number=1), frame(ethertype=0x86DD), b""):
        assert pcap.parse_frame(bad) is None


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", False), ("<", True)])
def test_captures(spark, tmp_path, order, nano):
    (tmp_path / "sub").mkdir()
    rows = [(10.5, frame()), (11.25, frame(number=17)), (12.0, b"short"), (13.0, frame(payload=b""))]
    (tmp_path / "sub" / "a.pcap").write_bytes(capture(rows, order, nano))
    (tmp_path / "sub" / "note.txt").write_text("x")
    spark.dataSource.register(pcap.PcapSource)
    got = spark.read.format("pcap").option("path", str(tmp_path)).load().orderBy("packet_index").collect()
    assert [(r["packet_index"], r["ts"]) for r in got] == [(0, 10.5), (1, 11.25), (3, 13.0)]
    late = spark.read.format("pcap").option("path", str(tmp_path)).option("minTime", "11").option("maxTime", "12.5").load().collect()
    assert [r["packet_index"] for r in late] == [1]
    df = pcap.read_packets(spark, str(tmp_path))
    assert df.count() == 3
    masked = bytes(df.where("packet_index = 0").select(pcap.masked_frame(F.col("frame"), F.col("l3"), F.col("l4"), F.col("protocol"))).first()[0])
    plain = frame()
    assert masked[:12] == bytes(12) and masked[24:34] == bytes(10)[:2] + bytes(8) and masked[34:38] == bytes(4) and masked[50:52] == bytes(2)
    assert masked[12:24] == plain[12:24] and masked[38:50] == plain[38:50] and masked[54:] == plain[54:]


def test_pcapng():
    import io

    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    f = frame()
    ticks = int(5.5 * 1e9)
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0)) + block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f)
    assert list(pcap.records(io.BytesIO(data))) == [(5.5, f)]


def test_payload_table(spark):
    df = spark.createDataFrame([(0, 1, 2, 0, 0, "6", "A"), (1, 9, 0, 8, 0, None, "B"), (2, 0, 0, 0, 0, "17", "C")], "o long, payload_byte_1 int, payload_byte_2 int, payload_byte_10 int, payload_byte_11 int, protocol string, label string")
    got = tables.payload_flows(df, "d", "o").orderBy("flow_id").collect()
    assert [(r["flow_id"], bytes(r["bytes"]).hex(), r["ttl"]) for r in got] == [("d:packet:0", "0102", 0.0), ("d:packet:1", "090008", 0.0)]
    assert tables.payload_flows(df, "d", "o", drop_empty=False).count() == 3


def test_zip_config_json(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a/Monday.CSV", "Label\nna\xefve\n".encode("latin-1"))
        z.writestr("b/Tuesday.csv", "Label\nb\n")
    assert tables.read_zipped_csv(spark, str(tmp_path / "x.zip"), ("monday",), str(tmp_path)).first()[0] == "na\xefve"
    with pytest.raises(ValueError):
        tables.zipped_csv_name(["a.csv", "b.csv"], ())
    (tmp_path / "c.yaml").write_text("build: {cap: 3}\ndatasets: [{name: a}, {name: b, cap: 4}]\n")
    config = tables.load_config(str(tmp_path / "c.yaml"))
    assert [(d["name"], d["cap"]) for d in tables.build_configs(config)] == [("a", 3), ("b", 4)] and tables.nested(config, "build.cap") == 3
    (tmp_path / "bad.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        tables.load_config(str(tmp_path / "bad.yaml"))
    for step in (1, 2):
        sinks.append_records(spark.createDataFrame([(step,)], "a int"), str(tmp_path / "steps"))
    assert sorted(r[0] for r in tables.read_json_lines(spark, str(tmp_path / "steps"), "a int", 5).collect()) == [1, 2]
    sinks.put_text(spark, str(tmp_path / "m" / "m.json"), json.dumps({"p": [1]}))
    assert tables.is_fresh(str(tmp_path / "m" / "m.json"), {"p": [1]}) and not tables.is_fresh(str(tmp_path / "m" / "m.json"), {"p": [1], "q": 2})
    nested = spark.sql("SELECT named_struct('b', 1, 'd', named_struct('e', 2)) AS a, 3 AS c")
    assert sinks.flat(nested).first().asDict() == {"a_b": 1, "a_d_e": 2, "c": 3}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", [0.1, 0.9]), (2, "val", [0.8, 0.2])], "k int, split string, p array<double>")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'val'").count() == 1
    rows = sinks.prediction_rows(df, ["k"], "p", ["a", "b"])
    sinks.write_predictions(rows, str(tmp_path / "p.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p.csv")).columns == ["k", "prob_a", "prob_b"]
    sinks.write_report(df.select("k"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"k": 1}, {"k": 2}]


def test_metric_exports(spark, tmp_path):
    df = spark.createDataFrame([("benign", "benign"), ("scan", "benign"), ("scan", "scan"), ("other", "scan")], "t string, g string")
    labels = ["benign", "scan", "bot"]
    pairs = metrics.confusion(df, "t", "g", labels)
    sinks.write_metrics(str(tmp_path / "m"), metrics.major_metrics(df, "t", "g", labels), metrics.per_class(df, "t", "g", labels), pairs, metrics.detection(df, "t", "g"), labels)
    assert (tmp_path / "m" / "confusion.csv").read_text().splitlines() == ["true_label,benign,scan,bot", "benign,1,0,0", "scan,1,1,0", "bot,0,0,0"]
    assert (tmp_path / "m" / "confusion_normalized.csv").read_text().splitlines()[2] == "scan,0.5,0.5,0.0"
    assert json.loads((tmp_path / "m" / "detection.json").read_text())[0]["tp"] == 2
    assert len((tmp_path / "m" / "per_class.csv").read_text().splitlines()) == 4


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "f", "h", "scan", 0.9), ("2024-01-01 00:00:40", "f", "h", "benign", 0.2), ("2024-01-01 02:00:00", "f", "h", "benign", 0.1), ("2024-01-01 06:00:00", "f", "z", "benign", 0.1)]
    base = spark.createDataFrame(rows, "t string, source_file string, host string, major_label string, major_prob double").selectExpr("to_timestamp(t) AS ts", "*", "host AS key").drop("t").coalesce(1)
    for k in range(4):
        base.where(f"ts = to_timestamp('{rows[k][0]}')").write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drained(streams.host_windows(read(), 60).writeStream.outputMode("append").format("memory").queryName("w").start())
    assert sorted((r["window_start"], r["flow_count"], r["high_risk_count"]) for r in spark.table("w").collect())[0] == (1704067200, 2, 1)
    drained(streams.idle_sessions(read(), 120.0).writeStream.outputMode("append").format("memory").queryName("s").start())
    got = sorted((r["key"], r["packets"]) for r in spark.table("s").collect())
    assert got[:2] == [("h", 1), ("h", 2)]


def test_linear_model(spark, tmp_path):
    df = spark.createDataFrame([(b"aaaa", "x"), (b"aaab", "x"), (b"zzzz", "y"), (b"zzzy", "y")] * 3, "b binary, l string")
    rows = models.with_terms(df, "b", 1, 2)
    for kind in ("logistic", "hinge"):
        got = models.train_linear(rows, "l", ["x", "y"], kind, 100).transform(rows)
        assert got.where("pred_label = l").count() == 12
    model = models.train_linear(models.with_terms(df, "b"), "l", ["x", "y"])
    model.write().overwrite().save(str(tmp_path / "model"))
    found = models.predicted(models.loaded(str(tmp_path / "model")), df.drop("l"), "b").collect()
    assert [r["pred_label"] for r in found] == [r["l"] for r in df.collect()] and all(abs(sum(r["pred_probs"]) - 1) < 1e-6 for r in found)
