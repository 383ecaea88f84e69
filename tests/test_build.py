"""From captures to labelled, split and audited flows, and the commands."""

import json

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.operators import gates, metrics
from millrace.plans import build
from millrace.sources import pcap
from tests.test_flows import PACKET
from tests.test_sources import capture, frame


def labels(spark, rows):
    return spark.createDataFrame(rows, "x string, y string, lt double, label string, ord long")


def three_flows(spark):
    rows = [("d/c.pcap", k, 10.0 + k, "tcp", "10.0.0.1", "10.0.0.2", 1000 + k, 80, "PA", b"data" if k == 0 else b"") for k in range(3)]
    return build.extract(spark.createDataFrame(rows, PACKET))


def test_counters(spark):
    found = labels(spark, [("10.0.0.1:1000", "10.0.0.2:80", 9.0, "DDoS", 0), ("10.0.0.2:80", "10.0.0.1:1001", 11.5, "BENIGN", 1)])
    r = build.counters(three_flows(spark), found, 900.0).first()
    assert (r["extracted"], r["matched"], r["unmatched"], r["empty"], r["kept"]) == (3, 2, 1, 2, 1)
    (one,) = build.labelled(three_flows(spark), found, 900.0).collect()
    assert (one["major_label"], one["minor_labels"], one["label_match_mode"], one["label_time_delta_seconds"]) == ("dos_ddos", ["ddos"], "directional", 1.0)
    every = build.labelled(three_flows(spark), found, 900.0, drop_unmatched=False, drop_empty=False)
    assert sorted(r["source_label"] for r in every.collect()) == ["BENIGN", "DDoS", "UNMATCHED"]
    assert build.labelled(three_flows(spark), found.where("false"), 900.0).count() == 0


@pytest.mark.parametrize("method", ["hash", "time", "block"])
def test_split_and_audit(spark, method):
    rows = [("d/c.pcap", k, 1000.0 * k, "tcp", "10.0.0.1", "10.0.0.2", 1000 + k, 80, "PA", b"d%d" % (k % 20)) for k in range(30)]
    flows = build.extract(spark.createDataFrame(rows, PACKET)).withColumn("major_label", F.lit("benign"))
    out, report = build.split_and_audit(flows, "flow_id", "major_label", method)
    assert out.count() == 30 and {r["split"] for r in out.select("split").distinct().collect()} == {"train", "val", "test"}
    assert {r["check"]: r["blocking"] for r in report.collect()} == {"flow_leak": False, "digest_overlap": True, "file_overlap": False}


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(capture([(10.0, frame()), (11.0, frame(number=17)), (500.0, frame())]))
    cli.main(["build", str(tmp_path / "in"), str(tmp_path / "flows")])
    flows = spark.read.parquet(str(tmp_path / "flows"))
    assert sorted(r["connection_type"] for r in flows.collect()) == ["tcp_payload", "tcp_payload", "udp_payload"]
    flows.withColumns({"major_label": F.lit("benign"), "source_label": F.lit("x"), "pred_label": F.lit("benign")}).write.parquet(str(tmp_path / "rows"))
    cli.main(["stats", str(tmp_path / "rows")])
    assert json.loads(capsys.readouterr().out)["rows"] == 3
    cli.main(["validate", str(tmp_path / "rows")])
    assert json.loads(capsys.readouterr().out) == []
    cli.main(["split", str(tmp_path / "rows"), str(tmp_path / "split")])
    cli.main(["merge", str(tmp_path / "merged"), str(tmp_path / "rows"), str(tmp_path / "rows")])
    assert spark.read.parquet(str(tmp_path / "merged")).count() == 3
    cli.main(["vocab", str(tmp_path / "v.txt")])
    assert (tmp_path / "v.txt").read_text().count("\n") == 318
    cli.main(["codebook", str(tmp_path / "rows"), str(tmp_path / "b.json"), "--size", "2"])
    assert json.loads((tmp_path / "b.json").read_text())["entries"][0]["pattern_hex"] == b"hi".hex()
    capsys.readouterr()
    cli.main(["evaluate", str(tmp_path / "rows")])
    assert json.loads(capsys.readouterr().out)["accuracy"] == 1.0


def test_gates(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, g string")
    per = metrics.per_class(df, "t", "g", ["a", "b", "c"])
    got = {r["label"]: (r["passed"], r["reason"]) for r in gates.acceptance(per, [("a", 1, 0.9, 0.1), ("b", 1, 0.9, 0.1), ("c", 1, 0.1, 0.1), ("z", 0, 0.0, 0.0)]).collect()}
    assert got == {"a": (False, "recall"), "b": (True, None), "c": (False, "support"), "z": (True, None)}
    assert gates.schema_gate(df, {"t": "string", "g": "int", "q": "int"}, {"t": "a"}) == ["q: missing", "g: string, not int", "t: 1 rows are not a"]
    assert gates.any_low(df.withColumn("split", F.lit("val")), "t", ["a"], 3)
    assert [p["n"] for p in gates.enabled_policies({"policies": [{"n": 1}, {"n": 2, "enabled": False}, {"n": 3, "test_passed_requirements": False}]})] == [1]


def test_host_thresholds_and_policies(spark):
    rows = [(k, "f", f"h{k % 3}", "bot" if k % 3 == 0 else "benign", 0.9 if k % 3 == 0 else 0.2, 100.0 * k) for k in range(30)]
    df = spark.createDataFrame(rows, "flow_id long, source_file string, host string, major_label string, score double, start_time double").withColumn("start_us", (F.col("start_time") * 1e6).cast("long"))
    report = gates.host_thresholds(df, df, "bot", [30, 300], 0.9, 0.9, steps=9, quantiles=3)
    assert report.count() == 10 and report.where("f1 < 1").count() == 0
    assert [(t, s) for t, s, _ in gates.policies_of(report, "bot", 0.9, 0.9)] == [("bot", 30), ("bot", 300)]


def test_empty_capture(spark, tmp_path):
    (tmp_path / "e.pcap").write_bytes(capture([]))
    assert build.extract(pcap.read_packets(spark, str(tmp_path))).count() == 0
