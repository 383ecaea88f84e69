"""Splits, audits, metrics, thresholds, codebooks, tokens and components on small frames."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from millrace.functions import labels as L
from millrace.functions import tokens as T
from millrace.operators import audit, codebook, metrics, splits, summary
from millrace.operators.graph import connected_components


@pytest.mark.parametrize(("n", "want"), [(1, ["train"]), (2, ["train", "test"]), (3, ["train", "val", "test"]), (20, ["train"] * 14 + ["val"] * 3 + ["test"] * 3)])
def test_strata_sizes(spark, n, want):
    df = spark.createDataFrame([(f"g{k}", "s", k) for k in range(n)] + [("g0", "other", n)], "g string, s string, o long")
    got = sorted(r["split"] for r in splits.stratified_hash_split(df, "g", "s", ["o"]).collect())
    assert got == sorted(want)


def test_time_blocks_cover_every_group_once(spark):
    for n in (1, 2, 4, 7, 50):
        df = spark.createDataFrame([(k, "s", float(k)) for k in range(n)], "g long, s string, t double")
        got = splits.time_block_split(df, "g", "s", "t", [], 8).collect()
        assert sorted(r["g"] for r in got) == list(range(n))
        assert n < 4 or {r["split"] for r in got} == {"train", "val", "test"}


def test_class_cap(spark):
    df = spark.createDataFrame([("a", k) for k in range(10)] + [("b", 1)], "c string, k long")
    assert {r["c"]: r["count"] for r in splits.class_cap(df, "c", "k", 3).groupBy("c").count().collect()} == {"a": 3, "b": 1}
    assert splits.class_cap(df, "c", "k", 0).count() == 11


def test_leaks_and_overlaps(spark):
    df = spark.createDataFrame([("a", "train", b"x"), ("a", "test", b"y"), ("b", "val", b"x"), ("c", "val", None)], "f string, split string, b binary")
    assert [(r["f"], r["splits"]) for r in audit.flow_leaks(df, "f").collect()] == [("a", ["test", "train"])]
    assert {r["pair"]: r["n"] for r in audit.overlaps(df, F.sha1("b")).collect()} == {"train/val": 1, "train/test": 0, "val/test": 0}


def test_validation_issues(spark):
    rows = [("f", "v", None, 0, 0, ["fwd"], [1, 2]), ("f", "v", "benign", 1, 5, ["fwd"], [1])]
    df = spark.createDataFrame(rows, "flow_id string, view string, major string, n int, p int, d array<string>, l array<int>")
    args = ("major", "n", "p", "flow_id", "view", "d", "l")
    assert {r["code"]: r["n"] for r in audit.validation(df, ["flow_id"], *args).collect()} == {"null_label": 1, "no_packets": 1, "empty_payload": 1, "length_mismatch": 1, "duplicate_rows": 1}
    assert {r["code"] for r in audit.validation(df.where("false"), ["flow_id"], *args).collect()} == {"empty_table"}
    assert [r["code"] for r in audit.validation(df, ["nothing"], *args).collect()] == ["missing_column:nothing"]


def test_detection(spark):
    df = spark.createDataFrame([("benign", "benign"), ("x", "x"), ("y", "benign"), ("benign", "y")], "t string, g string")
    r = metrics.detection(df, "t", "g").first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (1, 1, 1, 1)
    assert metrics.detection(df.where("false"), "t", "g").first()["attack_f1"] == 0


def test_calibration(spark):
    rows = [([1, 0], [0.9, 0.2]), ([1, 0], [0.8, 0.4]), ([0, 1], [0.6, 0.6]), ([0, 1], [0.1, 0.9])]
    df = spark.createDataFrame(rows, "t array<int>, p array<double>")
    got = {r["label"]: (r["threshold"], r["f1"]) for r in metrics.calibrated(df, "t", "p", ["a", "b"], [0.3, 0.5, 0.7]).collect()}
    assert got == {"a": (0.7, 1.0), "b": (0.5, 1.0)}
    none = metrics.calibrated(spark.createDataFrame([([0], [0.9])], "t array<int>, p array<double>"), "t", "p", ["a"], [0.3, 0.7]).first()
    assert (none["threshold"], none["support"]) == (0.5, 0)


def test_sweep_equals_brute_force_with_ties(spark):
    random.seed(4)
    rows = [(random.choice([0.1, 0.2, 0.5, 0.9]), random.random() < 0.4) for _ in range(60)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    at = spark.createDataFrame([(t,) for t in (0.05, 0.2, 0.3, 0.9, 1.0)], "threshold double")
    for r in metrics.threshold_sweep(df, "s", F.col("y"), at).collect():
        assert r["tp"] == sum(y and s >= r["threshold"] for s, y in rows) and r["fp"] == sum(not y and s >= r["threshold"] for s, y in rows)


def test_frequent_chunks(spark):
    df = spark.createDataFrame([(b"GET /index",), (b"GET /login",)], "b binary")
    assert [r["pattern_hex"] for r in codebook.frequent(df, "b", 2, 2, 2).orderBy("place").collect()] == [b"GE".hex(), b"T ".hex()]
    zero = spark.createDataFrame([(b"\0\0AB",), (b"\0\0AB",), (b"",), (None,)], "b binary")
    assert [r["pattern_hex"] for r in codebook.frequent(zero, "b", 2, 5, 2).collect()] == [b"AB".hex()]


def test_label_lift_and_codebook_round_trip(spark):
    df = spark.createDataFrame([(b"AAAA", "benign")] * 2 + [(b"BBBB", "bot")] * 2, "b binary, l string")
    book = codebook.lifted(df, "b", "l", 2, target="bot")
    r = book.orderBy("place").first()
    assert (r["pattern_hex"], r["score"]) == (b"BB".hex(), 0.5)
    back = codebook.from_json(spark, codebook.to_json(book, "label_lift", 2))
    assert back.first()["token"] == "[SCE_0000]"
    used = df.select(codebook.encoded(df, "b", [(b"BB".hex(), "[SCE_0000]")], 2)).collect()
    assert used[3][0] == ["[SCE_0000]"] * 2 and used[0][0] == ["b_41"] * 4


def test_tokens(spark):
    assert len(T.vocabulary()) == 318 and T.vocabulary()[8] == "b_00"
    df = spark.createDataFrame([(bytes(range(10)),), (b"",)], "b binary")
    ids = [r[0] for r in df.select(T.byte_ids(F.col("b"))).collect()]
    assert ids == [list(range(8, 18)), []]
    for r, body in zip(df.select(T.first_window_digest(T.byte_ids(F.col("b")))).collect(), ids, strict=True):
        whole = ([T.CLS, *body, T.SEP] + [0] * 512)[:512]
        assert r[0] == hashlib.sha1(struct.pack("<512H", *whole)).hexdigest()
    sizes = spark.createDataFrame([(k, [1] * k) for k in (0, 1, 510, 511, 894, 895)], "n int, ids array<int>")
    assert {r[0]: r[1] for r in sizes.select("n", F.size(T.windows(F.col("ids")))).collect()} == {0: 1, 1: 1, 510: 1, 511: 2, 894: 2, 895: 3}


def test_label_map(spark):
    df = spark.createDataFrame([("Bot",), ("robot",), (" web attack – brute force",), ("",), (None,)], "s string")
    got = {r["s"]: (r["major_label"], r["minor_labels"]) for r in L.map_labels(df, "s").collect()}
    assert got["Bot"] == ("botnet_malware", ["botnet"]) and got["robot"][0] == "other_attack" and got[" web attack – brute force"] == ("web_attack", ["web_bruteforce"])
    assert got[""] == got[None] == ("other_attack", ["other_attack"])


def test_components_equal_brute_force(spark):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_to_one_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 0.5), (2, 0.1)], "k int, p double")
    assert summary.joined_predictions(a, b, "k").count() == 2
    with pytest.raises(ValueError):
        summary.joined_predictions(a, b.where("k = 1"), "k")
