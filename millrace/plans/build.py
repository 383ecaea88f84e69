"""From packets to labelled, split and audited flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions.labels import map_labels
from millrace.operators import asof, audit, sessions, splits
from millrace.session import written

UNMATCHED = "UNMATCHED"
KEYS = ["source_file", "protocol", "endpoint_a", "endpoint_b"]


def extract(packets: DataFrame, idle: float = sessions.IDLE_SECONDS, cap: int = 32, closing: bool = False) -> DataFrame:
    """Flow rows of parsed packets whose flags are letters or bits."""
    if dict(packets.dtypes)["tcp_flags"] == "int":
        packets = packets.withColumn("tcp_flags", F.when(F.col("tcp_flags").isNotNull(), C.tcp_flag_letters(F.col("tcp_flags"))))
    keyed = sessions.keyed(packets)
    numbered = sessions.closing_sessions(keyed, idle) if closing else sessions.idle_sessions(keyed, KEYS, "ts", "packet_index", idle)
    return sessions.flows(numbered, cap)


def labelled(flows: DataFrame, labels: DataFrame, tolerance: float, drop_unmatched: bool = True, drop_empty: bool = True) -> DataFrame:
    """Flows with source, major and minor labels, match mode and distance. labels: x, y (endpoints), lt, label, ord."""
    found = asof.two_way_label(flows, labels, ("initiator_endpoint", "responder_endpoint"), ("x", "y"), "flow_id", "start_time", "lt", "label", "ord", tolerance)
    found = found.select("flow_id", F.col("label").alias("source_label"), F.col("mode").alias("label_match_mode"), F.col("delta").alias("label_time_delta_seconds"))
    rows = flows.join(found, "flow_id", "inner" if drop_unmatched else "left")
    rows = rows.where("has_payload") if drop_empty else rows
    return map_labels(rows.withColumn("source_label", F.coalesce("source_label", F.lit(UNMATCHED))), "source_label")


def counters(flows: DataFrame, labels: DataFrame, tolerance: float, drop_unmatched: bool = True, drop_empty: bool = True) -> DataFrame:
    """One row: extracted, matched, unmatched, empty and kept flows."""
    found = labelled(flows, labels, tolerance, drop_unmatched=False, drop_empty=False)
    unmatched = F.col("source_label") == UNMATCHED
    kept = (~unmatched | F.lit(not drop_unmatched)) & (F.col("has_payload") | F.lit(not drop_empty))
    return found.agg(F.count("*").alias("extracted"), F.count_if(~unmatched).alias("matched"), F.count_if(unmatched).alias("unmatched"), F.count_if(~F.col("has_payload")).alias("empty"), F.count_if(kept).alias("kept"))


def split_and_audit(flows: DataFrame, group: str, stratum: str, method: str = "hash", time: str = "start_time", block: int = 512) -> tuple[DataFrame, DataFrame]:
    """Flows with split, and the audit of it. Flows are written once; split and audit read that table."""
    base = written(flows, "flows")
    made = {
        "hash": lambda: splits.stratified_hash_split(base, group, stratum, ["flow_id"]), "time": lambda: splits.time_ordered_split(base, group, stratum, time, ["flow_id"]),
        "block": lambda: splits.time_block_split(base, group, stratum, time, ["flow_id"], block),
    }[method]()
    out = written(splits.assigned(base, made, group), "splits")
    return out, audit.audit(out.withColumn("_digest", C.bytes_digest(F.col("bytes"))), "flow_id", "_digest", "source_file")
