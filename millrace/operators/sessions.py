"""Flow reconstruction: packets of one key become sessions, sessions become flow rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import columns as C

IDLE_SECONDS = 120.0


def keyed(packets: DataFrame) -> DataFrame:
    """packets with src, dst and the key's endpoints a and b."""
    src, dst = C.endpoint(F.col("src_ip"), F.col("src_port")), C.endpoint(F.col("dst_ip"), F.col("dst_port"))
    rows = packets.withColumns({"src": src, "dst": dst})
    return rows.withColumns({"endpoint_a": F.least("src", "dst"), "endpoint_b": F.greatest("src", "dst")})


def idle_sessions(df: DataFrame, keys: list[str], time: str, order: str, idle: float = IDLE_SECONDS, name: str = "session") -> DataFrame:
    """df with the number of its session among those of its keys, in file order.

    A gap to the packet before, in file order, of more than idle seconds begins a new session; a gap of just idle does not.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    begins = F.when(F.col(time) - F.lag(time).over(by) > idle, 1).otherwise(0)
    return df.withColumn("_begins", begins).withColumn(name, F.sum("_begins").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_begins")


def closing_sessions(packets: DataFrame, idle: float = IDLE_SECONDS, keys: tuple[str, ...] = ("source_file", "protocol", "endpoint_a", "endpoint_b")) -> DataFrame:
    """packets (keyed) with session, where TCP's close flags end sessions too.

    A reset, or FINs in both directions, end a session with their packet; after a FIN in one direction a SYN
    without ACK begins a new one. The rule looks back at what has happened in the session so far, so it runs row by row: one
    key's packets stream through a sorted partition and only one key's state is held.
    """
    names = [f.name for f in packets.schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"key": None}
        for frame in frames:
            numbers = []
            for row in frame[[*keys, "ts", "tcp_flags", "src"]].itertuples(index=False):
                key, (ts, flags, src) = tuple(row[: len(keys)]), row[len(keys) :]
                flags = flags or ""
                tcp = row[keys.index("protocol")] == "tcp"
                if key != state["key"]:
                    state = {"key": key, "number": 0, "last": ts, "fins": set(), "closed": False}
                elif state["closed"] or ts - state["last"] > idle or (tcp and state["fins"] and "S" in flags and "A" not in flags):
                    state |= {"number": state["number"] + 1, "fins": set(), "closed": False}
                state["last"] = ts
                if tcp:
                    if "F" in flags:
                        state["fins"].add(src)
                    state["closed"] = "R" in flags or len(state["fins"]) == 2
                numbers.append(state["number"])
            yield frame.assign(session=numbers)[[*names, "session"]]

    schema = T.StructType([*packets.schema.fields, T.StructField("session", T.LongType())])
    ordered = packets.repartition(*keys).sortWithinPartitions(*keys, "packet_index")
    return ordered.mapInPandas(run, schema)


def flows(packets: DataFrame, cap: int = 32) -> DataFrame:
    """One row for each session of keyed packets.

    The first cap packets are kept; later ones count and extend the end. The first packet's sender is the initiator.
    """
    keys = ["source_file", "protocol", "endpoint_a", "endpoint_b", "session"]
    by = Window.partitionBy(*keys).orderBy("packet_index")
    rows = packets.withColumns({"_n": F.row_number().over(by), "_src": F.first("src").over(by), "_dst": F.first("dst").over(by)})
    rows = rows.withColumn("_direction", F.when((F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst")), "fwd").otherwise("bwd"))
    kept = F.array_sort(F.collect_list(F.when(F.col("_n") <= cap, F.struct(F.col("_n").alias("n"), F.col("_direction").alias("d"), F.col("payload").alias("p"), F.coalesce("tcp_flags", F.lit("")).alias("f")))))
    grouped = rows.groupBy(*keys).agg(
        F.min_by("ts", "packet_index").alias("start_time"), F.max_by("ts", "packet_index").alias("end_time"), F.count("*").cast("int").alias("observed_packet_count"),
        F.first("_src").alias("initiator_endpoint"), F.first("_dst").alias("responder_endpoint"), kept.alias("_kept"),
    )
    flags = F.array_join(F.transform("_kept", lambda x: x["f"]), "")
    size = F.aggregate("_kept", F.lit(0).cast("long"), lambda a, x: a + F.length(x["p"]))
    out = grouped.withColumns(
        {
            "packet_count": F.size("_kept"), "payload_byte_length": size, "packet_directions": F.transform("_kept", lambda x: x["d"]),
            "packet_lengths": F.transform("_kept", lambda x: F.length(x["p"])), "bytes": F.aggregate("_kept", F.lit(b""), lambda a, x: F.concat(a, x["p"])),
        }
    )
    out = out.withColumns({"has_payload": F.col("payload_byte_length") > 0, "was_packet_truncated": F.col("observed_packet_count") > F.col("packet_count")})
    out = out.withColumn("connection_type", C.connection_type(F.col("protocol"), F.col("has_payload"), flags))
    key_text = F.concat_ws("|", "protocol", "endpoint_a", "endpoint_b")
    return out.withColumn("flow_id", C.flow_id(F.col("source_file"), key_text, F.col("session"), F.col("start_time"))).drop("_kept")
