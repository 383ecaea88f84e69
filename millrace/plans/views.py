"""The test tables seen as flows, packets and scored rows; the SQL beside each is the same view for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import table

_MAJOR = "CASE event_type WHEN 'signup' THEN 'botnet_malware' WHEN 'purchase' THEN 'scan' WHEN 'error' THEN 'dos_ddos' ELSE 'benign' END"
_SHARED = f"""
  event_id AS flow_id,
  concat('cap', CAST(user_id % 3 AS VARCHAR(9))) AS source_file,
  concat('10.0.0.', CAST(user_id AS VARCHAR(20))) AS host,
  concat('10.0.0.', CAST(user_id AS VARCHAR(20)), ':', CAST(1024 + event_id % 7 AS VARCHAR(9))) AS initiator_endpoint,
  concat('10.0.1.', CAST(event_id % 5 AS VARCHAR(9)), ':', CASE event_id % 3 WHEN 0 THEN '80' WHEN 1 THEN '443' ELSE '22' END) AS responder_endpoint,
  CASE event_type WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN ' Normal ' WHEN 'signup' THEN 'Bot' WHEN 'purchase' THEN 'PortScan' ELSE 'DoS Hulk' END AS source_label,
  {_MAJOR} AS major_label,
  CASE WHEN event_id % 7 = 0 THEN 'benign' WHEN event_id % 11 = 0 THEN 'scan' ELSE {_MAJOR} END AS pred_label,
  least(value / 100, CAST(1 AS DOUBLE)) AS major_prob,
  CASE event_id % 5 WHEN 0 THEN 'tcp_payload' WHEN 1 THEN 'tcp_reset_or_refused' WHEN 2 THEN 'tcp_control_only' WHEN 3 THEN 'udp_payload' ELSE 'tcp_empty' END AS connection_type,
  CASE WHEN event_id % 5 IN (0, 3) THEN CAST(floor(value * 37) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS payload_byte_length,
  CAST(1 + event_id % 40 AS INT) AS packet_count,
  event_id % 40 >= 32 AS was_packet_truncated,
  CASE WHEN event_id % 20 < 14 THEN 'train' WHEN event_id % 20 < 17 THEN 'val' ELSE 'test' END AS split,
  user_id, event_type, value
"""

FLOWS_SQL = f"""flows AS (
  SELECT *, least(initiator_endpoint, responder_endpoint) AS endpoint_a, greatest(initiator_endpoint, responder_endpoint) AS endpoint_b,
    start_us / CAST(1000000 AS DOUBLE) AS start_time
  FROM (SELECT {_SHARED}, epoch_us(ts) AS start_us FROM events))"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flows: users are hosts, event types labels, values scores."""
    micros = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS start_us"
    base = table(spark, sf_dir, "events").selectExpr(*[x.strip() for x in _split(_SHARED)], micros)
    return base.selectExpr("*", "least(initiator_endpoint, responder_endpoint) AS endpoint_a", "greatest(initiator_endpoint, responder_endpoint) AS endpoint_b", "start_us / CAST(1000000 AS DOUBLE) AS start_time")


def _split(text: str) -> list[str]:
    """Items of a select list: commas outside brackets part them."""
    items, depth, item = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            items.append(item)
            item = ""
        else:
            item += c
    return [*items, item]


DOCS_SQL = """docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, encode(d.text) AS bytes, l.quality, l.toxic,
    CASE WHEN d.doc_id % 20 < 14 THEN 'train' WHEN d.doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels, a split and the text's bytes."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    split = "CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split"
    return d.join(labels, "doc_id", "left").selectExpr("doc_id", "text", "lang", "source", "n_chars", "CAST(text AS BINARY) AS bytes", "quality", "toxic", split)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and bytes of docs(). Labels only say how often a row is there, so texts are joined to them only if an id has several."""
    several = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if several.isEmpty():
        return table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(text AS BINARY) AS bytes")
    return docs(spark, sf_dir).select("doc_id", "bytes")
