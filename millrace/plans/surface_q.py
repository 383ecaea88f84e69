"""Queries of sources, sinks, packets, sessions by closing flags, row rules and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions import tokens as T
from millrace.operators import asof, audit, gates, metrics, sessions, splits
from millrace.plans.registry import query
from millrace.plans.views import docs, flows
from millrace.session import shared_dir, table
from millrace.sources import sinks, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Sources and sinks: what is written is read again.

_ROWS = "SELECT flow_id, host, event_type, split, packet_count, payload_byte_length FROM flows"
_COLUMNS = ["flow_id", "host", "event_type", "split", "packet_count", "payload_byte_length"]


@query(_ROWS)
def snk_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "flows")
    flows(spark, sf_dir).select(*_COLUMNS).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@query(_ROWS + " WHERE split = 'val'")
def snk_split_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "splits")
    sinks.write_splits(flows(spark, sf_dir).select(*_COLUMNS), path)
    return spark.read.parquet(path).where("split = 'val'").select(*_COLUMNS)


@query("SELECT flow_id, major_prob AS prob_scan, 1 - major_prob AS prob_benign FROM flows")
def snk_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "predictions") + ".csv"
    probs = flows(spark, sf_dir).select("flow_id", F.array("major_prob", 1 - F.col("major_prob")).alias("p"))
    sinks.write_predictions(sinks.prediction_rows(probs, ["flow_id"], "p", ["scan", "benign"]), path)
    return spark.read.option("header", True).schema("flow_id long, prob_scan double, prob_benign double").csv(path)


@query(_ROWS)
def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "lines")
    df = flows(spark, sf_dir).select(*_COLUMNS)
    sinks.append_records(df, path)
    return tables.read_json_lines(spark, path, df._jdf.schema().toDDL())


@query("SELECT DISTINCT value, n FROM (SELECT event_type AS value, count(*) AS n FROM flows GROUP BY 1) UNION ALL SELECT DISTINCT value, n FROM (SELECT event_type AS value, count(*) AS n FROM flows GROUP BY 1)")
def snk_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "steps")
    report = audit.counts(flows(spark, sf_dir), "event_type")
    for _ in range(2):
        sinks.append_records(report, path)
    return tables.read_json_lines(spark, path, "value string, n long")


@query("SELECT event_type AS value, count(*) AS n FROM flows GROUP BY 1")
def snk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "report") + ".json"
    sinks.write_report(audit.counts(flows(spark, sf_dir), "event_type"), path)
    return spark.read.schema("value string, n long").option("multiLine", True).json(path)


_PAIRS = "(SELECT major_label AS t, pred_label AS g, count(*) AS n FROM flows GROUP BY ALL)"
_SHOWN = ["benign", "dos_ddos", "botnet_malware", "scan"]


@query("SELECT t AS true_label, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (g = '{x}'), 0) AS BIGINT) AS {x}" for x in _SHOWN) + f" FROM {_PAIRS} WHERE t IN ({', '.join(repr(x) for x in _SHOWN)}) GROUP BY 1")
def snk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, folder = flows(spark, sf_dir), _folder(spark, "metrics")
    summary, per, pairs = metrics.major_metrics(df, "major_label", "pred_label", _SHOWN), metrics.per_class(df, "major_label", "pred_label", _SHOWN), metrics.confusion(df, "major_label", "pred_label", _SHOWN)
    sinks.write_metrics(folder, summary, per, pairs, metrics.detection(df, "major_label", "pred_label"), _SHOWN)
    return spark.read.option("header", True).schema("true_label string, " + ", ".join(f"{x} long" for x in _SHOWN)).csv(f"{folder}/confusion.csv")


@query("SELECT flow_id FROM (SELECT flow_id, row_number() OVER (ORDER BY start_time, flow_id) AS n FROM flows) WHERE n <= 100")
def smp_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).orderBy("start_time", "flow_id").limit(100).select("flow_id")


@query("SELECT count(*) AS n FROM flows WHERE split = 'test' AND event_type = 'view'")
def src_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).where("split = 'test' AND event_type = 'view'").agg(F.count("*").alias("n"))


# Packets and sessions. Events are packets of their host's conversation.

_FLAGS = "CASE flow_id % 11 WHEN 3 THEN 'R' WHEN 5 THEN 'FA' WHEN 7 THEN 'FA' WHEN 8 THEN 'S' ELSE 'PA' END"
_PACKETS = """, k AS (SELECT flow_id AS i, start_time AS ts, source_file, host, {flags} AS f, flow_id % 2 = 0 AS forward, octet_length(encode(event_type)) AS size,
  row_number() OVER (PARTITION BY source_file, host ORDER BY flow_id) AS n FROM flows)"""
_IDLE = 12 * 3600.0


def _packets(spark: SparkSession, sf_dir: str, flags: str) -> DataFrame:
    forward = F.col("flow_id") % 2 == 0
    ends = lambda a, b: F.when(forward, a).otherwise(b)
    peer = F.lit("10.9.9.9")
    return sessions.keyed(
        flows(spark, sf_dir).select(
            "source_file", F.col("flow_id").alias("packet_index"), F.col("start_time").alias("ts"), F.lit("tcp").alias("protocol"), ends(F.col("host"), peer).alias("src_ip"), ends(peer, F.col("host")).alias("dst_ip"),
            ends(F.lit(1000), F.lit(80)).alias("src_port"), ends(F.lit(80), F.lit(1000)).alias("dst_port"), F.expr(flags).alias("tcp_flags"), F.encode("event_type", "utf-8").alias("payload"),
        )
    )


def _closing_sql(flags: str) -> str:
    """Sessions by a recursion over each key's packets: number, time of the last packet, directions with a FIN, closed."""
    return _PACKETS.format(flags=flags) + f""", s AS (WITH RECURSIVE r(source_file, host, n, i, number, ts, fa, fb, closed) AS (
  SELECT source_file, host, n, i, 0::BIGINT, ts, contains(f, 'F') AND forward, contains(f, 'F') AND NOT forward, contains(f, 'R') FROM k WHERE n = 1
  UNION ALL
  SELECT source_file, host, n, i, number, ts, (keep AND fa) OR (contains(f, 'F') AND forward), (keep AND fb) OR (contains(f, 'F') AND NOT forward),
    contains(f, 'R') OR (((keep AND fa) OR (contains(f, 'F') AND forward)) AND ((keep AND fb) OR (contains(f, 'F') AND NOT forward)))
  FROM (SELECT k.source_file, k.host, k.n, k.i, k.ts, k.f, k.forward, r.fa, r.fb,
      NOT (r.closed OR k.ts - r.ts > {_IDLE} OR ((r.fa OR r.fb) AND contains(k.f, 'S') AND NOT contains(k.f, 'A'))) AS keep,
      r.number + CASE WHEN r.closed OR k.ts - r.ts > {_IDLE} OR ((r.fa OR r.fb) AND contains(k.f, 'S') AND NOT contains(k.f, 'A')) THEN 1 ELSE 0 END AS number
    FROM r JOIN k ON k.source_file = r.source_file AND k.host = r.host AND k.n = r.n + 1))
  SELECT * FROM r) SELECT i AS packet, number AS session FROM s"""


def _closing(spark: SparkSession, sf_dir: str, flags: str) -> DataFrame:
    return sessions.closing_sessions(_packets(spark, sf_dir, flags), _IDLE).select(F.col("packet_index").alias("packet"), "session")


_RST = "CASE flow_id % 11 WHEN 3 THEN 'R' ELSE 'PA' END"
_FIN = "CASE flow_id % 11 WHEN 5 THEN 'FA' WHEN 8 THEN 'FA' ELSE 'PA' END"
_SYN = "CASE flow_id % 11 WHEN 5 THEN 'FA' WHEN 8 THEN 'S' WHEN 9 THEN 'SA' ELSE 'PA' END"


@query(_closing_sql(_RST))
def ses_close_rst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closing(spark, sf_dir, _RST)


@query(_closing_sql(_FIN))
def ses_close_fin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closing(spark, sf_dir, _FIN)


@query(_closing_sql(_SYN))
def ses_syn_after_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closing(spark, sf_dir, _SYN)


@query(_closing_sql(_FLAGS))
def ses_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closing(spark, sf_dir, _FLAGS)


_SESSIONS_SQL = _PACKETS.format(flags=_FLAGS) + f""", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source_file, host ORDER BY i) > {_IDLE} THEN 1 ELSE 0 END AS b FROM k),
z AS (SELECT *, CAST(sum(b) OVER (PARTITION BY source_file, host ORDER BY i) AS BIGINT) AS session FROM g), y AS (SELECT *, row_number() OVER (PARTITION BY source_file, host, session ORDER BY i) AS p, first(forward) OVER (PARTITION BY source_file, host, session ORDER BY i) AS f0 FROM z)"""


@query(_SESSIONS_SQL + """ SELECT source_file, host, session, CAST(least(count(*), 3) AS INTEGER) AS packet_count, CAST(count(*) AS INTEGER) AS observed_packet_count, CAST(sum(size) FILTER (p <= 3) AS BIGINT) AS payload_byte_length,
min_by(ts, i) AS start_time, max_by(ts, i) AS end_time, count(*) > 3 AS was_packet_truncated, string_agg(CASE WHEN forward = f0 THEN 'fwd' ELSE 'bwd' END, ',' ORDER BY i) FILTER (p <= 3) AS directions FROM y GROUP BY ALL""")
def ses_flow_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["source_file", "protocol", "endpoint_a", "endpoint_b"]
    rows = sessions.flows(sessions.idle_sessions(_packets(spark, sf_dir, _FLAGS), keys, "ts", "packet_index", _IDLE), 3)
    host = F.when(F.col("endpoint_a").startswith("10.9.9.9:"), C.host_of(F.col("endpoint_b"))).otherwise(C.host_of(F.col("endpoint_a")))
    return rows.select("source_file", host.alias("host"), "session", "packet_count", "observed_packet_count", "payload_byte_length", "start_time", "end_time", "was_packet_truncated", F.array_join("packet_directions", ",").alias("directions"))


@query(_SESSIONS_SQL + " SELECT source_file, host, session, i AS packet, CASE WHEN forward = f0 THEN 'fwd' ELSE 'bwd' END AS direction FROM y WHERE p <= 32")
def prj_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["source_file", "protocol", "endpoint_a", "endpoint_b"]
    numbered = sessions.idle_sessions(_packets(spark, sf_dir, _FLAGS), keys, "ts", "packet_index", _IDLE)
    by_key = sessions.flows(numbered, 32).select(*keys, "session", F.posexplode("packet_directions").alias("p", "direction"))
    from pyspark.sql import Window

    order = numbered.withColumn("p", F.row_number().over(Window.partitionBy(*keys, "session").orderBy("packet_index")) - 1).select(*keys, "session", "p", "packet_index", F.when(F.col("src_ip") == "10.9.9.9", F.col("dst_ip")).otherwise(F.col("src_ip")).alias("host"))
    return by_key.join(order, [*keys, "session", "p"]).select("source_file", "host", "session", F.col("packet_index").alias("packet"), "direction")


# The longer spans lie inside the text only if it is long enough.
_SPANS = [(0, 12), (24, 2), (26, 8), (34, 4), (50, 2)]


def _masked_sql() -> str:
    text = "hex(bytes)"
    for offset, size in _SPANS:
        text = f"CASE WHEN octet_length(bytes) >= {offset + size} THEN substr({text}, 1, {2 * offset}) || repeat('0', {2 * size}) || substr({text}, {2 * (offset + size) + 1}) ELSE {text} END"
    return text


@query(f", m AS (SELECT doc_id, bytes, {_masked_sql()} AS masked FROM docs) SELECT doc_id, md5(masked) AS masked FROM m", "docs")
def prs_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(F.hex(C.overlaid_zeros(F.col("bytes"), _SPANS))).alias("masked"))


# Labels and rows.

_FILES = "CASE flow_id % 3 WHEN 0 THEN '/data/mon/' || source_file || '.pcap' WHEN 1 THEN 'tue/' || source_file || '.a.pcap' ELSE source_file END"


@query(f", f AS (SELECT flow_id, {_FILES} AS p FROM flows), q AS (SELECT flow_id, regexp_extract(p, '([^/]*)/[^/]*$', 1) AS parent, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '[.][^.]*$', '') AS stem FROM f) SELECT flow_id, parent, stem AS filename, parent || '_' || stem AS both, 'fixed' AS static FROM q")
def prj_source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).select("flow_id", F.expr(_FILES).alias("source_file"))
    return df.select("flow_id", tables.source_label("parent").alias("parent"), tables.source_label("filename").alias("filename"), tables.source_label("parent_filename").alias("both"), tables.source_label("static", static="fixed").alias("static"))


@query("SELECT host AS source_ip, event_type AS flow_bytes_s, flow_id AS fwd_id FROM flows")
def prj_norm_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_normalized_names(flows(spark, sf_dir).select(F.col("host").alias(" Source IP"), F.col("event_type").alias("Flow Bytes/s "), F.col("flow_id").alias("Fwd-ID")))


_BYTES = [f"CASE WHEN flow_id % {k + 2} = 0 THEN 0 ELSE flow_id % 251 END" for k in range(6)]


@query(", v AS (SELECT flow_id, source_label, [" + ", ".join(f"CAST({b} AS INTEGER)" for b in _BYTES) + """] AS v FROM flows), n AS (SELECT *, coalesce(list_max(list_transform(range(1, 7), lambda k: CASE WHEN v[k] <> 0 THEN k ELSE 0 END)), 0) AS n FROM v)
SELECT 'set:packet:' || flow_id AS flow_id, trim(source_label) AS source_label, CAST(n AS INTEGER) AS payload_byte_length, array_to_string(list_transform(v[1:n], lambda x: format('{:02x}', x)), '') AS bytes FROM n WHERE n > 0""")
def prj_payload_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = flows(spark, sf_dir).select("flow_id", F.col("source_label").alias("label"), *[F.expr(b).alias(f"payload_byte_{k + 1}") for k, b in enumerate(_BYTES)])
    return tables.payload_flows(wide, "set", "flow_id").select("flow_id", "source_label", "payload_byte_length", F.lower(F.hex("bytes")).alias("bytes"))


@query(", r AS (SELECT flow_id, CASE flow_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE source_label END AS label FROM flows) SELECT flow_id, trim(label) AS label FROM r WHERE trim(label) <> ''")
def jn_index_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = flows(spark, sf_dir).select(F.col("flow_id").alias("Flow ID"), F.expr("CASE flow_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE source_label END").alias(" Label "))
    return asof.label_records(raw, {}, ("label",)).select("flow_id", "label")


@query("SELECT DISTINCT doc_id, sha1(text) AS bytes_sha1, sha1(source) AS source_sha1 FROM docs", "docs")
def prj_hash_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.bytes_digest(F.col("bytes")).alias("bytes_sha1"), C.bytes_digest(F.encode("source", "utf-8")).alias("source_sha1"))


@query(""", h AS (SELECT doc_id, hex(bytes[1:510]) AS h FROM docs), i AS (SELECT doc_id, list_concat([2], list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS INTEGER) + 8), [3]) AS ids FROM h)
SELECT doc_id, sha1(unhex(rpad(array_to_string(list_transform(ids, lambda v: format('{:02x}{:02x}', v % 256, v // 256)), ''), 2048, '0'))) AS digest FROM i""", "docs")
def prj_first_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.first_window_digest(T.byte_ids(F.col("bytes"))).alias("digest"))


@query("SELECT flow_id, host AS ends_host, event_type AS ends_more_kind, value AS score FROM flows")
def prj_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.flat(flows(spark, sf_dir).select("flow_id", F.struct("host", F.struct(F.col("event_type").alias("kind")).alias("more")).alias("ends"), F.col("value").alias("score")))


@query("SELECT flow_id, 'train' AS part FROM flows WHERE split = 'train' UNION ALL SELECT flow_id, 'rest' FROM flows WHERE split <> 'train'")
def set_union_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    parts = [df.where(c).select("flow_id", F.lit(n).alias("part")) for n, c in (("train", "split = 'train'"), ("rest", "split <> 'train'"))]
    return parts[0].unionByName(parts[1])


@query("SELECT (SELECT count(*) FROM flows WHERE split = 'val' AND major_label = 'botnet_malware') < 100000000 OR (SELECT count(*) FROM flows WHERE split = 'test' AND major_label = 'botnet_malware') < 100000000 AS low")
def val_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = gates.any_low(flows(spark, sf_dir), "major_label", ["botnet_malware"], 100_000_000)
    return spark.range(1).select(F.lit(low).alias("low"))


@query("SELECT 'missing: missing' AS wrong UNION ALL SELECT 'host: string, not bigint' UNION ALL SELECT 'split: ' || count(*) FILTER (split <> 'train') || ' rows are not train' FROM flows")
def val_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = gates.schema_gate(flows(spark, sf_dir), {"missing": "int", "host": "bigint", "flow_id": "bigint"}, {"split": "train"})
    return spark.createDataFrame([(w,) for w in wrong], "wrong string")


# Tokens.


def _names_sql() -> str:
    plain = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    contexts = f"flatten(list_transform({plain(T.CONTEXT_NAMES)}, lambda n: list_transform({plain(T.CONTEXT_STEPS)}, lambda s: '[CTX_' || n || '_' || s || ']')))"
    return f"list_concat({plain(T.SPECIAL)}, list_transform(range(0, 256), lambda k: format('b_{{:02x}}', k)), list_transform({plain(T.CONNECTIONS)}, lambda c: '[CONN_' || upper(c) || ']'), {contexts})"


@query(f"SELECT CAST(k - 1 AS INTEGER) AS id, names[k] AS token FROM (SELECT names, unnest(range(1, len(names) + 1)) AS k FROM (SELECT {_names_sql()} AS names))", "")
def tok_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(T.vocabulary())), "id int, token string")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE md5(text) END AS parsed FROM docs", "docs")
def tok_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" 0x"), F.hex("bytes"))).when(F.col("doc_id") % 3 == 1, F.regexp_replace(F.lower(F.hex("bytes")), "(....)", "$1 ")).otherwise(F.lit("0xzz"))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.parsed_hex(text)).alias("parsed"))


# Scalar functions.


@query(", e AS (SELECT event_id AS flow_id, ts FROM events) SELECT flow_id, CASE flow_id % 3 WHEN 0 THEN epoch(date_trunc('minute', ts)) WHEN 1 THEN epoch(date_trunc('second', ts)) END AS seconds FROM e")
def fn_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "d/M/yyyy H:mm")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("no time")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("flow_id"), asof.label_time(text).alias("seconds"))


@query("SELECT flow_id, start_time + CASE WHEN floor(CAST(floor(start_time) AS BIGINT) % 86400 / 3600) < CASE source_file WHEN 'cap0' THEN 12 WHEN 'cap1' THEN 8 ELSE 0 END THEN 43200 ELSE 0 END AS seconds FROM flows")
def fn_date_afternoon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", asof.afternoon(F.col("start_time"), F.col("source_file"), {"cap0": 12, "cap1": 8}).alias("seconds"))


@query("SELECT flow_id, CAST(floor((start_time - 10800) / 3600) AS BIGINT) AS hour, CAST(start_us // 1000000 AS BIGINT) AS seconds FROM flows")
def fn_date_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", F.floor((F.col("start_time") - 3 * 3600) / 3600).alias("hour"), F.floor(F.col("start_us") / 1_000_000).alias("seconds"))


@query("SELECT flow_id, lower(trim(source_label)) AS a, replace(host, '.', '_') AS b, split_part(host, '.', 4) AS c, starts_with(event_type, 'v') AS d, host || '/' || lpad(CAST(packet_count AS VARCHAR), 3, '0') AS e FROM flows")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(
        "flow_id", F.lower(F.trim("source_label")).alias("a"), F.replace("host", F.lit("."), F.lit("_")).alias("b"), F.substring_index("host", ".", -1).alias("c"), F.col("event_type").startswith("v").alias("d"),
        F.format_string("%s/%03d", "host", "packet_count").alias("e"),
    )


@query("SELECT doc_id, regexp_matches(text, '(?i)\\bTHE\\b') AS has, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM docs", "docs")
def fn_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.regexp_like("text", F.lit(r"(?i)\bTHE\b")).alias("has"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"))


@query("SELECT doc_id, sha1(text) AS digest, md5(hex(bytes)) AS text_of, octet_length(unhex(hex(bytes))) AS back FROM docs", "docs")
def fn_hash_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha1("bytes").alias("digest"), F.md5(F.hex("bytes")).alias("text_of"), F.octet_length(F.try_to_binary(F.hex("bytes"), F.lit("hex"))).cast("long").alias("back"))


@query("SELECT flow_id, CAST(floor(-value / 7) AS BIGINT) AS a, CAST(ceil(value / 7) AS BIGINT) AS b, round(sqrt(abs(value)), 9) AS c, round(ln(1 + abs(value)), 9) AS d, least(value, 5.0::DOUBLE) AS e FROM flows")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return flows(spark, sf_dir).select("flow_id", F.floor(-v / 7).alias("a"), F.ceil(v / 7).alias("b"), F.round(F.sqrt(F.abs(v)), 9).alias("c"), F.round(F.log1p(F.abs(v)), 9).alias("d"), F.least(v, F.lit(5.0)).alias("e"))


_LOGITS = ("value / 50", "-value / 80", "(flow_id % 5) / CAST(3 AS DOUBLE)")


@query(f", x AS (SELECT flow_id, {_LOGITS[0]} AS a, {_LOGITS[1]} AS b, {_LOGITS[2]} AS c FROM flows), e AS (SELECT *, exp(a) + exp(b) + exp(c) AS z FROM x) SELECT flow_id, round(exp(a) / z, 9) AS p0, round(exp(b) / z, 9) AS p1, round(exp(c) / z, 9) AS p2, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS best, round(1 / (1 + exp(-a)), 9) AS sigmoid FROM e")
def fn_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.decoded(F.array(*map(F.expr, _LOGITS)), ["a", "b", "c"])
    rows = flows(spark, sf_dir).select("flow_id", F.expr(_LOGITS[0]).alias("x"), d.alias("d"))
    return rows.select("flow_id", *[F.round(F.col("d.probs")[k], 9).alias(f"p{k}") for k in range(3)], F.col("d.label").alias("best"), F.round(1 / (1 + F.exp(-F.col("x"))), 9).alias("sigmoid"))


_WORDS_SQL = "string_split(event_type || ',' || connection_type || ',' || event_type, ',')"


@query(f", w AS (SELECT flow_id, {_WORDS_SQL} AS w FROM flows) SELECT flow_id, array_to_string(w[2:3], '|') AS part, array_to_string(list_sort(list_distinct(w)), '|') AS kinds, list_contains(w, 'view') AS has, array_to_string(list_concat(w, w[1:1]), '|') AS more FROM w")
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split(F.concat_ws(",", "event_type", "connection_type", "event_type"), ",")
    bar = lambda c: F.array_join(c, "|")
    return flows(spark, sf_dir).select("flow_id", bar(F.slice(w, 2, 2)).alias("part"), bar(F.array_sort(F.array_distinct(w))).alias("kinds"), F.array_contains(w, "view").alias("has"), bar(F.flatten(F.array(w, F.slice(w, 1, 1)))).alias("more"))


@query("SELECT host, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(DISTINCT event_type) AS kinds FROM flows GROUP BY 1")
def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = flows(spark, sf_dir).groupBy("host", "event_type").agg(F.count("*").alias("n")).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    of = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(f"{k}s")
    return counts.select("host", of("view"), of("click"), F.size("m").cast("long").alias("kinds"))


@query("SELECT flow_id, CAST(packet_count AS INTEGER) AS n, host AS h FROM flows")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct(F.col("packet_count").alias("n"), F.col("host").alias("h")))
    return flows(spark, sf_dir).select("flow_id", F.from_json(text, "n int, h string").alias("j")).select("flow_id", "j.*")


@query("SELECT doc_id, md5(hex(bytes[3:])) AS tail, CASE WHEN octet_length(bytes) >= 2 THEN CAST('0x' || hex(bytes[1:2]) AS INTEGER) END AS word FROM docs", "docs")
def fn_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    two: Column = F.when(F.octet_length("bytes") >= 2, F.conv(F.hex(F.substring("bytes", 1, 2)), 16, 10).cast("int"))
    return docs(spark, sf_dir).select("doc_id", F.md5(F.hex(F.substring("bytes", F.lit(3), F.greatest(F.length("bytes") - 2, F.lit(0))))).alias("tail"), two.alias("word"))


@query("SELECT flow_id, flow_id & 8191 AS low, (flow_id >> 4) & 15 AS nibble, (flow_id & 4) <> 0 AS flag FROM flows")
def fn_bitwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("flow_id")
    return flows(spark, sf_dir).select("flow_id", i.bitwiseAND(0x1FFF).alias("low"), F.shiftright(i, 4).bitwiseAND(15).alias("nibble"), (i.bitwiseAND(4) != 0).alias("flag"))


@query("SELECT flow_id, label FROM (SELECT flow_id, major_label AS label, row_number() OVER (PARTITION BY major_label ORDER BY sha1('7:' || flow_id), flow_id) AS n FROM flows) WHERE n <= 200")
def smp_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.class_cap(flows(spark, sf_dir), "major_label", "flow_id", 200, 7).select("flow_id", F.col("major_label").alias("label"))
