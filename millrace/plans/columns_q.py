"""Queries of column expressions, tokens, codebooks, sets of flows and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions import labels as L
from millrace.functions import tokens as T
from millrace.operators import codebook
from millrace.operators.graph import connected_components
from millrace.plans.registry import query
from millrace.plans.views import docs, flows, texts
from millrace.session import table


@query("SELECT flow_id, initiator_endpoint AS endpoint, least(initiator_endpoint, responder_endpoint) AS a, greatest(initiator_endpoint, responder_endpoint) AS b FROM flows")
def prj_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = C.endpoint_pair(F.col("initiator_endpoint"), F.col("responder_endpoint"))
    end = C.endpoint(F.col("host"), 1024 + F.col("flow_id") % 7)
    return flows(spark, sf_dir).select("flow_id", end.alias("endpoint"), pair["a"].alias("a"), pair["b"].alias("b"))


_ENDS = "CASE flow_id % 5 WHEN 0 THEN initiator_endpoint WHEN 1 THEN host WHEN 2 THEN '[fe80::1]:443' WHEN 3 THEN '' ELSE NULL END"


@query(f", e AS (SELECT flow_id, {_ENDS} AS e FROM flows) SELECT flow_id, CASE WHEN contains(coalesce(e, ''), ':') THEN regexp_extract(e, '^(.*):[^:]*$', 1) ELSE coalesce(e, '') END AS host, CASE WHEN contains(coalesce(e, ''), ':') THEN list_last(string_split(e, ':')) ELSE '' END AS port FROM e")
def prj_host_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr(_ENDS)
    return flows(spark, sf_dir).select("flow_id", C.host_of(e).alias("host"), C.port_of(e).alias("port"))


@query(f", e AS (SELECT flow_id, {_ENDS} AS e FROM flows) SELECT flow_id, CASE WHEN coalesce(e, '') = '' THEN 'unknown' WHEN e LIKE '[%]%' THEN regexp_extract(e, '^\\[([^\\]]*)\\]', 1) WHEN contains(e, ':') THEN regexp_extract(e, '^(.*):[^:]*$', 1) ELSE e END AS host FROM e")
def prj_host_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", C.host_of(F.expr(_ENDS), "unknown").alias("host"))


@query("SELECT flow_id, split_part(responder_endpoint, ':', 1) AS host, CAST(split_part(responder_endpoint, ':', 2) AS INTEGER) AS port FROM flows")
def prj_parse_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.endpoint_parts(F.col("responder_endpoint"))
    return flows(spark, sf_dir).select("flow_id", p["host"].alias("host"), p["port"].alias("port"))


_PROTO = "CASE flow_id % 6 WHEN 0 THEN '6' WHEN 1 THEN '6.0' WHEN 2 THEN ' TCP' WHEN 3 THEN '17' WHEN 4 THEN 'icmp' ELSE NULL END"


@query(f", p AS (SELECT flow_id, lower(trim(coalesce({_PROTO}, ''))) AS p FROM flows) SELECT flow_id, CASE TRY_CAST(p AS DOUBLE) WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE p END AS protocol FROM p")
def prj_norm_proto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", C.protocol_name(F.expr(_PROTO)).alias("protocol"))


@query("SELECT flow_id, concat(" + ", ".join(f"CASE WHEN (flow_id & {1 << k}) <> 0 THEN '{c}' ELSE '' END" for k, c in enumerate(C.FLAG_LETTERS)) + ") AS flags FROM flows")
def prs_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", C.tcp_flag_letters(F.col("flow_id")).alias("flags"))


@query("SELECT concat('cap_', substr(sha1(concat_ws('|', 'data/cap.pcap', host, CAST(flow_id % 9 AS VARCHAR), format('{:.6f}', start_time))), 1, 16), '_', lpad(CAST(flow_id % 9 AS VARCHAR), 6, '0')) AS id FROM flows")
def prj_flow_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(C.flow_id(F.lit("data/cap.pcap"), F.col("host"), F.col("flow_id") % 9, F.col("start_time")).alias("id"))


_FLAGS = "CASE flow_id % 4 WHEN 0 THEN 'SR' WHEN 1 THEN 'S' WHEN 2 THEN 'AP' ELSE '' END"
_PROTO2 = "CASE flow_id % 7 WHEN 0 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'tcp' END"


@query(f", f AS (SELECT flow_id, {_FLAGS} AS f, {_PROTO2} AS p, payload_byte_length > 0 AS h FROM flows) SELECT flow_id, CASE WHEN p = 'udp' THEN CASE WHEN h THEN 'udp_payload' ELSE 'udp_empty' END WHEN p <> 'tcp' THEN p || '_other' WHEN h THEN 'tcp_payload' WHEN contains(f, 'R') THEN 'tcp_reset_or_refused' WHEN contains(f, 'S') THEN 'tcp_handshake_only' WHEN f <> '' THEN 'tcp_control_only' ELSE 'tcp_empty' END AS kind FROM f")
def prj_conn_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", C.connection_type(F.expr(_PROTO2), F.col("payload_byte_length") > 0, F.expr(_FLAGS)).alias("kind"))


def _bucket_sql(v: str, bounds: tuple[int, ...]) -> str:
    lows = (1, *(b + 1 for b in bounds))
    return " ".join(f"WHEN {v} <= {b} THEN '{low}-{b}'" for low, b in zip(lows, bounds, strict=False)) + f" ELSE '>{bounds[-1]}' END"


@query(f"SELECT flow_id, CASE WHEN payload_byte_length <= 0 THEN '0' {_bucket_sql('payload_byte_length', (31, 127, 511, 2047, 8191))} AS payload, CASE WHEN packet_count <= 0 THEN '0' WHEN packet_count <= 2 THEN CAST(packet_count AS VARCHAR) {_bucket_sql('packet_count', (4, 8, 16, 32, 64))} AS packets FROM flows")
def prj_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", C.payload_bucket(F.col("payload_byte_length")).alias("payload"), C.packet_count_bucket(F.col("packet_count")).alias("packets"))


_LENGTHS = "CASE flow_id % 3 WHEN 0 THEN {0}CAST(flow_id % 70 AS INT){1} WHEN 1 THEN {0}CAST(flow_id % 70 AS INT), 600, 1600{1} ELSE {0}1, 2, 3, 4, 5, 6, 7, 8, CAST(flow_id % 70 AS INT){1} END"
_DIRS = "CASE flow_id % 3 WHEN 0 THEN {0}'fwd'{1} WHEN 1 THEN {0}'fwd', 'BWD', 'x'{1} ELSE {0}'f', 'client', 'server'{1} END"


@query(f", s AS (SELECT flow_id, connection_type AS c, payload_byte_length AS p, {_LENGTHS.format('[', ']')} AS l, {_DIRS.format('[', ']')} AS d FROM flows), b AS (SELECT *, list_transform(l[1:8], lambda v: CASE {_bucket_sql('v', (63, 127, 511, 1500))}) AS bins, CASE WHEN len(l) <= 2 THEN CAST(len(l) AS VARCHAR) {_bucket_sql('len(l)', (4, 8, 16, 32, 64))} AS n FROM s) " +
f"SELECT flow_id, substr(sha1('(''' || c || ''', ''' || n || ''', ''' || (CASE WHEN p <= 0 THEN '0' {_bucket_sql('p', (31, 127, 511, 2047, 8191))}) || ''', ''' || array_to_string(list_transform(d, lambda x: CASE WHEN lower(x) IN ('fwd', 'forward', 'client') THEN 'f' WHEN lower(x) IN ('bwd', 'backward', 'server') THEN 'b' ELSE '?' END), '') || ''', (''' || array_to_string(bins, ''', ''') || '''' || CASE WHEN len(bins) = 1 THEN ',' ELSE '' END || '))'), 1, 16) AS shape FROM b")
def prj_submode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths, dirs = F.expr(_LENGTHS.format("array(", ")")), F.expr(_DIRS.format("array(", ")"))
    return flows(spark, sf_dir).select("flow_id", C.shape_signature(F.col("connection_type"), lengths, F.col("payload_byte_length"), dirs).alias("shape"))


@query("SELECT host, CAST(CAST('0x' || substr(sha1(host), 1, 12) AS UBIGINT) AS BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT host FROM flows)")
def prj_stable_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("host", C.stable_bucket(F.col("host")).alias("bucket")).distinct()


@query("SELECT doc_id, sha1(text) AS digest FROM docs", "docs")
def prj_bytes_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", C.bytes_digest(F.col("bytes")).alias("digest"))


@query("SELECT flow_id, round(ln(1 + packet_count), 9) AS a, round(ln(1 + CASE WHEN payload_byte_length > 0 THEN payload_byte_length ELSE 0 END), 9) AS b FROM flows")
def prj_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = C.log_features(["packet_count", "p"])
    return flows(spark, sf_dir).withColumn("p", F.expr("nullif(payload_byte_length, 0)")).select("flow_id", x.alias("x")).select("flow_id", F.round(F.col("x")[0], 9).alias("a"), F.round(F.col("x")[1], 9).alias("b"))


@query("SELECT doc_id, k AS n, lower(hex(piece)) AS piece FROM (SELECT doc_id, unnest([1, 2, 3]) AS k, unnest([bytes[1:2], bytes[3:7], bytes[8:]]) AS piece FROM docs)", "docs")
def prj_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.octet_length("bytes"), F.lit(0))
    lengths = F.array(F.least(n, F.lit(2)), F.least(F.greatest(n - 2, F.lit(0)), F.lit(5)), F.greatest(n - 7, F.lit(0)))
    pieces = C.packet_chunks(F.coalesce("bytes", F.lit(b"")), lengths)
    return docs(spark, sf_dir).select("doc_id", F.posexplode(pieces).alias("n", "piece")).select("doc_id", (F.col("n") + 1).alias("n"), F.lower(F.hex("piece")).alias("piece"))


@query("SELECT flow_id, CASE flow_id % 3 WHEN 0 THEN initiator_endpoint WHEN 1 THEN responder_endpoint ELSE source_label END AS bytes FROM flows")
def prj_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(F.lit("payload_only"), F.lit("full_packet"), F.lit("masked_header_packet")), (F.col("flow_id") % 3 + 1).cast("int"))
    return flows(spark, sf_dir).select("flow_id", C.view_bytes(names, F.col("initiator_endpoint"), F.col("responder_endpoint"), F.col("source_label")).alias("bytes"))


@query("SELECT flow_id, v.view, CASE v.view WHEN 'payload_only' THEN payload_byte_length ELSE packet_count END AS n FROM flows, (VALUES ('payload_only'), ('full_packet')) v(view)")
def prj_flow_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(F.struct(F.lit("payload_only").alias("view"), F.col("payload_byte_length").alias("n")), F.struct(F.lit("full_packet").alias("view"), F.col("packet_count").cast("long").alias("n")))
    return flows(spark, sf_dir).select("flow_id", F.explode(rows).alias("r")).select("flow_id", "r.*")


@query("SELECT flow_id, CAST(greatest(0, CASE WHEN (flow_id // 7) % 3 > 0 THEN 4 WHEN flow_id % 2 > 0 THEN 2 WHEN flow_id % 5 > 0 THEN 1 ELSE 0 END) AS INTEGER) AS n FROM flows")
def prj_trim_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.col("flow_id") % 5, F.col("flow_id") % 2, F.lit(0).cast("long"), F.floor(F.col("flow_id") / 7) % 3, F.lit(0).cast("long"))
    return flows(spark, sf_dir).select("flow_id", C.trimmed_payload_length(values).alias("n"))


@query("SELECT flow_id FROM flows WHERE payload_byte_length > 0")
def flt_empty_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).where("payload_byte_length > 0").select("flow_id")


@query("SELECT host, min(n) AS kept, max(c) AS observed FROM (SELECT host, least(count(*) OVER (PARTITION BY host), 32) AS n, count(*) OVER (PARTITION BY host) AS c FROM flows) GROUP BY host")
def flt_packet_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("host").orderBy("flow_id")
    rows = flows(spark, sf_dir).select("host", F.row_number().over(by).alias("n"))
    return rows.groupBy("host").agg(F.count_if(F.col("n") <= 32).alias("kept"), F.count("*").alias("observed"))


@query("SELECT major_label, count(*) AS n FROM flows WHERE event_type = 'error' AND split = 'train' GROUP BY 1")
def flt_view_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).where("event_type = 'error' AND split = 'train'").groupBy("major_label").agg(F.count("*").alias("n"))


@query("SELECT flow_id, CASE major_label " + " ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(L.MAJORS)) + " END AS id FROM flows")
def prj_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", L.major_id(F.col("major_label")).alias("id"))


@query("SELECT flow_id, major_label, event_type FROM flows ORDER BY major_label, start_time, flow_id")
def ord_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).orderBy("major_label", "start_time", "flow_id").select("flow_id", "major_label", "event_type")


# Tokens and codebooks.


_IDS = ", i AS (SELECT doc_id, list_transform(regexp_extract_all(hex(bytes), '..'), lambda h: CAST('0x' || h AS INTEGER) + 8) AS ids FROM docs)"


def _digest(ids: Column) -> Column:
    """The ids, comma-joined, as MD5."""
    return F.md5(F.array_join(ids, ","))


@query(_IDS + " SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ',')) AS ids FROM i", "docs")
def tok_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", T.byte_ids(F.col("bytes")).alias("ids"))
    return rows.select("doc_id", F.size("ids").alias("n"), _digest(F.col("ids")).alias("ids"))


@query("SELECT flow_id, CASE connection_type WHEN 'tcp_payload' THEN 264 WHEN 'tcp_control_only' THEN 265 WHEN 'tcp_reset_or_refused' THEN 266 WHEN 'udp_payload' THEN 267 ELSE 268 END AS token FROM flows")
def tok_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", T.connection_token(F.col("connection_type")).alias("token"))


@query("SELECT flow_id, CASE WHEN payload_byte_length <= 0 THEN 0 WHEN payload_byte_length = 1 THEN 1 WHEN payload_byte_length < 5 THEN 2 WHEN payload_byte_length < 10 THEN 3 WHEN payload_byte_length < 20 THEN 4 WHEN payload_byte_length < 50 THEN 5 ELSE 6 END AS step FROM flows")
def tok_ctx_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", T.context_step(F.col("payload_byte_length")).alias("step"))


@query(_IDS + """, w AS (SELECT doc_id, ids, unnest(range(0, CAST(greatest(ceil((len(ids) - 510) / 384.0), 0) + 1 AS BIGINT))) AS k FROM i)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, CAST(k AS INTEGER) AS window, CAST(len(ids[k * 384 + 1:k * 384 + 510]) AS INTEGER) AS size, md5(array_to_string(ids[k * 384 + 1:k * 384 + 510], ',')) AS ids FROM w""", "docs")
def tok_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", F.octet_length("bytes").alias("n"), F.posexplode(T.windows(T.byte_ids(F.col("bytes")))).alias("window", "ids"))
    return rows.select("doc_id", "n", "window", F.size("ids").alias("size"), _digest(F.col("ids")).alias("ids"))


@query(_IDS + """, e AS (SELECT doc_id, list_concat([2], ids[1:510], [3]) AS body FROM i)
SELECT doc_id, CAST(len(body) AS INTEGER) AS used, 512 AS size, md5(array_to_string(list_concat(body, list_transform(range(0, 512 - len(body)), lambda k: 0)), ',')) AS ids FROM e""", "docs")
def tok_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.encoded(T.byte_ids(F.col("bytes")))
    out = docs(spark, sf_dir).select("doc_id", e.alias("e"))
    return out.select("doc_id", F.aggregate("e.attention_mask", F.lit(0), lambda a, x: a + x).alias("used"), F.size("e.input_ids").alias("size"), _digest(F.col("e.input_ids")).alias("ids"))


_ASCII_IDS = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: CAST('0x' || h AS INTEGER) + 8)"


@query(f"""SELECT flow_id, array_to_string(list_concat([CASE connection_type WHEN 'tcp_payload' THEN 264 WHEN 'tcp_control_only' THEN 265 WHEN 'tcp_reset_or_refused' THEN 266 WHEN 'udp_payload' THEN 267 ELSE 268 END],
[5], {_ASCII_IDS.format("initiator_endpoint")}, [7], [6], {_ASCII_IDS.format("event_type")}, [7]), ',') AS ids FROM flows""")
def tok_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.array(F.encode("initiator_endpoint", "utf-8"), F.encode("event_type", "utf-8"))
    ids = T.flow_ids(F.array(T.connection_token(F.col("connection_type"))), F.array(F.lit("fwd"), F.lit("bwd")), pieces)
    return flows(spark, sf_dir).select("flow_id", F.array_join(ids, ",").alias("ids"))


_CHUNKS = ", c AS (SELECT doc_id, quality, lower(hex(bytes[k * 4 + 1:k * 4 + 4])) AS pattern_hex FROM (SELECT doc_id, quality, bytes, unnest(range(0, octet_length(bytes) // 4)) AS k FROM docs))"


@query(_CHUNKS + ", n AS (SELECT pattern_hex, count(*) AS count FROM c WHERE pattern_hex <> '00000000' GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 256) SELECT pattern_hex, count, CAST(row_number() OVER (ORDER BY count DESC, pattern_hex) - 1 AS INTEGER) AS place FROM n", "docs")
def agg_freq_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebook.frequent(docs(spark, sf_dir), "bytes")


@query(_CHUNKS + """, d AS (SELECT DISTINCT doc_id, coalesce(CAST(quality AS VARCHAR), 'none') AS label, pattern_hex FROM c WHERE pattern_hex <> '00000000'), t AS (SELECT count(*) AS total FROM docs),
g AS (SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS label, count(*) / CAST((SELECT total FROM t) AS DOUBLE) AS share FROM docs GROUP BY 1), k AS (SELECT pattern_hex, count(*) AS count FROM d GROUP BY 1 HAVING count(*) >= 2),
n AS (SELECT pattern_hex, label, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT k.pattern_hex, k.count, g.label, abs(coalesce(n.n, 0) / CAST(k.count AS DOUBLE) - g.share) AS score FROM k CROSS JOIN g LEFT JOIN n ON n.pattern_hex = k.pattern_hex AND n.label = g.label),
b AS (SELECT *, row_number() OVER (PARTITION BY pattern_hex ORDER BY score DESC, label) AS i FROM s), z AS (SELECT pattern_hex, count, score, label FROM b WHERE i = 1 ORDER BY score DESC, count DESC, pattern_hex LIMIT 256)
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, count DESC, pattern_hex) - 1 AS INTEGER) AS place FROM z""", "docs")
def agg_label_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir).withColumn("label", F.coalesce(F.col("quality").cast("string"), F.lit("none")))
    return codebook.lifted(df, "bytes", "label")


@query(_CHUNKS + " SELECT doc_id, count(*) AS n FROM c WHERE pattern_hex <> '00000000' GROUP BY 1", "docs")
def agg_chunk_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(codebook.chunks(F.col("bytes"), 4)).cast("long").alias("n")).where("n > 0")


@query(_CHUNKS.replace("octet_length(bytes) // 4", "CAST(ceil(octet_length(bytes) / 4.0) AS BIGINT)") + " SELECT doc_id, CAST(sum(CASE WHEN pattern_hex = '74686520' THEN 1 ELSE length(pattern_hex) // 2 END) AS INTEGER) AS n FROM c GROUP BY 1", "docs")
def tok_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir).where("octet_length(bytes) > 0")
    return df.select("doc_id", F.size(codebook.encoded(df, "bytes", [("74686520", "[SCE_0000]")], 4)).alias("n"))


@query(", t AS (SELECT regexp_extract_all(lower(hex(bytes)), '..') AS b FROM docs), g AS (SELECT unnest(list_transform(list_zip(b[1:len(b) - 1], b[2:]), lambda p: p[1] || p[2])) AS term FROM t) SELECT term, count(*) AS n FROM g WHERE term IS NOT NULL GROUP BY 1", "docs")
def feat_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.explode(T.ngrams(F.col("bytes"), 2, 2)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(""", b AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS b FROM (SELECT doc_id, regexp_extract_all(lower(hex(bytes)), '..') AS l FROM docs)),
s AS (SELECT doc_id, b, lead(b, 1) OVER w AS c, lead(b, 2) OVER w AS d, lead(b, 3) OVER w AS e FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY k)), g AS (SELECT doc_id, unnest([b, b || c, b || c || d, b || c || d || e]) AS term FROM s), f AS (SELECT doc_id, term, count(*) AS tf FROM g WHERE term IS NOT NULL GROUP BY ALL),
d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM f GROUP BY 1 ORDER BY total DESC, term LIMIT 200000), w AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + df)) + 1) AS w FROM f JOIN d USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""", "docs")
def feat_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    millionths = F.floor(F.col("weight") * 1e6 + 0.5).cast("double")
    return T.tfidf(texts(spark, sf_dir), "doc_id", "bytes").select("doc_id", "term", (millionths / 1e6).alias("weight"))


# Components.


@query(""", e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS m FROM docs) a JOIN docs b ON a.m = b.doc_id WHERE a.doc_id <> b.doc_id
UNION SELECT doc_id, doc_id - 20 FROM docs WHERE doc_id % 40 >= 20 AND doc_id % 3 = 0), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (WITH RECURSIVE r(node, c) AS (SELECT DISTINCT u, u FROM s UNION SELECT s.v, r.c FROM r JOIN s ON r.node = s.u) SELECT * FROM r) SELECT node, min(c) AS component FROM r GROUP BY node""", "docs")
def gph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", C.bytes_digest(F.col("bytes")).alias("h"))
    least = d.groupBy("h").agg(F.min("doc_id").alias("v"))
    stars = d.join(least, "h").select(F.col("doc_id").alias("u"), "v")
    near = d.where("doc_id % 40 >= 20 AND doc_id % 3 = 0").select(F.col("doc_id").alias("u"), (F.col("doc_id") - 20).alias("v"))
    return connected_components(stars.unionAll(near))


# Sources that are plain table scans.


@query("SELECT flow_id, event_type, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) AS k FROM (SELECT event_id AS flow_id, event_type, props FROM events)", "")
def src_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("flow_id"), "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL", "")
def src_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
