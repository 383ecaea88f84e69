"""Queries of window operators, sessions and as-of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import asof, sessions, splits, summary, windows
from millrace.plans.registry import query
from millrace.plans.views import flows

HOUR = 3600


def _labels_sql(w: str) -> str:
    return f"""SELECT {w} AS window_seconds, source_file, host, CAST(floor(start_time / {w}) * {w} AS BIGINT) AS window_start, count(*) AS flow_count,
      count(*) FILTER (major_label <> 'benign') AS attack_count, count(*) FILTER (major_label <> 'benign' AND major_prob >= 0.5) AS high_risk_count, max(major_prob) AS max_prob
      FROM flows GROUP BY ALL"""


@query(f""", w AS ({_labels_sql('3600')} UNION ALL {_labels_sql('21600')})
SELECT * FROM (SELECT *, CAST(attack_count AS DOUBLE) / flow_count AS attack_ratio,
  CAST(row_number() OVER (PARTITION BY window_seconds ORDER BY high_risk_count DESC, attack_count DESC, max_prob DESC, flow_count DESC, source_file, host, window_start) AS INTEGER) AS rank FROM w) WHERE rank <= 20""")
def host_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.host_windows(flows(spark, sf_dir), (HOUR, 6 * HOUR), 20)


@query(""", p AS (SELECT * FROM (VALUES ('botnet_malware', 3600, CAST(0.9 AS DOUBLE)), ('scan', 21600, CAST(0.5 AS DOUBLE))) t(target_label, window_seconds, threshold)),
w AS (SELECT target_label, window_seconds, threshold, source_file, host, CAST(floor(start_time / window_seconds) * window_seconds AS BIGINT) AS window_start, count(*) AS flow_count,
  count(*) FILTER (major_label = target_label) AS argmax_count, count(*) FILTER (CASE WHEN major_label = target_label THEN major_prob ELSE 0 END >= threshold) AS hit_count,
  max(CASE WHEN major_label = target_label THEN major_prob ELSE 0 END) AS max_target_prob FROM flows, p GROUP BY ALL)
SELECT * FROM (SELECT *, hit_count > 0 AS triggered, CAST(row_number() OVER (PARTITION BY target_label, window_seconds, threshold
  ORDER BY (hit_count > 0) DESC, hit_count DESC, max_target_prob DESC, flow_count DESC, source_file, host, window_start) AS INTEGER) AS rank FROM w) WHERE rank <= 20""")
def win_policy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.policy_windows(flows(spark, sf_dir), [("botnet_malware", HOUR, 0.9), ("scan", 6 * HOUR, 0.5)], 20)


@query("""SELECT flow_id, CAST(sum(begins) OVER (PARTITION BY source_file, host ORDER BY flow_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
FROM (SELECT *, CASE WHEN start_time - lag(start_time) OVER (PARTITION BY source_file, host ORDER BY flow_id) > 14400 THEN 1 ELSE 0 END AS begins FROM flows)""")
def ses_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sessions.idle_sessions(flows(spark, sf_dir), ["source_file", "host"], "start_time", "flow_id", 4.0 * HOUR)
    return df.select("flow_id", "session")


def _prior_sql(value: str, seconds: int) -> str:
    return f"""CAST(coalesce(sum({value}) OVER (PARTITION BY source_file, host ORDER BY start_us RANGE BETWEEN {seconds}000000 PRECEDING AND CURRENT ROW)
      - sum({value}) OVER (PARTITION BY source_file, host, start_us ORDER BY flow_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS BIGINT)"""


@query(f"""SELECT flow_id, {_prior_sql('1', 21600)} AS prior_6h, {_prior_sql('1', 86400)} AS prior_24h FROM flows""")
def win_ctx_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["source_file", "host"]
    one = F.lit(1)
    return flows(spark, sf_dir).select("flow_id", windows.prior(one, keys, "start_us", "flow_id", 6 * HOUR).alias("prior_6h"), windows.prior(one, keys, "start_us", "flow_id", 24 * HOUR).alias("prior_24h"))


@query(f"""SELECT flow_id, {_prior_sql("CASE WHEN connection_type = 'tcp_reset_or_refused' THEN 1 ELSE 0 END", 21600)} AS resets, {_prior_sql("CASE WHEN payload_byte_length <= 0 THEN 1 ELSE 0 END", 21600)} AS empties FROM flows""")
def win_ctx_cond(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["source_file", "host"]
    of = lambda c: windows.prior(c.cast("long"), keys, "start_us", "flow_id", 6 * HOUR)
    return flows(spark, sf_dir).select("flow_id", of(F.col("connection_type") == "tcp_reset_or_refused").alias("resets"), of(F.col("payload_byte_length") <= 0).alias("empties"))


@query("""SELECT a.flow_id, count(DISTINCT b.responder_endpoint) AS targets FROM flows a LEFT JOIN flows b ON a.source_file = b.source_file AND a.host = b.host
AND b.start_us >= a.start_us - 21600000000 AND (b.start_us < a.start_us OR (b.start_us = a.start_us AND b.flow_id < a.flow_id)) GROUP BY a.flow_id""")
def win_ctx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_prior_distinct(flows(spark, sf_dir), "targets", "responder_endpoint", ["source_file", "host"], "start_us", "flow_id", 6 * HOUR).select("flow_id", "targets")


@query(f"""SELECT flow_id, {_prior_sql('1', 60)} AS context_host_flow_count_60s, {_prior_sql('1', 300)} AS context_host_flow_count_300s,
{_prior_sql("CASE WHEN connection_type = 'tcp_reset_or_refused' THEN 1 ELSE 0 END", 60)} AS context_host_reset_count_60s,
{_prior_sql("CASE WHEN connection_type = 'tcp_control_only' THEN 1 ELSE 0 END", 60)} AS context_host_control_count_60s,
{_prior_sql("CASE WHEN payload_byte_length <= 0 THEN 1 ELSE 0 END", 60)} AS context_host_payload0_count_60s,
(SELECT count(DISTINCT split_part(b.responder_endpoint, ':', 2)) FROM flows b WHERE a.source_file = b.source_file AND a.host = b.host AND b.start_us >= a.start_us - 60000000 AND (b.start_us < a.start_us OR (b.start_us = a.start_us AND b.flow_id < a.flow_id))) AS context_host_distinct_dport_60s,
(SELECT count(DISTINCT split_part(b.responder_endpoint, ':', 1)) FROM flows b WHERE a.source_file = b.source_file AND a.host = b.host AND b.start_us >= a.start_us - 60000000 AND (b.start_us < a.start_us OR (b.start_us = a.start_us AND b.flow_id < a.flow_id))) AS context_host_distinct_dhost_60s
FROM flows a""")
def win_ctx_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.functions.columns import host_of, port_of

    df = flows(spark, sf_dir).withColumns({"dport": port_of(F.col("responder_endpoint")), "dhost": host_of(F.col("responder_endpoint"))})
    out = windows.flow_context(df, ["source_file", "host"], "start_us", "flow_id", "connection_type", "payload_byte_length", "dport", "dhost")
    return out.select("flow_id", *[c for c in out.columns if c.startswith("context_host_")])


@query("""SELECT flow_id, greatest(max(major_prob) OVER (PARTITION BY source_file, host ORDER BY start_us RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING),
max(major_prob) OVER (PARTITION BY source_file, host, start_us ORDER BY flow_id ROWS UNBOUNDED PRECEDING)) AS trailing FROM flows""")
def win_trailing_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", windows.trailing_max("major_prob", ["source_file", "host"], "start_us", "flow_id", 6 * HOUR).alias("trailing"))


_BUCKET_SQL = """SELECT source_file, host, CAST(floor(start_time / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS "rows",
count(*) FILTER (major_label = 'botnet_malware') AS target_rows, max(major_prob) AS max_score, bool_or(major_label = 'botnet_malware') AS has_target FROM flows GROUP BY ALL"""


def _buckets(df: DataFrame) -> DataFrame:
    return windows.score_buckets(df.withColumn("is_target", F.col("major_label") == "botnet_malware"), ["source_file", "host"], "start_time", "major_prob", "is_target", HOUR)


@query(_BUCKET_SQL)
def win_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(flows(spark, sf_dir))


@query(f""", b AS ({_BUCKET_SQL}) SELECT flow_id, coalesce(b.has_target, false) AS in_target_window FROM flows f LEFT JOIN b
ON f.source_file = b.source_file AND f.host = b.host AND CAST(floor(f.start_time / 3600) * 3600 AS BIGINT) = b.window_start""")
def jn_window_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    return windows.window_flag(df, _buckets(df), ["source_file", "host"], "start_time", HOUR).select("flow_id", "in_target_window")


@query(f""", b AS ({_BUCKET_SQL}) SELECT count(*) FILTER (b.has_target) AS rows_in_windows, count(*) FILTER (b.has_target AND major_label = 'botnet_malware') AS targets_in_windows,
count(*) FILTER (b.has_target AND major_label = 'benign') AS benign_in_windows FROM flows f JOIN b ON f.source_file = b.source_file AND f.host = b.host AND CAST(floor(f.start_time / 3600) * 3600 AS BIGINT) = b.window_start""")
def agg_cooccur(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    return summary.cooccurrence(windows.window_flag(df, _buckets(df), ["source_file", "host"], "start_time", HOUR), "botnet_malware")


@query("""SELECT * FROM (SELECT lag(flow_id) OVER w AS earlier, flow_id AS later, lag(split) OVER w AS earlier_split, split AS later_split, start_time - lag(start_time) OVER w AS gap
FROM flows WINDOW w AS (PARTITION BY source_file, host ORDER BY start_time, flow_id)) WHERE gap <= 7200 AND earlier_split <> later_split""")
def win_near_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.near_leaks(flows(spark, sf_dir), ["source_file", "host"], "start_time", "flow_id", "split", 2 * HOUR)


@query("""SELECT * FROM (SELECT lag(flow_id) OVER w AS earlier, flow_id AS later, start_time - lag(start_time) OVER w AS gap
FROM flows WINDOW w AS (PARTITION BY source_file, host ORDER BY start_time, flow_id)) WHERE gap >= 0 AND gap <= 7200""")
def win_group_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.near_pairs(flows(spark, sf_dir), ["source_file", "host"], "start_time", "flow_id", 2 * HOUR)


_PAIR_SQL = """, v AS (SELECT flow_id, host, start_time AS t FROM flows WHERE event_type = 'view'), p AS (SELECT host, start_time AS lt, flow_id AS ord, event_type || '/' || source_label AS label FROM flows WHERE event_type IN ('purchase', 'error'))"""


@query(_PAIR_SQL + """ SELECT flow_id, label, abs(lt - t) AS delta FROM (SELECT v.flow_id, p.label, p.lt, v.t, row_number() OVER (PARTITION BY v.flow_id
ORDER BY abs(p.lt - v.t), -p.lt, CASE WHEN p.lt >= v.t THEN p.ord ELSE -p.ord END) AS n FROM v JOIN p ON v.host = p.host AND abs(p.lt - v.t) <= 7200) WHERE n = 1""")
def jn_asof_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    views = df.where("event_type = 'view'").select("flow_id", "host", F.col("start_time").alias("t"))
    marks = df.where("event_type IN ('purchase', 'error')").select("host", F.col("start_time").alias("lt"), F.col("flow_id").alias("ord"), F.concat_ws("/", "event_type", "source_label").alias("label"))
    return asof.nearest_label(views, marks, ["host"], "flow_id", "t", "lt", "label", "ord", 2.0 * HOUR)


@query(""", v AS (SELECT flow_id, user_id AS a, user_id % 10 AS b, start_time AS t FROM flows WHERE event_type = 'view'),
p AS (SELECT user_id AS x, user_id % 10 AS y, start_time AS lt, flow_id AS ord, event_type AS label FROM flows WHERE event_type <> 'view'),
c AS (SELECT v.flow_id, p.label, abs(p.lt - v.t) AS delta, CASE WHEN v.a = p.x AND v.b = p.y THEN 'directional' ELSE 'directional_reversed' END AS mode, p.lt, v.t, p.ord
  FROM v JOIN p ON abs(p.lt - v.t) <= 7200 AND ((v.a = p.x AND v.b = p.y) OR (v.a = p.y AND v.b = p.x AND NOT (v.a = p.x AND v.b = p.y))))
SELECT flow_id, label, mode, delta FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY delta, mode, -lt, CASE WHEN lt >= t THEN ord ELSE -ord END) AS n FROM c) WHERE n = 1""")
def jn_asof_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    views = df.where("event_type = 'view'").select("flow_id", F.col("user_id").alias("a"), (F.col("user_id") % 10).alias("b"), F.col("start_time").alias("t"))
    marks = df.where("event_type <> 'view'").select(F.col("user_id").alias("x"), (F.col("user_id") % 10).alias("y"), F.col("start_time").alias("lt"), F.col("flow_id").alias("ord"), F.col("event_type").alias("label"))
    return asof.two_way_label(views, marks, ("a", "b"), ("x", "y"), "flow_id", "t", "lt", "label", "ord", 2.0 * HOUR)


@query(_PAIR_SQL + """ SELECT CASE WHEN n.label IS NULL THEN 'UNMATCHED' ELSE n.label END AS label, count(*) AS n FROM v LEFT JOIN (SELECT flow_id, label FROM (SELECT v.flow_id, p.label, row_number() OVER (PARTITION BY v.flow_id
ORDER BY abs(p.lt - v.t), -p.lt, CASE WHEN p.lt >= v.t THEN p.ord ELSE -p.ord END) AS n FROM v JOIN p ON v.host = p.host AND abs(p.lt - v.t) <= 900) WHERE n = 1) n ON v.flow_id = n.flow_id GROUP BY 1""")
def flt_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    views = df.where("event_type = 'view'").select("flow_id", "host", F.col("start_time").alias("t"))
    marks = df.where("event_type IN ('purchase', 'error')").select("host", F.col("start_time").alias("lt"), F.col("flow_id").alias("ord"), F.concat_ws("/", "event_type", "source_label").alias("label"))
    found = asof.nearest_label(views, marks, ["host"], "flow_id", "t", "lt", "label", "ord", 900.0)
    return views.join(found, "flow_id", "left").groupBy(F.coalesce("label", F.lit("UNMATCHED")).alias("label")).agg(F.count("*").alias("n"))


# Splits.

_BUCKET = "CAST(CAST('0x' || substr(sha1({}), 1, 12) AS UBIGINT) AS BIGINT) % 10000"
_CUT = """CASE WHEN c = 1 THEN 'train' WHEN c = 2 THEN CASE WHEN p = 0 THEN 'train' ELSE 'test' END
  WHEN p < least(greatest(floor(c * 0.7::DOUBLE), 1), c - greatest(floor(c * 0.15::DOUBLE), 1) - 1) THEN 'train'
  WHEN p < least(greatest(floor(c * 0.7::DOUBLE), 1), c - greatest(floor(c * 0.15::DOUBLE), 1) - 1) + greatest(floor(c * 0.15::DOUBLE), 1) THEN 'val' ELSE 'test' END"""


@query(f"""SELECT DISTINCT host, CASE WHEN {_BUCKET.format('host')} / 10000.0::DOUBLE < 0.7::DOUBLE THEN 'train' WHEN {_BUCKET.format('host')} / 10000.0::DOUBLE < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM flows""")
def spl_hash_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("host", splits.hash_split(F.col("host")).alias("split")).distinct()


@query(f""", g AS (SELECT host, major_label FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY flow_id) AS n FROM flows) WHERE n = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY major_label ORDER BY {_BUCKET.format("major_label || ':' || host")}, host) - 1 AS p, count(*) OVER (PARTITION BY major_label) AS c FROM g)
SELECT host, major_label, {_CUT} AS split FROM r""")
def spl_hash_strat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_hash_split(flows(spark, sf_dir), "host", "major_label", ["flow_id"])


@query(f""", g AS (SELECT host, major_label, start_time FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY start_time, flow_id) AS n FROM flows) WHERE n = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY major_label ORDER BY start_time, {_BUCKET.format("major_label || ':' || host")}, host) - 1 AS p, count(*) OVER (PARTITION BY major_label) AS c FROM g)
SELECT host, major_label, {_CUT} AS split FROM r""")
def spl_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_ordered_split(flows(spark, sf_dir), "host", "major_label", "start_time", ["flow_id"])


@query(f""", r AS (SELECT flow_id, major_label, start_time, row_number() OVER (PARTITION BY major_label ORDER BY start_time, flow_id) - 1 AS p, count(*) OVER (PARTITION BY major_label) AS c FROM flows),
z AS (SELECT *, CAST(least(128, greatest(1, c // 3)) AS BIGINT) AS size FROM r),
b AS (SELECT *, CASE WHEN c % size > 0 AND c % size < greatest(2, size // 2) AND (c - 1) // size > 0 AND p // size = (c - 1) // size THEN p // size - 1 ELSE p // size END AS block FROM z),
k AS (SELECT major_label, block, count(*) AS n, min(start_time) AS first, {_BUCKET.format("'13:' || major_label || ':' || block")} AS key FROM b GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY major_label ORDER BY key, first, block) AS i, count(*) OVER (PARTITION BY major_label) AS m, CAST(sum(n) OVER (PARTITION BY major_label) AS BIGINT) AS total FROM k),
fold AS (WITH RECURSIVE f(major_label, i, s0, s1, s2, choice, block) AS (
  SELECT major_label, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, -1, -1::BIGINT FROM (SELECT DISTINCT major_label FROM o)
  UNION ALL
  SELECT q.major_label, q.i, q.s0 + CASE WHEN ch = 0 THEN q.n ELSE 0 END, q.s1 + CASE WHEN ch = 1 THEN q.n ELSE 0 END, q.s2 + CASE WHEN ch = 2 THEN q.n ELSE 0 END, ch, q.block FROM (
    SELECT o.major_label, o.i, o.n, o.block, f.s0, f.s1, f.s2, CASE WHEN o.m >= 3 AND o.i <= 3 THEN CAST(o.i - 1 AS INTEGER) ELSE
      CASE WHEN (f.s0 - t0, f.s0, 0) <= (f.s1 - t1, f.s1, 1) AND (f.s0 - t0, f.s0, 0) <= (f.s2 - t2, f.s2, 2) THEN 0 WHEN (f.s1 - t1, f.s1, 1) <= (f.s2 - t2, f.s2, 2) THEN 1 ELSE 2 END END AS ch
    FROM f JOIN (SELECT *, CAST(floor(total * 0.7::DOUBLE) AS BIGINT) AS t0, CAST(floor(total * 0.15::DOUBLE) AS BIGINT) AS t1, total - CAST(floor(total * 0.7::DOUBLE) AS BIGINT) - CAST(floor(total * 0.15::DOUBLE) AS BIGINT) AS t2 FROM o) o
      ON o.major_label = f.major_label AND o.i = f.i + 1) q)
  SELECT * FROM f WHERE i > 0)
SELECT b.flow_id, b.major_label, b.block, CASE choice WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM b JOIN fold ON b.major_label = fold.major_label AND b.block = fold.block""")
def spl_time_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_block_split(flows(spark, sf_dir), "flow_id", "major_label", "start_time", [], 128)


@query("""SELECT flow_id, major_label FROM (SELECT *, row_number() OVER (PARTITION BY major_label ORDER BY sha1('13:' || flow_id), flow_id) AS n FROM flows) WHERE n <= 500""")
def smp_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.class_cap(flows(spark, sf_dir), "major_label", "flow_id", 500).select("flow_id", "major_label")


@query("""SELECT flow_id, CASE WHEN count(*) OVER (PARTITION BY major_label) >= 30 THEN major_label || '::' || connection_type ELSE major_label END AS stratum FROM flows""")
def spl_submode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.submode_stratum(flows(spark, sf_dir), "major_label", "connection_type").select("flow_id", "stratum")


@query(f""", s AS (SELECT source_label, host, split FROM flows), z AS (SELECT source_label, host, count(*) AS n FROM s GROUP BY ALL),
l AS (SELECT source_label FROM z GROUP BY 1 HAVING sum(n) BETWEEN 15 AND 1000000000 AND count(*) >= 3),
m AS (SELECT z.*, coalesce(sum(n) OVER (PARTITION BY source_label ORDER BY {_BUCKET.format("'13:' || source_label || ':' || host")}, host ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z JOIN l USING (source_label)),
e AS (SELECT *, min(CASE WHEN before + n >= 5 THEN before + n END) OVER (PARTITION BY source_label) AS val_end FROM m)
SELECT s.source_label, s.host, coalesce(CASE WHEN e.before < e.val_end THEN 'val' WHEN e.before < e.val_end + 5 THEN 'test' WHEN e.n IS NOT NULL THEN 'train' END, s.split) AS split, count(*) AS n
FROM s LEFT JOIN e USING (source_label, host) GROUP BY ALL""")
def spl_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows(spark, sf_dir).select("source_label", "host", "split")
    return splits.rebalanced(rows, "source_label", "host", "split", 5, 1_000_000_000).groupBy("source_label", "host", "split").agg(F.count("*").alias("n"))
