"""Queries of gates, host thresholds, alignment and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tokens as T
from millrace.operators import audit, gates, metrics
from millrace.plans import reports_q
from millrace.plans.registry import query
from millrace.plans.views import docs, flows

_NEEDS = [("scan", 100, 0.5, 0.5), ("botnet_malware", 100, 0.99, 0.5), ("heartbleed", 1, 0.1, 0.1)]
_NEEDS_SQL = "(VALUES " + ", ".join(f"('{n}', {s}, CAST({r} AS DOUBLE), CAST({f} AS DOUBLE))" for n, s, r, f in _NEEDS) + ") q(label, min_support, min_recall, min_f1)"


@query(reports_q._PER + f""" SELECT q.*, coalesce(m.support, 0) AS support, coalesce(m.recall, 0) AS recall, coalesce(m.f1, 0) AS f1, coalesce(m.support, 0) >= min_support AND coalesce(m.recall, 0) >= min_recall AND coalesce(m.f1, 0) >= min_f1 AS passed,
CASE WHEN coalesce(m.support, 0) < min_support THEN 'support' WHEN coalesce(m.recall, 0) < min_recall THEN 'recall' WHEN coalesce(m.f1, 0) < min_f1 THEN 'f1' END AS reason FROM {_NEEDS_SQL} LEFT JOIN m USING (label)""")
def val_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.acceptance(metrics.per_class(flows(spark, sf_dir), "major_label", "pred_label", reports_q.LABELS), _NEEDS)


@query("""SELECT split, major_label, count(*) AS "rows", count(*) FILTER (was_packet_truncated) AS truncated_rows, count(*) FILTER (was_packet_truncated) / CAST(count(*) AS DOUBLE) AS ratio FROM flows
WHERE major_label IN ('scan', 'dos_ddos') GROUP BY ALL HAVING count(*) >= 10 AND count(*) FILTER (was_packet_truncated) / CAST(count(*) AS DOUBLE) > 0.2""")
def val_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.truncation_warnings(audit.truncation(flows(spark, sf_dir), "was_packet_truncated", "major_label"), ["scan", "dos_ddos"], 10, 0.2)


@query("SELECT max(p) AS best, max_by(p, d) AS last, max(p) - max_by(p, d) > 0.05 AS late_drop FROM (SELECT user_id AS d, avg(CASE WHEN major_label = pred_label THEN 1.0::DOUBLE ELSE 0 END) AS p FROM flows GROUP BY 1)")
def val_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = flows(spark, sf_dir).groupBy(F.col("user_id").alias("d")).agg(F.avg((F.col("major_label") == F.col("pred_label")).cast("double")).alias("p"))
    return gates.epoch_warnings(per, "p", "d")


@query("SELECT flow_id, coalesce(CASE WHEN flow_id % 3 > 0 THEN major_prob END, CASE WHEN pred_label = 'scan' THEN 0.25::DOUBLE END, 0) AS p FROM flows")
def thr_prob_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = F.when(F.col("flow_id") % 3 > 0, F.create_map(F.lit("scan"), F.col("major_prob"))).otherwise(F.create_map().cast("map<string,double>"))
    return flows(spark, sf_dir).select("flow_id", gates.target_probability(F.col("pred_label"), F.lit(0.25), probs, "scan").alias("p"))


#: The grid of candidate_thresholds' defaults.
_FULL_GRID = "SELECT k / CAST(1000 AS DOUBLE) AS threshold FROM range(1, 1000) r(k) UNION SELECT unnest(quantile_cont({score}, [" + ", ".join(f"{k / 300!r}::DOUBLE" for k in range(301)) + "])) FROM {rows}"


def _scan_sql(view: str, kind: str, seconds: int, grid: str = "SELECT k / CAST(10 AS DOUBLE) AS threshold FROM range(1, 10) r(k) UNION SELECT unnest(quantile_cont({score}, [0.0, 1.0])) FROM {rows}") -> str:
    return f"""{kind}_g AS ({grid.format(score="score", rows=f"{view} WHERE split = 'val'")}),
{kind}_n AS (SELECT split, threshold, count(*) FILTER (is_target AND score >= threshold) AS tp, count(*) FILTER (NOT is_target AND score >= threshold) AS fp, count(*) FILTER (is_target AND score < threshold) AS fn, count(*) FILTER (NOT is_target AND score < threshold) AS tn FROM {view}, {kind}_g WHERE split <> 'train' GROUP BY ALL),
{kind}_r AS (SELECT *, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS precision, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS recall FROM {kind}_n), {kind}_m AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM {kind}_r),
{kind}_b AS (SELECT threshold FROM {kind}_m WHERE split = 'val' ORDER BY (recall >= 0.5 AND f1 >= 0.2) DESC, f1 DESC, recall DESC, precision DESC, fp, threshold DESC LIMIT 1),
{kind}_o AS (SELECT '{kind}' AS kind, {seconds} AS window_seconds, m.* FROM {kind}_m m JOIN {kind}_b USING (threshold))"""


_HOST_VIEWS = """, f AS (SELECT *, major_label = 'scan' AS is_target, major_prob AS score FROM flows),
t AS (SELECT split, is_target, greatest(max(score) OVER (PARTITION BY split, source_file, host ORDER BY start_us RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING), max(score) OVER (PARTITION BY split, source_file, host, start_us ORDER BY flow_id ROWS UNBOUNDED PRECEDING)) AS score FROM f),
b AS (SELECT split, bool_or(is_target) AS is_target, max(score) AS score FROM f GROUP BY split, source_file, host, floor(start_time / 21600)), """
_HOST_ROWS = " SELECT * FROM flow_o UNION ALL SELECT * FROM trailing_o UNION ALL SELECT * FROM bucket_o"


@query(_HOST_VIEWS + ", ".join((_scan_sql("f", "flow", 0, _FULL_GRID), _scan_sql("t", "trailing", 21600, _FULL_GRID), _scan_sql("b", "bucket", 21600, _FULL_GRID))) + _HOST_ROWS)
def thr_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).withColumn("score", F.col("major_prob"))
    return gates.host_thresholds(df.where("split = 'val'"), df.where("split = 'test'"), "scan", [21600], 0.5, 0.2)


@query(f", q AS ({_FULL_GRID.format(score='major_prob', rows='flows')}) SELECT DISTINCT round(threshold, 9) AS threshold FROM q")
def thr_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.candidate_thresholds(flows(spark, sf_dir), "major_prob").select(F.round("threshold", 9).alias("threshold")).distinct()


@query("SELECT host, count(*) AS n, count(*) FILTER (major_label <> 'benign') AS attacks, count(DISTINCT major_label) AS labels FROM flows GROUP BY 1")
def agg_csv_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("major_label") != "benign").alias("attacks"), F.countDistinct("major_label").alias("labels"))


@query("SELECT source_label, count(*) AS n, count(*) FILTER (payload_byte_length > 0) AS with_payload, count(*) FILTER (payload_byte_length <= 0) AS empty, count(DISTINCT endpoint_a || endpoint_b) AS keys FROM flows GROUP BY 1")
def agg_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("payload_byte_length")
    return flows(spark, sf_dir).groupBy("source_label").agg(F.count("*").alias("n"), F.count_if(p > 0).alias("with_payload"), F.count_if(p <= 0).alias("empty"), F.countDistinct(F.concat("endpoint_a", "endpoint_b")).alias("keys"))


_JOBS = [("cap0", "Bot"), ("cap1", "PortScan"), ("cap2", "DoS Hulk"), ("cap9", "Bot")]
_JOBS_SQL = "(VALUES " + ", ".join(f"('{f}', '{n}')" for f, n in _JOBS) + ") j(file, label)"


@query(f"SELECT j.file, j.label, count(f.flow_id) AS n, count(f.flow_id) = 0 AS missing FROM {_JOBS_SQL} LEFT JOIN flows f ON f.source_file = j.file AND f.source_label = j.label GROUP BY ALL")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = spark.createDataFrame(_JOBS, "file string, label string")
    n = flows(spark, sf_dir).groupBy(F.col("source_file").alias("file"), F.col("source_label").alias("label")).agg(F.count("*").alias("n"))
    return jobs.join(n, ["file", "label"], "left").select("file", "label", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("""SELECT split, major_label, event_type, connection_type, count(*) AS n, min(packet_count) AS least, max(packet_count) AS most FROM flows GROUP BY ALL""")
def agg_processed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).groupBy("split", "major_label", "event_type", "connection_type").agg(F.count("*").alias("n"), F.min("packet_count").alias("least"), F.max("packet_count").alias("most"))


@query(""", h AS (SELECT split, hex(bytes[1:510]) AS h FROM docs), i AS (SELECT split, list_concat([2], list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS INTEGER) + 8), [3]) AS ids FROM h),
d AS (SELECT DISTINCT split, sha1(unhex(rpad(array_to_string(list_transform(ids, lambda v: format('{:02x}{:02x}', v % 256, v // 256)), ''), 2048, '0'))) AS v FROM i), p AS (SELECT * FROM (VALUES ('train/val', 'train', 'val'), ('train/test', 'train', 'test'), ('val/test', 'val', 'test')) t(pair, a, b))
SELECT pair, count(y.v) AS n, min(y.v) AS first FROM p LEFT JOIN d x ON x.split = p.a LEFT JOIN d y ON y.split = p.b AND y.v = x.v GROUP BY pair""", "docs")
def jn_window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlaps(docs(spark, sf_dir), T.first_window_digest(T.byte_ids(F.substring("bytes", 1, 510))))
