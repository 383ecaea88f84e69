"""Queries of aggregations, audits, metrics, thresholds and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions import labels as L
from millrace.operators import audit, metrics, splits, summary
from millrace.plans.registry import query
from millrace.plans.views import docs, flows
from millrace.session import table

LABELS = ["benign", "dos_ddos", "bruteforce", "botnet_malware", "scan", "heartbleed"]
_NAMES = "(VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(LABELS)) + ") l(id, label)"


@query("SELECT major_label AS value, count(*) AS n FROM flows WHERE major_label IS NOT NULL GROUP BY 1")
def agg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counts(flows(spark, sf_dir), "major_label")


@query("SELECT value, count(*) AS n FROM (SELECT unnest([event_type, connection_type]) AS value FROM flows) GROUP BY 1")
def agg_minor_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.flat_counts(flows(spark, sf_dir).select(F.array("event_type", "connection_type").alias("minors")), "minors")


@query("SELECT split, coalesce(CAST(quality AS VARCHAR), 'None') AS value, count(*) AS n FROM docs GROUP BY 1, 2", "docs")
def agg_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.support(docs(spark, sf_dir), "quality")


@query("SELECT split, value, count(*) AS n FROM (SELECT split, unnest([event_type, connection_type]) AS value FROM flows) GROUP BY 1, 2")
def agg_minor_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.flat_support(flows(spark, sf_dir).select("split", F.array("event_type", "connection_type").alias("minors")), "minors")


@query("SELECT host, list_sort(list(DISTINCT split)) AS splits FROM flows GROUP BY host HAVING count(DISTINCT split) > 1")
def agg_flow_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.flow_leaks(flows(spark, sf_dir), "host")


_GRID = f"SELECT label, split FROM {_NAMES}, (VALUES ('train'), ('val'), ('test')) s(split)"


@query(f", g AS ({_GRID}) SELECT g.label, g.split, count(f.flow_id) AS n FROM g LEFT JOIN flows f ON g.label = f.major_label AND g.split = f.split WHERE g.split <> 'train' GROUP BY ALL HAVING count(f.flow_id) < 300")
def agg_low_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.low_support(flows(spark, sf_dir), "major_label", LABELS, 300)


@query(f", g AS ({_GRID}), t AS (SELECT major_label, count(*) AS total FROM flows GROUP BY 1) SELECT g.label, g.split, coalesce(t.total, 0) AS total, coalesce(t.total, 0) < 3 AS too_few FROM g LEFT JOIN flows f ON g.label = f.major_label AND g.split = f.split LEFT JOIN t ON g.label = t.major_label GROUP BY g.label, g.split, t.total HAVING count(f.flow_id) = 0")
def agg_missing_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_labels(flows(spark, sf_dir), "major_label", LABELS)


@query("""SELECT split, count(*) AS "rows", count(DISTINCT host) AS flows, min(packet_count) AS min_packets, CAST(median(packet_count) AS DOUBLE) AS median_packets, max(packet_count) AS max_packets,
count(*) FILTER (was_packet_truncated) AS truncated_rows, count(*) FILTER (was_packet_truncated) / CAST(count(*) AS DOUBLE) AS truncation_ratio FROM flows GROUP BY 1""")
def agg_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split_summary(flows(spark, sf_dir), "host", "packet_count", "was_packet_truncated")


@query("""SELECT split, major_label, count(*) AS "rows", count(*) FILTER (was_packet_truncated) AS truncated_rows, count(*) FILTER (was_packet_truncated) / CAST(count(*) AS DOUBLE) AS ratio FROM flows GROUP BY 1, 2""")
def agg_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.truncation(flows(spark, sf_dir), "was_packet_truncated", "major_label")


@query(""", n AS (SELECT split, major_label, connection_type || '/' || packet_count AS shape, count(*) AS n FROM flows GROUP BY ALL),
r AS (SELECT a.split, a.major_label, a.n, EXISTS (SELECT 1 FROM n t WHERE t.split = 'train' AND t.major_label = a.major_label AND t.shape = a.shape) AS own, EXISTS (SELECT 1 FROM n t WHERE t.split = 'train' AND t.shape = a.shape) AS anyone FROM n a WHERE a.split <> 'train' AND lower(a.major_label) <> 'benign'),
p AS (SELECT split, major_label, CAST(sum(n) AS BIGINT) AS eval_rows, CAST(coalesce(sum(n) FILTER (NOT own), 0) AS BIGINT) AS unseen_rows, CAST(coalesce(sum(n) FILTER (NOT own AND anyone), 0) AS BIGINT) AS ambiguous_rows FROM r GROUP BY ALL)
SELECT p.*, CAST(coalesce(t.train_rows, 0) AS BIGINT) AS train_rows, unseen_rows / CAST(eval_rows AS DOUBLE) AS unseen_ratio,
  coalesce(t.train_rows, 0) >= 100 AND eval_rows >= 100 AND unseen_rows / CAST(eval_rows AS DOUBLE) > 0.2 AND ambiguous_rows >= 50 AS blocking
FROM p LEFT JOIN (SELECT major_label, sum(n) AS train_rows FROM n WHERE split = 'train' GROUP BY 1) t USING (major_label)""")
def agg_submode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).withColumn("shape", F.concat_ws("/", "connection_type", F.col("packet_count").cast("string")))
    return audit.shape_coverage(df, "major_label", "shape")


@query(""", d AS (SELECT sha1(text) AS h, split FROM docs), o AS (SELECT count(*) AS n FROM (SELECT a.h FROM d a JOIN d b ON a.h = b.h AND a.split < b.split GROUP BY a.h, a.split, b.split)),
q AS (SELECT count(*) AS n FROM (SELECT a.source FROM docs a JOIN docs b ON a.source = b.source AND a.split < b.split GROUP BY a.source, a.split, b.split)),
l AS (SELECT count(*) AS n FROM (SELECT doc_id FROM docs GROUP BY 1 HAVING count(DISTINCT split) > 1))
SELECT 'flow_leak' AS "check", n, n > 0 AS blocking FROM l UNION ALL SELECT 'digest_overlap', n, n > 0 FROM o UNION ALL SELECT 'file_overlap', n, false FROM q""", "docs")
def agg_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(docs(spark, sf_dir).withColumn("digest", C.bytes_digest(F.col("bytes"))), "doc_id", "digest", "source")


_OVERLAP = """, d AS (SELECT DISTINCT {} AS v, split FROM docs), p AS (SELECT * FROM (VALUES ('train/val', 'train', 'val'), ('train/test', 'train', 'test'), ('val/test', 'val', 'test')) t(pair, a, b))
SELECT pair, count(y.v) AS n, min(y.v) AS first FROM p LEFT JOIN d x ON x.split = p.a LEFT JOIN d y ON y.split = p.b AND y.v = x.v GROUP BY pair"""


@query(_OVERLAP.format("sha1(text)"), "docs")
def jn_hash_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlaps(docs(spark, sf_dir), C.bytes_digest(F.col("bytes")))


@query(_OVERLAP.format("source"), "docs")
def jn_file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlaps(docs(spark, sf_dir), F.col("source"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'", "")
def jn_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    return audit.shared_keys(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), ["k"])


@query("SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'", "")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return audit.missing_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), o, ["k"])


@query("SELECT k FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'", "")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey"))
    return audit.shared_keys(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"), ["k"])


@query(""", t AS (SELECT DISTINCT major_label, connection_type, packet_count FROM flows WHERE split = 'train'), e AS (SELECT DISTINCT major_label, connection_type, packet_count FROM flows WHERE split <> 'train')
SELECT e.* FROM e ANTI JOIN t USING (major_label, connection_type, packet_count)""")
def jn_submode_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["major_label", "connection_type", "packet_count"]
    df = flows(spark, sf_dir)
    return audit.missing_keys(df.where("split <> 'train'"), df.where("split = 'train'"), keys)


@query("""SELECT count(*) AS "rows", count(DISTINCT host) AS flows, count(*) FILTER (was_packet_truncated) AS truncated_rows, count(*) FILTER (payload_byte_length <= 0) AS empty_rows,
min(payload_byte_length) AS min_payload, CAST(median(payload_byte_length) AS DOUBLE) AS median_payload, max(payload_byte_length) AS max_payload FROM flows""")
def agg_dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dataset_stats(flows(spark, sf_dir), "host", "payload_byte_length", "was_packet_truncated")


@query("SELECT min(n_chars) AS min, quantile_disc(n_chars, 0.5) AS median, max(n_chars) AS max FROM docs", "docs")
def agg_payload_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lower_median(docs(spark, sf_dir), "n_chars")


@query("SELECT split, event_type AS view, major_label, count(*) AS n FROM flows GROUP BY ALL")
def agg_class_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).groupBy("split", F.col("event_type").alias("view"), "major_label").agg(F.count("*").alias("n"))


_SOURCES = ("BENIGN", "bot", "Botnet", "PortScan", "DoS Hulk", "DDoS", "  ", "Web Attack - XSS", "robot", "FTP-Patator", "web attack x brute force", "Fuzzers")
_SOURCE = "CASE flow_id % 12 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_SOURCES)) + " END"


def _rules_sql(text: str, k: int) -> str:
    whens = " ".join(f"WHEN regexp_matches(trim({text}), '{r[0]}', 'i') THEN '{r[k]}'" for r in L.RULES)
    return f"CASE WHEN trim({text}) = '' THEN '{L.FALLBACK[k - 1]}' {whens} ELSE '{L.FALLBACK[k - 1]}' END"


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).drop("major_label").withColumn("src", F.expr(_SOURCE))


@query(f", s AS (SELECT flow_id, {_SOURCE} AS src FROM flows) SELECT flow_id, {_rules_sql('src', 1)} AS major_label, {_rules_sql('src', 2)} AS minor_label FROM s")
def prj_map_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.map_labels(_sourced(spark, sf_dir), "src").select("flow_id", "major_label", F.coalesce(F.get("minor_labels", F.lit(0)), F.lit("")).alias("minor_label"))


@query(f", s AS (SELECT trim({_SOURCE}) AS src FROM flows WHERE trim({_SOURCE}) <> '') SELECT src AS source_label, {_rules_sql('src', 1)} AS major_label, count(*) AS n FROM s GROUP BY ALL")
def agg_label_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _sourced(spark, sf_dir).where(F.trim("src") != "").groupBy(F.trim("src").alias("source_label")).agg(F.count("*").alias("n"))
    return n.select("source_label", L.mapped(F.col("source_label"))["major_label"].alias("major_label"), "n")


@query(f", s AS (SELECT flow_id, {_SOURCE} AS src FROM flows) SELECT flow_id, trim(src) AS label FROM s WHERE trim(src) <> ''")
def flt_label_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sourced(spark, sf_dir).where(F.trim("src") != "").select("flow_id", F.trim("src").alias("label"))


@query("""SELECT source_label, count(*) AS "rows", count(*) FILTER (pred_label = major_label) AS matched, count(*) FILTER (pred_label = major_label) / CAST(count(*) AS DOUBLE) AS ratio,
CAST(greatest(ceil(count(*) * 0.8::DOUBLE), 1) AS BIGINT) AS needed, count(*) FILTER (pred_label = major_label) < greatest(ceil(count(*) * 0.8::DOUBLE), 1) AS failed FROM flows GROUP BY 1""")
def agg_attack_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.match_coverage(flows(spark, sf_dir), "source_label", F.col("pred_label") == F.col("major_label"), 0.8)


_CONF = f", c AS (SELECT t.label AS true_label, p.label AS pred_label, count(f.flow_id) AS n FROM {_NAMES.replace(' l(', ' t(')} CROSS JOIN {_NAMES.replace(' l(', ' p(')} LEFT JOIN flows f ON f.major_label = t.label AND f.pred_label = p.label GROUP BY ALL)"


@query(_CONF + " SELECT *, n / CAST(greatest(sum(n) OVER (PARTITION BY true_label), 1) AS DOUBLE) AS share FROM c")
def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(flows(spark, sf_dir), "major_label", "pred_label", LABELS)


_PER = _CONF + """, s AS (SELECT l.label, CAST(sum(n) FILTER (true_label = l.label) AS BIGINT) AS support, CAST(sum(n) FILTER (pred_label = l.label) AS BIGINT) AS predicted, CAST(sum(n) FILTER (true_label = l.label AND pred_label = l.label) AS BIGINT) AS tp FROM c, """ + _NAMES + """ GROUP BY 1),
r AS (SELECT *, CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall FROM s),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""


@query(_PER + " SELECT * FROM m")
def agg_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class(flows(spark, sf_dir), "major_label", "pred_label", LABELS)


_MEANS = ", ".join(f"round(avg({m}) FILTER (support > 0 OR predicted > 0), 9) AS macro_{m}, round(avg({m}), 9) AS all_config_macro_{m}, round(sum({m} * support) / sum(support), 9) AS weighted_{m}" for m in ("precision", "recall", "f1"))


@query(_PER + f" SELECT round(sum(tp) / sum(support), 9) AS accuracy, {_MEANS}, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy FROM m")
def agg_major_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.major_metrics(flows(spark, sf_dir), "major_label", "pred_label", LABELS)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(""", d AS (SELECT count(*) FILTER (major_label <> 'benign' AND pred_label <> 'benign') AS tp, count(*) FILTER (major_label = 'benign' AND pred_label = 'benign') AS tn,
count(*) FILTER (major_label = 'benign' AND pred_label <> 'benign') AS fp, count(*) FILTER (major_label <> 'benign' AND pred_label = 'benign') AS fn FROM flows),
e AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS attack_precision, tp / CAST(tp + fn AS DOUBLE) AS attack_recall, fp / CAST(fp + tn AS DOUBLE) AS fpr, fn / CAST(fn + tp AS DOUBLE) AS fnr, tn / CAST(tn + fp AS DOUBLE) AS tnr, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS binary_accuracy FROM d)
SELECT *, 2 * attack_precision * attack_recall / (attack_precision + attack_recall) AS attack_f1 FROM e""")
def agg_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detection(flows(spark, sf_dir), "major_label", "pred_label")


@query(""", d AS (SELECT count(*) FILTER (event_type = 'error' AND major_prob >= 0.5) AS tp, count(*) FILTER (event_type <> 'error' AND major_prob >= 0.5) AS fp, count(*) FILTER (event_type = 'error' AND major_prob < 0.5) AS fn, count(*) FILTER (event_type <> 'error' AND major_prob < 0.5) AS tn FROM flows),
e AS (SELECT *, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS precision, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS recall FROM d) SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM e""")
def agg_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary(flows(spark, sf_dir), F.col("event_type") == "error", F.col("major_prob") >= 0.5)


_MULTI = """, x AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS t0, CASE WHEN flow_id % 3 = 0 THEN 1 ELSE 0 END AS t1, 0 AS t2, major_prob AS p0, 1 - major_prob AS p1, major_prob / 2 AS p2 FROM flows),
u AS (SELECT 'a' AS label, t0 AS t, p0 AS p FROM x UNION ALL SELECT 'b', t1, p1 FROM x UNION ALL SELECT 'c', t2, p2 FROM x)"""


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("major_prob")
    truth = F.array((F.col("event_type") == "error").cast("int"), (F.col("flow_id") % 3 == 0).cast("int"), F.lit(0))
    return flows(spark, sf_dir).select(truth.alias("t"), F.array(p, 1 - p, p / 2).alias("p"))


_ML = _MULTI + """, n AS (SELECT label, count(*) FILTER (t = 1 AND p >= 0.5) AS tp, count(*) FILTER (t <> 1 AND p >= 0.5) AS fp, count(*) FILTER (t = 1 AND p < 0.5) AS fn FROM u GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall FROM n),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""


@query(_ML + " SELECT * FROM m")
def agg_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.multilabel(_multi(spark, sf_dir), "t", "p", ["a", "b", "c"])


@query(_ML + """, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(precision) AS a, avg(recall) AS b, avg(f1) AS c FROM m), z AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS mp, tp / CAST(tp + fn AS DOUBLE) AS mr FROM s)
SELECT round(a, 9) AS macro_precision, round(b, 9) AS macro_recall, round(c, 9) AS macro_f1, round(mp, 9) AS micro_precision, round(mr, 9) AS micro_recall, round(2 * mp * mr / (mp + mr), 9) AS micro_f1 FROM z""")
def agg_multilabel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.multilabel_summary(metrics.multilabel(_multi(spark, sf_dir), "t", "p", ["a", "b", "c"]))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("SELECT flow_id, CASE WHEN 0 = flow_id % 2 THEN major_prob ELSE 0 END AS p0, CASE WHEN 1 = flow_id % 2 THEN major_prob / 2 ELSE 0 END AS p1 FROM flows")
def agg_constrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = metrics.constrained(F.array("major_prob", F.col("major_prob") / 2), [0, 1], F.col("flow_id") % 2)
    return flows(spark, sf_dir).select("flow_id", p.alias("p")).select("flow_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"))


@query(f""", n AS (SELECT l.id, l.label, count(f.flow_id) AS n FROM {_NAMES} LEFT JOIN flows f ON f.major_label = l.label GROUP BY ALL)
SELECT id, label, n, CASE WHEN n > 0 THEN least(greatest(sqrt(CAST(sum(n) OVER () AS BIGINT) / CAST(count(*) FILTER (n > 0) OVER () * n AS DOUBLE)), 0.1), 10) ELSE 0 END AS weight FROM n""")
def agg_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(flows(spark, sf_dir), "major_label", LABELS, root=True, cap=10.0)


_SWEEP = """, t AS (SELECT DISTINCT k / CAST(100 AS DOUBLE) AS threshold FROM range(1, 100) r(k)), n AS (SELECT threshold, count(*) FILTER (event_type = 'error' AND major_prob >= threshold) AS tp, count(*) FILTER (event_type <> 'error' AND major_prob >= threshold) AS fp,
count(*) FILTER (event_type = 'error' AND major_prob < threshold) AS fn, count(*) FILTER (event_type <> 'error' AND major_prob < threshold) AS tn FROM t, flows GROUP BY 1),
r AS (SELECT *, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS precision, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS recall FROM n), m AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM r)"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = spark.range(1, 100).select((F.col("id") / 100.0).alias("threshold"))
    return metrics.threshold_sweep(flows(spark, sf_dir), "major_prob", F.col("event_type") == "error", even)


@query(_SWEEP + " SELECT * FROM m")
def thr_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query(_SWEEP + " SELECT *, recall >= 0.5 AND f1 >= 0.2 AS passed FROM m ORDER BY (recall >= 0.5 AND f1 >= 0.2) DESC, f1 DESC, recall DESC, precision DESC, fp, threshold DESC LIMIT 1")
def thr_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(_sweep(spark, sf_dir), 0.5, 0.2)


@query(_MULTI + """, c AS (SELECT label, k / CAST(20 AS DOUBLE) AS threshold, t, p FROM u, range(1, 20) r(k)), n AS (SELECT label, threshold, count(*) FILTER (t = 1 AND p >= threshold) AS tp, count(*) FILTER (t <> 1 AND p >= threshold) AS fp, count(*) FILTER (t = 1 AND p < threshold) AS fn FROM c GROUP BY ALL),
r AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall FROM n),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold DESC) AS i FROM m)
SELECT label, CASE WHEN support > 0 THEN threshold ELSE 0.5 END AS threshold, CASE WHEN support > 0 THEN f1 ELSE 0 END AS f1, CASE WHEN support > 0 THEN precision ELSE 0 END AS precision, CASE WHEN support > 0 THEN recall ELSE 0 END AS recall, support FROM b WHERE i = 1""")
def thr_calib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibrated(_multi(spark, sf_dir), "t", "p", ["a", "b", "c"], [k / 20 for k in range(1, 20)])


@query("""SELECT flow_id, CASE WHEN pred_label = 'benign' AND major_prob >= 0.9 THEN 'scan' ELSE pred_label END AS benign_only, CASE WHEN pred_label IN ('benign', 'scan') AND major_prob >= 0.9 THEN 'scan' ELSE pred_label END AS target_or_benign,
CASE WHEN major_prob >= 0.9 THEN 'scan' ELSE pred_label END AS any_label FROM flows""")
def thr_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lambda m: metrics.overridden(F.col("pred_label"), F.col("major_prob"), "scan", 0.9, m)
    return flows(spark, sf_dir).select("flow_id", o("benign_only").alias("benign_only"), o("target_or_benign").alias("target_or_benign"), o("any").alias("any_label"))


@query(""", z AS (SELECT flow_id, [major_prob, value / 200, CAST(flow_id % 3 AS DOUBLE)] AS x FROM flows), s AS (SELECT flow_id, list_max(x) AS m, list_position(x, list_max(x)) AS i, list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) AS t FROM z)
SELECT flow_id, CASE i WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS label, round(1 / t, 9) AS prob FROM s""")
def inf_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.decoded(F.array("major_prob", F.col("value") / 200, (F.col("flow_id") % 3).cast("double")), ["a", "b", "c"])
    return flows(spark, sf_dir).select("flow_id", d.alias("d")).select("flow_id", F.col("d.label").alias("label"), F.round("d.prob", 9).alias("prob"))


@query("""SELECT count(*) AS flow_count, count(*) FILTER (major_label = 'benign') AS benign_count, count(*) FILTER (major_label <> 'benign') AS attack_count, count(*) FILTER (major_label <> 'benign' AND major_prob >= 0.5) AS high_risk_count,
count(*) FILTER (major_label <> 'benign') / CAST(count(*) AS DOUBLE) AS attack_ratio FROM flows""")
def agg_pred_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.file_totals(flows(spark, sf_dir))


@query("SELECT flow_id, host, major_label, major_prob FROM flows WHERE major_label <> 'benign' AND major_prob >= 0.5 ORDER BY major_prob DESC, flow_id LIMIT 20")
def top_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_flows(flows(spark, sf_dir).select("flow_id", "host", "major_label", "major_prob"), "flow_id")


_HOSTS = """SELECT host, count(*) AS flow_count, count(*) FILTER (major_label <> 'benign') AS attack_count, count(*) FILTER (major_label <> 'benign' AND major_prob >= 0.5) AS high_risk_count, max(major_prob) AS max_prob, count(*) FILTER (major_label <> 'benign') / CAST(count(*) AS DOUBLE) AS attack_ratio FROM flows GROUP BY 1"""


@query(f", h AS ({_HOSTS}) SELECT h.*, (SELECT count(*) FROM flows f WHERE f.host = h.host AND f.major_label = 'scan') AS scans FROM h")
def agg_host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.host_summary(flows(spark, sf_dir)).withColumn("scans", F.coalesce(F.try_element_at("label_counts", F.lit("scan")), F.lit(0)).cast("long")).drop("label_counts")


@query(f"SELECT * FROM ({_HOSTS}) ORDER BY high_risk_count DESC, attack_count DESC, max_prob DESC, flow_count DESC, host LIMIT 20")
def top_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_hosts(summary.host_summary(flows(spark, sf_dir))).drop("label_counts")


@query("""SELECT count(*) AS "rows", count(*) FILTER (major_label = 'scan') AS target_rows, count(DISTINCT host) AS hosts, count(DISTINCT host) FILTER (major_label = 'scan') AS target_hosts,
round(quantile_cont(payload_byte_length, 0.5) FILTER (major_label = 'scan'), 6) AS p50, round(quantile_cont(payload_byte_length, 0.9) FILTER (major_label = 'scan'), 6) AS p90, CAST(max(payload_byte_length) FILTER (major_label = 'scan') AS DOUBLE) AS p100 FROM flows""")
def agg_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = summary.overview(flows(spark, sf_dir), "scan")
    return o.select("rows", "target_rows", "hosts", "target_hosts", *[F.round(F.col("quantiles")[k], 6).alias(n) for k, n in ((1, "p50"), (2, "p90"), (4, "p100"))])


@query(""", v AS (SELECT 'warning' AS severity, 'empty_payload' AS code, count(*) FILTER (payload_byte_length <= 0) AS n FROM flows UNION ALL
SELECT 'error', 'null_label', count(*) FILTER (major_label IS NULL) FROM flows UNION ALL SELECT 'error', 'duplicate_rows', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM flows GROUP BY host, event_type)) SELECT * FROM v WHERE n > 0""")
def val_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).withColumns({"packet_directions": F.array(F.lit("fwd")), "packet_lengths": F.array(F.lit(1))})
    return audit.validation(df, ["flow_id", "major_label"], "major_label", "packet_count", "payload_byte_length", "host", "event_type", "packet_directions", "packet_lengths")


@query("SELECT CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM flows GROUP BY host, event_type)")
def set_dup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).groupBy("host", "event_type").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("n"))


@query(", a AS (SELECT flow_id, host, event_type FROM flows WHERE flow_id % 3 < 2), b AS (SELECT flow_id, host, NULL AS event_type FROM flows WHERE flow_id % 3 > 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT flow_id, host, event_type FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY event_type NULLS FIRST) AS n FROM u) WHERE n = 1")
def set_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    return summary.merged_shards([df.where("flow_id % 3 < 2").select("flow_id", "host", "event_type"), df.where("flow_id % 3 > 0").select("flow_id", "host")], ["flow_id"], ["event_type"])


@query("SELECT host, flow_id, major_label FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY start_time, flow_id) AS n FROM flows) WHERE n = 1")
def set_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.first_rows(flows(spark, sf_dir), "host", ["start_time", "flow_id"]).select("host", "flow_id", "major_label")


@query("SELECT event_type, flow_id FROM flows UNION ALL SELECT NULL, user_id FROM flows")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir)
    return df.select("event_type", "flow_id").unionByName(df.select(F.col("user_id").alias("flow_id")), allowMissingColumns=True)


@query("SELECT f.flow_id, f.split, o.o_orderstatus AS pred FROM flows f JOIN orders o ON f.flow_id = o.o_orderkey")
def jn_pred_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, o = flows(spark, sf_dir).select("flow_id", "split"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("flow_id"), F.col("o_orderstatus").alias("pred"))
    return summary.joined_predictions(f, o.join(f.select("flow_id"), "flow_id", "left_semi"), "flow_id")


@query(f", g AS (SELECT host, {'{}'} AS split FROM (SELECT DISTINCT host FROM flows)) SELECT f.flow_id, g.split FROM flows f JOIN g USING (host)".format("CASE WHEN CAST(CAST('0x' || substr(sha1(host), 1, 12) AS UBIGINT) AS BIGINT) % 10000 / 10000.0::DOUBLE < 0.7::DOUBLE THEN 'train' WHEN CAST(CAST('0x' || substr(sha1(host), 1, 12) AS UBIGINT) AS BIGINT) % 10000 / 10000.0::DOUBLE < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END"))
def jn_group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).drop("split")
    groups = df.select("host").distinct().withColumn("split", splits.hash_split(F.col("host")))
    return splits.assigned(df, groups, "host").select("flow_id", "split")
