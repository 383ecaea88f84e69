"""Window operators over flows of one host: strictly prior context, trailing maxima, tumbling buckets, adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(seconds: Column) -> Column:
    return F.round(seconds * F.lit(1e6)).cast("long")


def prior(value: Column, keys: list[str], time: str, order: str, seconds: int) -> Column:
    """Sum of value over rows of the same keys within the last seconds (edge included) and before this row in (time, order).

    A range frame holds all rows of equal time; those from this row on are taken off again.
    """
    frame = Window.partitionBy(*keys).orderBy(time).rangeBetween(-seconds * MICROS, 0)
    peers = Window.partitionBy(*keys, time).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.sum(value).over(frame) - F.sum(value).over(peers), F.lit(0)).cast("long")


def with_prior_distinct(df: DataFrame, name: str, value: str, keys: list[str], time: str, order: str, seconds: int) -> DataFrame:
    """df with name: distinct values (null being one of them) over the same rows as prior().

    A row counts from itself on, until its value comes again or it is too old, whichever is first. So three marks a row, a question, a
    beginning and an end, are summed up in order; nothing is held but the sum.
    """
    same = Window.partitionBy(*keys, value).orderBy(time, order)
    own = df.withColumns({"_next": F.lead(time).over(same), "_next_order": F.lead(order).over(same)})
    until = F.col(time) + seconds * MICROS
    replaced = F.col("_next") <= until
    mark = lambda t, late, o, kind, plus: F.struct(t.alias("t"), F.lit(late).alias("late") if isinstance(late, int) else late.alias("late"), o.alias("o"), F.lit(kind).alias("kind"), F.lit(plus).alias("plus"))
    at, its = F.col(time), F.col(order)
    end = mark(F.when(replaced, F.col("_next")).otherwise(until), F.when(replaced, 0).otherwise(1), F.when(replaced, F.col("_next_order")).otherwise(its), 1, -1)
    marks = own.select(*keys, F.explode(F.array(mark(at, 0, its, 1, 1), end)).alias("_m"))
    asked = df.withColumn("_m", mark(at, 0, its, 0, 0))
    # A question comes before the beginnings and ends of its own place, and ends by age behind all rows of their time.
    up_to = Window.partitionBy(*keys).orderBy("_m.t", "_m.late", "_m.o", "_m.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asked.unionByName(marks, allowMissingColumns=True).withColumn(name, F.sum("_m.plus").over(up_to))
    return rows.where("_m.kind = 0").drop("_m")


def flow_context(df: DataFrame, keys: list[str], time: str, order: str, connection: str, payload: str, port: str, host: str) -> DataFrame:
    """The seven context features of each flow: counts over 60 and 300 seconds before it, by kind, and distinct targets."""
    is_reset, is_control = F.col(connection) == "tcp_reset_or_refused", F.col(connection) == "tcp_control_only"
    count = lambda c, s: prior(c.cast("long"), keys, time, order, s)
    out = df.withColumns(
        {
            "context_host_flow_count_60s": count(F.lit(1), 60), "context_host_flow_count_300s": count(F.lit(1), 300),
            "context_host_reset_count_60s": count(is_reset, 60), "context_host_control_count_60s": count(is_control, 60),
            "context_host_payload0_count_60s": count(F.coalesce(F.col(payload), F.lit(0)) <= 0, 60),
        }
    )
    for name, value in (("context_host_distinct_dport_60s", port), ("context_host_distinct_dhost_60s", host)):
        out = with_prior_distinct(out, name, value, keys, time, order, 60)
    return out


def trailing_max(score: str, keys: list[str], time: str, order: str, seconds: int) -> Column:
    """Highest score of the rows of the last seconds up to this one; of equal times, those up to this one in order."""
    earlier = Window.partitionBy(*keys).orderBy(time).rangeBetween(-seconds * MICROS, -1)
    peers = Window.partitionBy(*keys, time).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.greatest(F.max(score).over(earlier), F.max(score).over(peers))


def bucket_start(time: Column, seconds: int) -> Column:
    return (F.floor(time / seconds) * seconds).cast("long")


def score_buckets(df: DataFrame, keys: list[str], time: str, score: str, target: str, seconds: int) -> DataFrame:
    """Per keys and tumbling window: rows, target rows, highest score, whether any row is a target."""
    hit = F.col(target).cast("long")
    return df.groupBy(*keys, bucket_start(F.col(time), seconds).alias("window_start")).agg(
        F.count("*").alias("rows"), F.sum(hit).alias("target_rows"), F.max(score).alias("max_score"), (F.max(hit) > 0).alias("has_target")
    )


def window_flag(df: DataFrame, buckets: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """df with in_target_window: whether the window of its keys holds a target; false where there is no window."""
    at = df.withColumn("window_start", bucket_start(F.col(time), seconds))
    return at.join(buckets.select(*keys, "window_start", F.col("has_target").alias("in_target_window")), [*keys, "window_start"], "left").withColumn("in_target_window", F.coalesce("in_target_window", F.lit(False)))


def host_windows(df: DataFrame, windows: tuple[int, ...] = (30, 60), top: int = 20, risk: float = 0.5, file: str = "source_file", host: str = "host", time: str = "start_time", label: str = "major_label", prob: str = "major_prob") -> DataFrame:
    """For each window length the top windows of a host by high-risk flows, attacks, highest probability and flows."""
    attack = F.col(label) != "benign"
    sized = df.withColumn("window_seconds", F.explode(F.array(*map(F.lit, windows))))
    start = (F.floor(F.col(time) / F.col("window_seconds")) * F.col("window_seconds")).cast("long")
    per = sized.groupBy("window_seconds", file, host, start.alias("window_start")).agg(
        F.count("*").alias("flow_count"), F.count_if(attack).alias("attack_count"),
        F.count_if(attack & (F.col(prob) >= risk)).alias("high_risk_count"), F.max(prob).alias("max_prob"),
    )
    rank = F.row_number().over(Window.partitionBy("window_seconds").orderBy(F.desc("high_risk_count"), F.desc("attack_count"), F.desc("max_prob"), F.desc("flow_count"), file, host, "window_start"))
    return per.withColumn("attack_ratio", F.col("attack_count") / F.col("flow_count")).withColumn("rank", rank).where(F.col("rank") <= top)


def policy_windows(df: DataFrame, policies: list[tuple[str, int, float]], top: int = 20, file: str = "source_file", host: str = "host", time: str = "start_time", label: str = "major_label", prob: str = "major_prob") -> DataFrame:
    """For each policy (target label, window seconds, threshold) the top windows by hits of the target's probability."""
    rules = F.array(*[F.struct(F.lit(t).alias("target_label"), F.lit(s).alias("window_seconds"), F.lit(h).alias("threshold")) for t, s, h in policies])
    each = df.withColumn("p", F.explode(rules)).select("*", "p.*")
    score = F.when(F.col(label) == F.col("target_label"), F.coalesce(F.col(prob), F.lit(0.0))).otherwise(0.0)
    start = (F.floor(F.col(time) / F.col("window_seconds")) * F.col("window_seconds")).cast("long")
    per = each.withColumn("s", score).groupBy("target_label", "window_seconds", "threshold", file, host, start.alias("window_start")).agg(
        F.count("*").alias("flow_count"), F.count_if(F.col(label) == F.col("target_label")).alias("argmax_count"),
        F.count_if(F.col("s") >= F.col("threshold")).alias("hit_count"), F.max("s").alias("max_target_prob"),
    )
    per = per.withColumn("triggered", F.col("hit_count") > 0)
    rank = F.row_number().over(Window.partitionBy("target_label", "window_seconds", "threshold").orderBy(F.desc("triggered"), F.desc("hit_count"), F.desc("max_target_prob"), F.desc("flow_count"), file, host, "window_start"))
    return per.withColumn("rank", rank).where(F.col("rank") <= top)


def near_pairs(df: DataFrame, keys: list[str], time: str, order: str, seconds: int) -> DataFrame:
    """Adjacent rows of the same keys at most seconds apart: columns earlier, later (orders) and gap."""
    by = Window.partitionBy(*keys).orderBy(time, order)
    pairs = df.withColumns({"earlier": F.lag(order).over(by), "gap": F.col(time) - F.lag(time).over(by)})
    return pairs.where((F.col("gap") >= 0) & (F.col("gap") <= seconds)).select("earlier", F.col(order).alias("later"), "gap")


def near_leaks(df: DataFrame, keys: list[str], time: str, order: str, split: str, seconds: int = 120) -> DataFrame:
    """Adjacent rows of the same keys at most seconds apart that are in different splits."""
    by = Window.partitionBy(*keys).orderBy(time, order)
    pairs = df.withColumns({"earlier": F.lag(order).over(by), "earlier_split": F.lag(split).over(by), "gap": F.col(time) - F.lag(time).over(by)})
    return pairs.where((F.col("gap") <= seconds) & (F.col("earlier_split") != F.col(split))).select("earlier", F.col(order).alias("later"), "earlier_split", F.col(split).alias("later_split"), "gap")
