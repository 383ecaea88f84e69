"""Labels nearest in time, by direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_label(flows: DataFrame, labels: DataFrame, keys: list[str], flow_id: str, flow_time: str, label_time: str, label: str, order: str, tolerance: float) -> DataFrame:
    """For each flow with a match: flow_id, label, delta. Smallest distance; of equal ones the later record, then the first in order
    at or behind the flow and the last before it.

    If the flow or all records of its key have no time, the first record in order matches and delta is null; records without time
    are passed over where others have one.

    Flows and records are cut into stretches of time as long as the tolerance, and each record also goes to the stretches beside its own. In a stretch
    of a key one pass in order carries the last record on to the flows behind it, and one pass back the next record, so no pairs are made, and a
    key with very many rows is as many tasks as it has stretches.
    """
    right = labels.select(*keys, F.col(label_time).cast("double").alias("_t"), F.col(label).alias("_label"), F.col(order).alias("_order"))
    left = flows.select(*keys, F.col(flow_id), F.col(flow_time).cast("double").alias("_t"))
    width = max(float(tolerance), 1.0)
    stretch = F.floor(F.col("_t") / width)
    marks = right.where("_t is not null").select("*", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_s"), F.struct("_t", "_label").alias("_mark"))
    rows = left.where("_t is not null").withColumn("_s", stretch).unionByName(marks.drop("_label"), allowMissingColumns=True)
    by, is_mark = Window.partitionBy(*keys, "_s"), F.col("_mark").isNotNull()
    before = F.last("_mark", ignorenulls=True).over(by.orderBy("_t", is_mark, "_order").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_mark", ignorenulls=True).over(by.orderBy(F.desc("_t"), is_mark.desc(), F.desc("_order")).rowsBetween(Window.unboundedPreceding, -1))
    near = rows.withColumns({"_a": before, "_b": after}).where(~is_mark)
    back, ahead = F.col("_t") - F.col("_a._t"), F.col("_b._t") - F.col("_t")
    best = F.when(ahead <= F.coalesce(back, F.lit(float("inf"))), F.struct(F.col("_b._label").alias("label"), ahead.alias("delta"))).otherwise(F.struct(F.col("_a._label").alias("label"), back.alias("delta")))
    timed = near.select(flow_id, best.alias("m")).select(flow_id, "m.*").where(F.col("delta") <= tolerance)
    first = right.groupBy(*keys).agg(F.min_by("_label", "_order").alias("label"), F.max("_t").alias("_any"))
    untimed = left.join(first, keys).where(F.col("_t").isNull() | F.col("_any").isNull()).select(flow_id, "label", F.lit(None).cast("double").alias("delta"))
    return timed.unionAll(untimed).where(F.col("label").isNotNull())


def two_way_label(flows: DataFrame, labels: DataFrame, ends: tuple[str, str], label_ends: tuple[str, str], flow_id: str, flow_time: str, label_time: str, label: str, order: str, tolerance: float) -> DataFrame:
    """The nearer of the flow's label and that of the reversed flow, equal distances and flows without time going to the first. Adds mode."""
    (a, b), (x, y) = ends, label_ends
    right = labels.select(F.col(x).alias("_x"), F.col(y).alias("_y"), label_time, label, order)
    one = nearest_label(flows.withColumns({"_x": F.col(a), "_y": F.col(b)}), right, ["_x", "_y"], flow_id, flow_time, label_time, label, order, tolerance).withColumn("mode", F.lit("directional"))
    two = nearest_label(flows.withColumns({"_x": F.col(b), "_y": F.col(a)}), right, ["_x", "_y"], flow_id, flow_time, label_time, label, order, tolerance).withColumn("mode", F.lit("directional_reversed"))
    timed = flows.select(flow_id, F.col(flow_time).isNotNull().alias("_timed"))
    rank = F.struct(F.when(F.col("_timed"), F.coalesce("delta", F.lit(float("inf")))).otherwise(0.0), F.col("mode"))
    return one.unionByName(two).join(timed, flow_id).groupBy(flow_id).agg(F.min_by(F.struct("label", "mode", "delta"), rank).alias("m")).select(flow_id, "m.*")


def label_records(raw: DataFrame, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    """raw with its columns' names normalised and aliases resolved; rows with a null or blank label go. Missing columns are an error."""
    from millrace.functions.columns import normalized_name

    df = raw.toDF(*map(normalized_name, raw.columns))
    for name, others in aliases.items():
        found = [c for c in (name, *others) if c in df.columns]
        if found and found[0] != name:
            df = df.withColumnRenamed(found[0], name)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.where(F.trim("label") != "").withColumn("label", F.trim("label"))


def afternoon(seconds: Column, file: Column, files: dict[str, int]) -> Column:
    """Times of label files that write afternoon hours as 1 to 7 (or 1 to 11): 12 hours later where the hour is below the file's own limit.

    files: part of a file's name, in lower case, and the hour below which its times are moved. The first one that fits counts.
    """
    hour = F.floor(F.pmod(seconds, F.lit(86400.0)) / 3600)
    limit = F.coalesce(*[F.when(F.lower(file).contains(name), F.lit(below)) for name, below in files.items()], F.lit(0))
    return F.when(hour < limit, seconds + 12 * 3600).otherwise(seconds)


def label_time(text: Column) -> Column:
    """Day-first times, then year-first, then month-first ones; seconds since 1970, null if no form fits."""
    forms = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm")
    return F.coalesce(*[F.unix_micros(F.try_to_timestamp(text, F.lit(f))) for f in forms]) / F.lit(1e6)
