"""Leakage, coverage and validity reports over split flow tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, nulls left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def flat_counts(df: DataFrame, column: str) -> DataFrame:
    """Occurrences by element of a list column."""
    return df.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def support(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """Rows by split and value, null values as text."""
    return df.groupBy(split, F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count("*").alias("n"))


def flat_support(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    return df.select(split, F.explode(column).alias("value")).groupBy(split, "value").agg(F.count("*").alias("n"))


def flow_leaks(df: DataFrame, flow: str, split: str = "split") -> DataFrame:
    """Flows in more than one split, with their splits."""
    found = df.groupBy(flow).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.where(F.size("splits") > 1)


def overlaps(df: DataFrame, value: Column, split: str = "split", sample: int = 10) -> DataFrame:
    """For each pair of splits: how many distinct values are in both, and the first of them in order."""
    sets = df.select(value.alias("v"), split).where(F.col("v").isNotNull()).distinct()
    per = sets.groupBy("v").agg(*[F.max(F.col(split) == s).alias(s) for s in SPLITS])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    each = per.select("v", F.explode(F.filter(F.array(*[F.when(F.col(a) & F.col(b), f"{a}/{b}") for a, b in pairs]), lambda x: x.isNotNull())).alias("pair"))
    named = df.sparkSession.createDataFrame([(f"{a}/{b}",) for a, b in pairs], "pair string")
    # Only the first few of each pair are kept, whatever their number.
    first = each.groupBy("pair").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    return named.join(first, "pair", "left").select("pair", F.coalesce("n", F.lit(0)).alias("n"), "first")


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right does not have."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def label_grid(df: DataFrame, labels: list[str], splits: tuple[str, ...]) -> DataFrame:
    names = F.array(*map(F.lit, labels))
    return df.sparkSession.range(1).select(F.explode(names).alias("label")).select("label", F.explode(F.array(*map(F.lit, splits))).alias("split"))


def low_support(df: DataFrame, label: str, labels: list[str], least: int, splits: tuple[str, ...] = ("val", "test"), split: str = "split") -> DataFrame:
    """Labels of a list with fewer than least rows in a split, 0 where they are missing."""
    n = df.groupBy(F.col(label).alias("label"), F.col(split).alias("split")).agg(F.count("*").alias("n"))
    return label_grid(df, labels, splits).join(n, ["label", "split"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).where(F.col("n") < least)


def missing_labels(df: DataFrame, label: str, labels: list[str], split: str = "split") -> DataFrame:
    """Labels without rows in a split, and whether the label has fewer than three rows in all."""
    low = low_support(df, label, labels, 1, SPLITS, split).select("label", "split")
    total = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("total"))
    return low.join(total, "label", "left").select("label", "split", F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("total", F.lit(0)) < 3).alias("too_few"))


def split_summary(df: DataFrame, flow: str, packets: str, truncated: str, split: str = "split") -> DataFrame:
    """Per split: rows, flows, smallest, median and largest packet count, truncated rows and their share."""
    return df.groupBy(split).agg(
        F.count("*").alias("rows"), F.countDistinct(flow).alias("flows"), F.min(packets).alias("min_packets"), F.median(packets).alias("median_packets"), F.max(packets).alias("max_packets"),
        F.count_if(F.col(truncated)).alias("truncated_rows"), (F.count_if(F.col(truncated)) / F.count("*")).alias("truncation_ratio"),
    )


def truncation(df: DataFrame, truncated: str, label: str, split: str = "split") -> DataFrame:
    """Truncated rows and their share by split and label."""
    return df.groupBy(split, label).agg(F.count("*").alias("rows"), F.count_if(F.col(truncated)).alias("truncated_rows"), (F.count_if(F.col(truncated)) / F.count("*")).alias("ratio"))


def shape_coverage(df: DataFrame, label: str, shape: str, split: str = "split", least_train: int = 100, least_eval: int = 100, most_ratio: float = 0.2, least_ambiguous: int = 50, benign: str = "benign") -> DataFrame:
    """Per label and evaluation split: rows whose shape training lacks for the label, those of them that training has for another label, and whether that blocks."""
    n = df.groupBy(split, label, shape).agg(F.count("*").alias("n"))
    train = n.where(F.col(split) == "train")
    own = train.select(label, shape, F.lit(True).alias("seen"))
    other = train.groupBy(shape).agg(F.countDistinct(label).alias("labels"))
    # A shape that training lacks for the label but has at all is there under another label.
    rows = n.where((F.col(split) != "train") & (F.lower(label) != benign)).join(own, [label, shape], "left").join(other, shape, "left")
    unseen = F.col("seen").isNull()
    per = rows.groupBy(split, label).agg(
        F.sum("n").alias("eval_rows"), F.coalesce(F.sum(F.when(unseen, F.col("n"))), F.lit(0)).alias("unseen_rows"),
        F.coalesce(F.sum(F.when(unseen & F.col("labels").isNotNull(), F.col("n"))), F.lit(0)).alias("ambiguous_rows"),
    )
    sizes = train.groupBy(label).agg(F.sum("n").alias("train_rows"))
    out = per.join(sizes, label, "left").withColumn("train_rows", F.coalesce("train_rows", F.lit(0)))
    ratio = F.col("unseen_rows") / F.col("eval_rows")
    enough = (F.col("train_rows") >= least_train) & (F.col("eval_rows") >= least_eval)
    return out.withColumns({"unseen_ratio": ratio, "blocking": enough & (ratio > most_ratio) & (F.col("ambiguous_rows") >= least_ambiguous)})


def validation(df: DataFrame, required: list[str], label: str, packets: str, payload: str, flow: str, view: str, directions: str, lengths: str) -> DataFrame:
    """Issues of a flow table: severity, code, n; one aggregate over the rows, and one for duplicates. Missing columns come first."""
    missing = [c for c in required if c not in df.columns]
    issues = df.sparkSession.createDataFrame([("error", f"missing_column:{c}", 1) for c in missing], "severity string, code string, n long")
    if missing:
        return issues
    n = df.agg(
        F.count("*").alias("rows"), F.count_if(F.col(label).isNull()).alias("null_label"), F.count_if(F.col(packets) <= 0).alias("no_packets"), F.count_if(F.coalesce(F.col(payload), F.lit(0)) <= 0).alias("empty_payload"),
        F.count_if(F.size(directions) != F.size(lengths)).alias("length_mismatch"),
    )
    twice = df.groupBy(flow, view).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"))
    kinds = [("error", "empty_table", F.when(F.col("rows") == 0, 1).otherwise(0)), ("error", "null_label", F.col("null_label")), ("error", "no_packets", F.col("no_packets")), ("warning", "empty_payload", F.col("empty_payload")), ("error", "length_mismatch", F.col("length_mismatch"))]
    rows = n.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), v.cast("long").alias("n")) for s, c, v in kinds])).alias("x")).select("x.*")
    dup = twice.select(F.lit("error").alias("severity"), F.lit("duplicate_rows").alias("code"), F.col("duplicate_rows").cast("long").alias("n"))
    return rows.unionAll(dup).where("n > 0")


def audit(df: DataFrame, flow: str, digest: str, file: str, split: str = "split") -> DataFrame:
    """One row per check: name, n, and whether it makes a split unfit."""
    parts = [flow_leaks(df, flow, split).agg(F.count("*").alias("n")).select(F.lit("flow_leak").alias("check"), "n", (F.col("n") > 0).alias("blocking"))]
    for name, value, blocks in (("digest_overlap", F.col(digest), True), ("file_overlap", F.col(file), False)):
        parts.append(overlaps(df, value, split).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(name).alias("check"), "n", (F.lit(blocks) & (F.col("n") > 0)).alias("blocking")))
    return reduce(DataFrame.unionAll, parts)


def match_coverage(df: DataFrame, label: str, matched: Column, least: float) -> DataFrame:
    """Per label: rows, matched rows, ratio, and whether it falls below least (of the rows, rounded up, one at least)."""
    per = df.groupBy(label).agg(F.count("*").alias("rows"), F.count_if(matched).alias("matched"))
    need = F.greatest(F.ceil(F.col("rows") * F.lit(least)), F.lit(1)).cast("long")
    return per.withColumns({"ratio": F.col("matched") / F.col("rows"), "needed": need, "failed": F.col("matched") < need})


def dataset_stats(df: DataFrame, flow: str, payload: str, truncated: str) -> DataFrame:
    """One row: rows, flows, truncated rows, rows without payload, smallest, median and largest payload."""
    return df.agg(
        F.count("*").alias("rows"), F.countDistinct(flow).alias("flows"), F.count_if(F.col(truncated)).alias("truncated_rows"), F.count_if(F.col(payload) <= 0).alias("empty_rows"),
        F.min(payload).alias("min_payload"), F.median(payload).alias("median_payload"), F.max(payload).alias("max_payload"),
    )


def lower_median(df: DataFrame, value: str) -> DataFrame:
    """One row: smallest value, lower median, largest value."""
    return df.agg(F.min(value).alias("min"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").cast("long").alias("median"), F.max(value).alias("max"))
