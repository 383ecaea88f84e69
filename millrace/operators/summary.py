"""Summaries of predictions by flow and host, and set operations on shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_totals(df: DataFrame, label: str = "major_label", prob: str = "major_prob", risk: float = 0.5) -> DataFrame:
    """One row: flows, benign and attack flows, their ratio, high-risk flows."""
    attack = F.col(label) != "benign"
    n = df.agg(F.count("*").alias("flow_count"), F.count_if(~attack).alias("benign_count"), F.count_if(attack).alias("attack_count"), F.count_if(attack & (F.coalesce(F.col(prob), F.lit(0.0)) >= risk)).alias("high_risk_count"))
    return n.withColumn("attack_ratio", F.col("attack_count") / F.greatest("flow_count", F.lit(1)))


def top_flows(df: DataFrame, key: str, label: str = "major_label", prob: str = "major_prob", risk: float = 0.5, top: int = 20) -> DataFrame:
    """Attack flows of at least risk by probability; of equal ones the first in key order."""
    return df.where((F.col(label) != "benign") & (F.col(prob) >= risk)).orderBy(F.desc(prob), key).limit(top)


def host_summary(df: DataFrame, host: str = "host", label: str = "major_label", prob: str = "major_prob", risk: float = 0.5) -> DataFrame:
    """Per host: flows, attacks, high-risk flows, highest probability, ratio, flows by label."""
    per = df.groupBy(host, label).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col(prob), F.lit(0.0))).alias("p"), F.count_if((F.col(label) != "benign") & (F.col(prob) >= risk)).alias("h"))
    attack = F.col(label) != "benign"
    out = per.groupBy(host).agg(
        F.sum("n").alias("flow_count"), F.coalesce(F.sum(F.when(attack, F.col("n"))), F.lit(0)).alias("attack_count"), F.sum("h").alias("high_risk_count"), F.max("p").alias("max_prob"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("label_counts"),
    )
    return out.withColumn("attack_ratio", F.col("attack_count") / F.greatest("flow_count", F.lit(1)))


def top_hosts(summary: DataFrame, host: str = "host", top: int = 20) -> DataFrame:
    return summary.orderBy(F.desc("high_risk_count"), F.desc("attack_count"), F.desc("max_prob"), F.desc("flow_count"), host).limit(top)


def overview(df: DataFrame, target: str, label: str = "major_label", host: str = "host", value: str = "payload_byte_length") -> DataFrame:
    """One row: rows, target rows, hosts, target hosts, and quantiles of value of target rows."""
    hit = F.col(label) == target
    return df.agg(F.count("*").alias("rows"), F.count_if(hit).alias("target_rows"), F.countDistinct(host).alias("hosts"), F.countDistinct(F.when(hit, F.col(host))).alias("target_hosts"), F.percentile(F.when(hit, F.col(value)), F.array(*map(F.lit, (0.0, 0.5, 0.9, 0.99, 1.0)))).alias("quantiles"))


def cooccurrence(df: DataFrame, target: str, label: str = "major_label", flag: str = "in_target_window") -> DataFrame:
    """One row: rows in windows that hold a target, targets and benign rows among them."""
    f = F.col(flag)
    return df.agg(F.count_if(f).alias("rows_in_windows"), F.count_if(f & (F.col(label) == target)).alias("targets_in_windows"), F.count_if(f & (F.col(label) == "benign")).alias("benign_in_windows"))


def merged_shards(shards: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Shards with columns that some lack as null, one row for each of keys: the first in order."""
    whole = shards[0]
    for s in shards[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    row = F.struct(*order, *[c for c in whole.columns if c not in order])
    return whole.groupBy(*keys).agg(F.min(row).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in whole.columns])


def joined_predictions(split: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Inner join, one to one; an error if keys repeat or any row of either side has no match."""
    both = split.groupBy(key).agg(F.count("*").alias("n")).join(predictions.groupBy(key).agg(F.count("*").alias("m")), key, "full")
    bad = both.agg(F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("left"), F.count_if(F.coalesce("m", F.lit(0)) != 1).alias("right")).first()
    if bad["left"] or bad["right"]:
        raise ValueError(f"{bad['left']} keys not once in the split, {bad['right']} not once in the predictions")
    return split.join(predictions, key)
