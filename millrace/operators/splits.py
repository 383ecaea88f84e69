"""Deterministic train, validation and test splits, class caps, rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import stable_bucket

TRAIN, VAL = 0.7, 0.15
#: Seconds of a stretch of time within which groups are put in order by one task.
STRETCH = 600


def seeded(seed: int, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])


def hash_split(group: Column, train: float = TRAIN, val: float = VAL) -> Column:
    """Split of a group by its stable bucket alone."""
    bucket = stable_bucket(group) / 10_000
    return F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test")


def _sliced(n: Column, position: Column, train: float, val: float) -> Column:
    """Split of a position (from 0) among n ordered groups: 1 is train; 2 train, test; 3 and more at least one of each."""
    n_train = F.floor(n * F.lit(train)).cast("int")
    n_val = F.floor(n * F.lit(val)).cast("int")
    # At least one for validation and test, taken from training.
    n_val = F.greatest(n_val, F.lit(1))
    n_train = F.least(F.greatest(n_train, F.lit(1)), n - n_val - 1)
    usual = F.when(position < n_train, "train").when(position < n_train + n_val, "val").otherwise("test")
    return F.when(n == 1, "train").when(n == 2, F.when(position == 0, "train").otherwise("test")).otherwise(usual)


def first_rows(df: DataFrame, group: str, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """Of each group, the columns (all if none are named) of its first row in the order; only the first row so far is held for a group."""
    names = [c for c in (df.columns if columns is None else columns) if c != group]
    return df.groupBy(group).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r")).select(group, "_r.*")


def ranked(groups: DataFrame, stratum: str, coarse: Column, order: list[Column]) -> DataFrame:
    """groups with _p, the place (from 0) in the stratum by coarse and then order, and _c, the stratum's groups.

    coarse cuts a stratum's order into stretches: their sizes are counted first, so that rows are only ordered within a stretch, and
    no task orders a whole stratum.
    """
    rows = groups.withColumn("_k", coarse)
    sizes = rows.groupBy(stratum, "_k").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(stratum).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(stratum).alias("_s"), F.col("_k").alias("_k2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(stratum)).alias("_c"))
    placed = rows.withColumn("_i", F.row_number().over(Window.partitionBy(stratum, "_k").orderBy(*order)) - 1)
    both = placed.join(offsets, F.col(stratum).eqNullSafe(F.col("_s")) & F.col("_k").eqNullSafe(F.col("_k2")))
    return both.withColumn("_p", F.col("_before") + F.col("_i")).drop("_s", "_k", "_k2", "_i", "_before")


def assigned(df: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """df with the split of its group."""
    return df.join(groups.select(group, "split"), group, "left")


def stratified_hash_split(df: DataFrame, group: str, stratum: str, order: list, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """Per group: stratum (of its first row) and split; groups of a stratum are put in hash order and cut by ratio."""
    groups = first_rows(df, group, order, [stratum])
    bucket = stable_bucket(F.concat_ws(":", stratum, group))
    return ranked(groups, stratum, bucket, [F.col(group)]).select(group, stratum, _sliced(F.col("_c"), F.col("_p"), train, val).alias("split"))


def time_ordered_split(df: DataFrame, group: str, stratum: str, time: str, order: list, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """The same, with groups in order of their earliest row's time."""
    groups = first_rows(df, group, [time, *order], [stratum, time])
    by = [F.col(time), stable_bucket(F.concat_ws(":", stratum, group)), F.col(group)]
    return ranked(groups, stratum, F.floor(F.col(time) / STRETCH), by).select(group, stratum, _sliced(F.col("_c"), F.col("_p"), train, val).alias("split"))


def time_block_split(df: DataFrame, group: str, stratum: str, time: str, order: list, block: int = 512, seed: int = 13, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """Groups of a stratum in blocks of time; blocks in hash order go to train, val and test once each, then to the split that lacks most.

    Only blocks, not groups, are gathered for the sequential rule: a stratum's rows divided by the block's size.
    """
    groups = first_rows(df, group, [time, *order], [stratum, time])
    rows = ranked(groups, stratum, F.floor(F.col(time) / STRETCH), [F.col(time), F.col(group)])
    size = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("_c") / 3))).cast("long")
    rows = rows.withColumn("_size", size).withColumn("_block", F.floor(F.col("_p") / F.col("_size")))
    last, tail = F.floor((F.col("_c") - 1) / F.col("_size")), F.col("_c") % F.col("_size")
    short = (tail > 0) & (tail < F.greatest(F.lit(2), F.floor(F.col("_size") / 2))) & (last > 0)
    rows = rows.withColumn("_block", F.when(short & (F.col("_block") == last), last - 1).otherwise(F.col("_block")))
    blocks = rows.groupBy(stratum, "_block").agg(F.count("*").alias("n"), F.min(time).alias("first"))
    blocks = blocks.withColumn("k", stable_bucket(seeded(seed, F.col(stratum), F.col("_block"))))
    dealt = blocks.groupBy(stratum).agg(F.array_sort(F.collect_list(F.struct("k", "first", F.col("_block").alias("b"), "n"))).alias("l"), F.sum("n").alias("total"))
    targets = [F.floor(F.col("total") * F.lit(train)), F.floor(F.col("total") * F.lit(val))]
    targets.append(F.col("total") - targets[0] - targets[1])
    many = F.size("l") >= 3

    def step(done: Column, x: Column) -> Column:
        lack = [F.struct((done[f"s{i}"] - targets[i]).alias("d"), done[f"s{i}"].alias("a"), F.lit(i).alias("i")) for i in range(3)]
        choice = F.when(many & (done["at"] < 3), done["at"]).otherwise(F.least(*lack)["i"])
        sums = [(done[f"s{i}"] + F.when(choice == i, x["n"]).otherwise(0)).alias(f"s{i}") for i in range(3)]
        return F.struct((done["at"] + 1).alias("at"), *sums, F.array_append(done["out"], F.struct(x["b"].alias("b"), choice.alias("c"))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), *[F.lit(0).cast("long").alias(f"s{i}") for i in range(3)], F.array().cast("array<struct<b: bigint, c: int>>").alias("out"))
    placed = dealt.select(stratum, F.explode(F.aggregate("l", start, step, lambda d: d["out"])).alias("x")).select(stratum, F.col("x.b").alias("_block"), F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("x.c") + 1).alias("split"))
    return rows.join(placed, [stratum, "_block"]).select(group, stratum, F.col("_block").alias("block"), "split")


def class_cap(df: DataFrame, label: str, key: str, cap: int, seed: int = 13) -> DataFrame:
    """At most cap rows of each class, chosen in the order of a seeded digest; all of them if cap is 0 or less."""
    if cap <= 0:
        return df
    order = Window.partitionBy(label).orderBy(F.sha1(seeded(seed, F.col(key))), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def rebalanced(df: DataFrame, label: str, group: str, split: str, least: int = 10, most: int = 50, seed: int = 13) -> DataFrame:
    """Labels with 3 * least to most rows in at least three groups: groups in hash order fill val, then test, to least rows; the rest is train.

    It moves rows of the label only, so a group with several labels can end up in two splits.
    """
    sizes = df.groupBy(label, group).agg(F.count("*").alias("_n"))
    per = sizes.groupBy(label).agg(F.sum("_n").alias("_rows"), F.count("*").alias("_groups")).where(F.col("_rows").between(3 * least, most) & (F.col("_groups") >= 3))
    before = Window.partitionBy(label).orderBy(stable_bucket(seeded(seed, F.col(label), F.col(group))), group).rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.join(per, label).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # A split takes groups until it holds least rows, so where it ends depends on the groups before: val's end is the first sum of at least least.
    by_label = Window.partitionBy(label)
    ends = moved.withColumn("_val_end", F.min(F.when(F.col("_before") + F.col("_n") >= least, F.col("_before") + F.col("_n"))).over(by_label))
    new = F.when(F.col("_before") < F.col("_val_end"), "val").when(F.col("_before") < F.col("_val_end") + least, "test").otherwise("train")
    choice = ends.select(label, group, new.alias("_new"))
    return df.join(choice, [label, group], "left").withColumn(split, F.coalesce("_new", F.col(split))).drop("_new")


def submode_stratum(df: DataFrame, label: str, shape: str, least: int = 10) -> DataFrame:
    """df with stratum: the label, with its shape behind it where the label has rows enough."""
    many = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(3 * least, 20)).select("_l")
    out = df.join(many, F.col(label) == F.col("_l"), "left")
    return out.withColumn("stratum", F.when(F.col("_l").isNotNull(), F.concat_ws("::", label, shape)).otherwise(F.col(label))).drop("_l")
