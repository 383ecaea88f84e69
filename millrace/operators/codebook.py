"""Byte-chunk codebooks by frequency and by label lift, and their use."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A codebook's token is this, its place in four digits, and a bracket.
TOKEN_PREFIX = "[SCE_"


def chunks(data: Column, size: int, drop_zero: bool = True) -> Column:
    """Whole, non-overlapping pieces of binary data; those of zero bytes only are left out."""
    count = F.floor(F.length(data) / size).cast("int")
    pieces = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.substring(data, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))
    return F.filter(pieces, lambda p: p != F.lit(bytes(size))) if drop_zero else pieces


def frequent(df: DataFrame, data: str, size: int = 4, entries: int = 256, least: int = 2, drop_zero: bool = True) -> DataFrame:
    """Chunks by count, at least least times; columns place, pattern_hex, count."""
    n = df.select(F.explode(chunks(F.col(data), size, drop_zero)).alias("c")).groupBy("c").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    return _placed(n.select(F.lower(F.hex("c")).alias("pattern_hex"), "count"), [F.desc("count"), "pattern_hex"], entries)


def lifted(df: DataFrame, data: str, label: str, size: int = 4, entries: int = 256, least: int = 2, target: str | None = None, drop_zero: bool = True) -> DataFrame:
    """Chunks by how much they move a label's share: of target signed, else the largest change of any label; rows count a chunk once.

    Chunks are text here: distinct elements of an array are found by hash for text, and by comparing all pairs for binary data.
    """
    rows = df.select(F.col(label).cast("string").alias("label"), F.array_distinct(F.transform(chunks(F.col(data), size, drop_zero), lambda c: F.lower(F.hex(c)))).alias("cs"))
    labels = rows.groupBy("label").agg(F.count("*").alias("ln"))
    total = rows.agg(F.count("*").alias("total"))
    per = rows.select("label", F.explode("cs").alias("c")).groupBy("c", "label").agg(F.count("*").alias("n"))
    # A chunk's counts of the labels it has; a label that it lacks has the share 0, so the largest of those by share is enough.
    shares = labels.join(F.broadcast(total)).select("label", (F.col("ln") / F.col("total")).alias("share"))
    known = F.map_from_entries(F.collect_list(F.struct("label", "n")))
    by_chunk = per.groupBy("c").agg(F.sum("n").alias("count"), known.alias("m")).where(F.col("count") >= least)
    all_shares = shares.agg(F.array_sort(F.collect_list(F.struct("label", "share"))).alias("shares"))
    wanted = F.col("shares") if target is None else F.filter("shares", lambda s: s["label"] == target)
    change = lambda s: F.coalesce(F.try_element_at(F.col("m"), s["label"]), F.lit(0)) / F.col("count") - s["share"]
    scored = F.transform(wanted, lambda s: F.struct((change(s) if target is not None else F.abs(change(s))).alias("score"), s["label"].alias("label")))
    # Labels are few (one small row); of equal scores the first label in order stands.
    best = F.aggregate(scored, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("label")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    out = by_chunk.join(F.broadcast(all_shares)).withColumn("b", best).select(F.col("c").alias("pattern_hex"), "count", F.col("b.score").alias("score"), F.col("b.label").alias("label"))
    if target is not None:
        out = out.where("score > 0")
    return _placed(out, [F.desc("score"), F.desc("count"), "pattern_hex"], entries)


def _placed(df: DataFrame, order: list, entries: int) -> DataFrame:
    """The first entries rows in order with their place; only so many rows are left to number."""
    top = df.orderBy(*order).limit(entries)
    return top.withColumn("place", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1).cast("int"))


def with_tokens(book: DataFrame) -> DataFrame:
    return book.withColumn("token", F.concat(F.lit(TOKEN_PREFIX), F.format_string("%04d", "place"), F.lit("]")))


def encoded(df: DataFrame, data: str, book: list[tuple[str, str]], size: int) -> Column:
    """Array of tokens: a chunk's token if the book has it, else its bytes' tokens. book: (pattern_hex, token), of bounded size."""
    data_ = F.col(data)
    count = F.ceil(F.length(data_) / size).cast("int")
    pieces = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.substring(data_, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))
    names = F.create_map(*[F.lit(x) for row in book for x in row]) if book else F.create_map().cast("map<string,string>")

    def tokens(piece: Column) -> Column:
        text = F.lower(F.hex(piece))
        single = F.transform(F.sequence(F.lit(1), F.length(text), F.lit(2)), lambda k: F.concat(F.lit("b_"), F.substring(text, k, F.lit(2))))
        return F.when(F.try_element_at(names, text).isNotNull(), F.array(F.try_element_at(names, text))).otherwise(single)

    return F.flatten(F.transform(pieces, tokens))


def to_json(book: DataFrame, kind: str, size: int) -> str:
    """A codebook as JSON text; its rows are bounded by the number of entries."""
    return json.dumps({"kind": kind, "chunk_size": size, "entries": [r.asDict() for r in with_tokens(book).orderBy("place").collect()]}, sort_keys=True)


def from_json(spark, text: str) -> DataFrame:
    raw = json.loads(text)
    rows = [(e["place"], e["pattern_hex"], e["count"], e.get("score"), e.get("label"), e["token"]) for e in raw["entries"]]
    return spark.createDataFrame(rows, "place int, pattern_hex string, count long, score double, label string, token string")
