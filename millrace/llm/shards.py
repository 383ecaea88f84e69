"""Sharding by histogram sort.

Rows are ordered by a key, doc_id with a row number behind it, so that no two rows share a key and one
doc_id with a third of all rows can still be cut. Each round counts the exact bytes between candidate key
boundaries over all partitions, one row for each interval and task; the interval in which a splitter's target lies
is probed anew at equal distances, until every splitter is within the tolerance of its target or between
neighbouring keys. Then rows go to their shards in a single exchange.

Shards are numbered in key order and hold nearly equal bytes (law `bytes`). Slots are numbered within
buckets, narrower key ranges whose row counts are known, so that no task sorts a whole shard. Null ids come first, null
texts have no bytes and size 1, equal texts are rows like all others and get slots of their own, an empty table gives no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from millrace.llm.common import written

#: Candidate boundaries inside the interval of each splitter in one round.
PROBES = 32
#: Share of a shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.0005
#: Rows that a bucket should hold about, and the least number of buckets in a shard.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 4


def hex_key(number: int) -> str:
    return format(number, "032x")


def sort_key(df: DataFrame, id_col: str) -> Column:
    """128 bits as 32 hex digits in the order of (id, row number); of an id that is no integer, the first eight bytes of its text count."""
    if isinstance(df.schema[id_col].dataType, IntegralType):
        high = F.lpad(F.hex(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    else:
        high = F.rpad(F.hex(F.substring(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"), 1, 8)), 16, "0")
    return F.lower(F.concat(high, F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")))


def interval(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at or below key, by binary search."""
    array = F.split(F.lit(",".join(bounds)), ",")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))

    def step(at: Column, _: Column) -> Column:
        low, high = at["low"], at["high"]
        middle = F.shiftright(low + high, 1)
        below = F.get(array, middle) <= key
        return F.when(low >= high, at).otherwise(F.struct(F.when(below, middle + 1).otherwise(low).alias("low"), F.when(below, high).otherwise(middle).alias("high")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), step)["low"]


def splitters(rows: DataFrame, shards: int) -> tuple[list[str], dict[str, tuple[int, int]]]:
    """The lowest key of each shard but the first, and (bytes, rows) below each boundary that was probed.

    rows: columns key and size. Only counts come to the driver, PROBES * shards of them in a round.
    """
    ends = rows.agg(F.min("key"), F.max("key"), F.sum("size"), F.count("*")).first()
    if not ends[3]:
        return [], {}
    total, low, high = ends[2], int(ends[0], 16), int(ends[1], 16) + 1
    below = {hex_key(low): (0, 0), hex_key(high): (total, ends[3])}
    known = [low, high]
    targets = [total * k // shards for k in range(1, shards)]
    allowed = TOLERANCE * total / shards
    buckets = max(LEAST_BUCKETS, -(-ends[3] // (BUCKET_ROWS * shards)))
    wide = max(1, ends[3] // (shards * buckets))
    while True:
        probes = set()
        for target in targets:
            sums = [below[hex_key(k)][0] for k in known]
            at = bisect_right(sums, target) - 1
            at = min(at, len(known) - 2)
            a, b = known[at], known[at + 1]
            if min(target - sums[at], sums[at + 1] - target) > allowed and b - a > 1 and below[hex_key(b)][1] - below[hex_key(a)][1] > 1:
                probes |= {a + (b - a) * k // (PROBES + 1) for k in range(1, PROBES + 1)} - {a, b}
        for k in range(len(known) - 1):  # intervals too wide for a bucket
            a, b = known[k], known[k + 1]
            n = below[hex_key(b)][1] - below[hex_key(a)][1]
            if n > 2 * wide and b - a > 1:
                parts = min(PROBES, max(8, n // wide))
                probes |= {a + (b - a) * j // parts for j in range(1, parts)} - {a, b}
        if not probes:
            break
        bounds = [hex_key(k) for k in sorted(probes | set(known))]
        found = rows.groupBy(interval(F.col("key"), bounds).alias("at")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        counts = {r["at"]: (r["size"], r["n"]) for r in found}
        size = n = 0
        for k, bound in enumerate(bounds):
            below[bound] = (size, n)
            more = counts.get(k + 1, (0, 0))
            size, n = size + more[0], n + more[1]
        kept = sorted(int(x, 16) for x in below)
        # Boundaries that bound no rows between them add nothing.
        known = [k for i, k in enumerate(kept) if i in (0, len(kept) - 1) or below[hex_key(k)] != below[hex_key(kept[i - 1])] or below[hex_key(k)] != below[hex_key(kept[i + 1])]]
        below = {hex_key(k): below[hex_key(k)] for k in known}
    keys = [min(known, key=lambda k, t=target: (abs(below[hex_key(k)][0] - t), k)) for target in targets]
    return [hex_key(k) for k in keys], below


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, size, text_crc32, law, shard, slot, grown_shard; one row for each row of df."""
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32")
    rows = written(df.select(F.col(id_col), size, crc, sort_key(df, id_col).alias("key")), "shards")
    starts, below = splitters(rows.select("key", "size"), shards)
    cuts = sorted(set(below) | set(starts)) or [hex_key(0)]
    # Of each bucket: its shard, and the rows of the shard before it.
    first = [0, *(below[k][1] for k in starts)]
    number = [bisect_right(starts, k) for k in cuts]
    offset = [below[k][1] - first[n] if below else 0 for k, n in zip(cuts, number, strict=True)]
    bucket = interval(F.col("key"), cuts) - 1
    placed = rows.withColumn("bucket", bucket)

    def numbers(values: list[int]) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, values))), ","), F.col("bucket")).cast("long")

    slot = F.row_number().over(Window.partitionBy("bucket").orderBy("key")) - 1 + numbers(offset)
    return placed.select(
        F.col(id_col), "size", "text_crc32", F.lit("bytes").alias("law"),
        numbers(number).cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
