"""Byte tokens of flows: vocabulary, encoding, windows, n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from millrace.session import forgotten, written

# The vocabulary's parts in order.
SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[PKT_FWD]", "[PKT_BWD]", "[PKT_END]")
CONNECTIONS = ("tcp_payload", "tcp_control_only", "tcp_reset_or_refused", "udp_payload", "other")
CONTEXT_NAMES = ("H60", "H300", "R60", "C60", "P0_60", "DPORT60", "DHOST60")
CONTEXT_STEPS = ("0", "1", "2_4", "5_9", "10_19", "20_49", "50_PLUS")
# End of the fixed values.
#: Bytes of text whose runs are counted by one sort; a longer text is counted piece by piece. Runs that a task holds before it merges or hands on their sums.
PIECE, HELD_RUNS = 1 << 16, 1 << 20
#: Rows that are sent to a counting worker at once, at most.
BATCH_ROWS = 500
PAD, UNK, CLS, SEP, MASK, FWD, BWD, END = range(8)
FIRST_BYTE, FIRST_CONNECTION = 8, 264
FIRST_CONTEXT = FIRST_CONNECTION + len(CONNECTIONS)


def vocabulary(extra: tuple[str, ...] = ()) -> list[str]:
    """All tokens in id order; extra ones follow and must be new."""
    base = [*SPECIAL, *(f"b_{k:02x}" for k in range(256)), *(f"[CONN_{c.upper()}]" for c in CONNECTIONS), *(f"[CTX_{n}_{s}]" for n in CONTEXT_NAMES for s in CONTEXT_STEPS)]
    if len({*base, *extra}) != len(base) + len(extra):
        raise ValueError("a token is there already")
    return base + list(extra)


def byte_ids(data: Column) -> Column:
    """Ids of the bytes of binary data, in one pass over its hex text; none for null."""
    pairs = F.regexp_extract_all(F.hex(F.coalesce(data, F.lit(b""))), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int") + FIRST_BYTE)


def bound(value: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def connection_token(kind: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, CONNECTIONS[:-1])), kind)
    return (FIRST_CONNECTION + F.when(at > 0, at - 1).otherwise(len(CONNECTIONS) - 1)).cast("int")


def context_step(value: Column) -> Column:
    """Number of the step of a count: 0, 1, 2-4, 5-9, 10-19, 20-49, 50 and more; anything else is 0."""
    n = F.coalesce(value.try_cast("long"), F.lit(0))
    return F.when(n <= 0, 0).when(n == 1, 1).when(n < 5, 2).when(n < 10, 3).when(n < 20, 4).when(n < 50, 5).otherwise(6)


def context_tokens(values: list[Column]) -> Column:
    return F.array(*[(FIRST_CONTEXT + k * len(CONTEXT_STEPS) + context_step(v)).cast("int") for k, v in enumerate(values)])


def flow_ids(prefix: Column, directions: Column, pieces: Column) -> Column:
    """Prefix, then for each packet its direction, its bytes and an end. Directions other than fwd and bwd are an error."""
    way = lambda d: F.when(d == "fwd", FWD).when(d == "bwd", BWD).otherwise(F.raise_error(F.concat(F.lit("bad direction: "), d)).cast("int"))
    packets = F.zip_with(directions, pieces, lambda d, p: F.concat(F.array(way(d)), byte_ids(p), F.array(F.lit(END))))
    return F.concat(prefix, F.flatten(packets))


def encoded(ids: Column, length: int = 512) -> Column:
    """Struct input_ids, attention_mask: CLS, as many ids as fit, SEP, padding."""

    def padded(body: Column) -> Column:
        gap = length - F.size(body)
        return F.struct(F.concat(body, F.array_repeat(F.lit(PAD), gap)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size(body)), F.array_repeat(F.lit(0), gap)).alias("attention_mask"))

    return bound(F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, length - 2), F.array(F.lit(SEP))), padded)


def windows(ids: Column, length: int = 512, stride: int = 384) -> Column:
    """Overlapping runs of length - 2 ids, the last of which reaches the end; one empty run if there are no ids."""
    body = length - 2
    starts = lambda x: F.sequence(F.lit(0), F.greatest(F.size(x) - body, F.lit(0)) + stride - 1, F.lit(stride))
    return bound(ids, lambda x: F.transform(starts(x), lambda s: F.slice(x, s + 1, body)))


def first_window_digest(ids: Column, length: int = 512) -> Column:
    """SHA-1 of the first window's padded ids as little-endian 16-bit numbers."""
    whole = encoded(F.slice(ids, 1, length - 2), length)["input_ids"]
    pair = lambda v: F.concat(F.lpad(F.hex(v.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(v, 8)), 2, "0"))
    return F.sha1(F.unhex(F.array_join(F.transform(whole, pair), "")))


def parsed_hex(text: Column) -> Column:
    """Bytes of hex text with or without 0x and blanks; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", ""), "^0[xX]", "")
    return F.try_to_binary(plain, F.lit("hex"))


def masked(ids: Column, seed: Column, share: float = 0.15) -> Column:
    """Array of struct input, label for masked training: of share of the ids 80 % become MASK, 10 % another byte, 10 % stay; specials are never chosen; label -100 elsewhere."""

    def one(v: Column, k: Column) -> Column:
        draw = F.pmod(F.xxhash64(seed, k), F.lit(10_000)) / 10_000
        kind = F.pmod(F.xxhash64(seed, k, F.lit(1)), F.lit(10))
        other = (F.pmod(F.xxhash64(seed, k, F.lit(2)), F.lit(256)) + FIRST_BYTE).cast("int")
        chosen = (draw < share) & (v >= FIRST_BYTE)
        return F.struct(F.when(chosen & (kind < 8), MASK).when(chosen & (kind == 8), other).otherwise(v).alias("input"), F.when(chosen, v).otherwise(-100).alias("label"))

    return F.transform(ids, one)


def ngrams(data: Column, low: int = 1, high: int = 4) -> Column:
    """All runs of low to high bytes as hex text."""
    size = F.length(data)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda k: F.lower(F.hex(F.substring(data, k + 1, F.lit(n)))))).otherwise(F.array().cast("array<string>"))
    return F.concat(*map(of, range(low, high + 1)))


def summed(runs: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct runs in order, and the sums of their values."""
    order = np.argsort(runs, kind="stable")
    runs = runs[order]
    first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])[: len(runs)])
    return runs[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values]


def run_counts(owners: list[int], pieces: list[bytes], starts: list[int], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, run and count of all runs of low to high bytes that begin at the first `starts` bytes of each owner's piece.

    A run's number is a one in front of its bytes. One sort by owner and the next high bytes has the runs of every length side by side.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    data = np.frombuffer(b"".join(pieces) + bytes(high), np.uint8)
    keys = np.repeat(np.arange(len(pieces), dtype=np.uint64), sizes)
    for k in range(high):
        keys = keys << np.uint64(8) | data[k : k + total]
    # What follows a piece's end is in the key, but no run reaches it.
    left = np.repeat(ends, sizes) - np.arange(total)
    keys = keys << np.uint64(3) | np.minimum(left, high).astype(np.uint64)
    keys = np.sort(keys[np.repeat(sizes - np.array(starts, np.int64), sizes) < left])
    reach = (keys & np.uint64(7)).astype(np.int64)
    found = []
    for n in range(low, high + 1):
        runs = keys >> np.uint64(3 + 8 * (high - n))
        first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])[: len(runs)])
        counts = np.add.reduceat((reach >= n).astype(np.int64), first) if len(first) else reach
        first, counts = first[counts > 0], counts[counts > 0]
        runs = runs[first].astype(np.int64)
        found.append((runs >> 8 * n, runs & (1 << 8 * n) - 1 | 1 << 8 * n, counts))
    owner, runs, counts = map(np.concatenate, zip(*found, strict=True))
    return np.array(owners, np.int64)[owner], runs, counts


def row_counts(texts: pa.Array, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, run and count for binary texts, some rows at a time, each of them whole. Nulls have no runs."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        if held and (size + len(text) > PIECE or len(held) >> 61 - 8 * high):
            yield run_counts(rows, held, [len(t) for t in held], low, high)
            rows, held, size = [], [], 0
        if len(text) <= PIECE:
            rows.append(row)
            held.append(text)
            size += len(text)
            continue
        sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE + high - 1]
            fresh.append(run_counts([row], [piece], [min(PIECE, len(piece), len(text) - at)], low, high)[1:])
            if sum(len(x[0]) for x in fresh) > max(HELD_RUNS, len(sums[0])) or at + PIECE >= len(text):
                sums = summed(*map(np.concatenate, zip(sums, *fresh, strict=True)))
                fresh = []
        yield np.full(len(sums[0]), row), *sums
    if held:
        yield run_counts(rows, held, [len(t) for t in held], low, high)


def counted_runs(rows: DataFrame, low: int, high: int) -> DataFrame:
    """rows: key, binary text. Columns key, run, tf; a row's runs once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, runs, counts in row_counts(b.column(1), low, high):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(runs), pa.array(counts)], names=names)

    names = [rows.columns[0], "run", "tf"]
    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("run", LongType()), StructField("tf", LongType())]))


def run_totals(rows: DataFrame, low: int, high: int) -> DataFrame:
    """rows: key, binary text, each key once. Columns run, df, total, summed within stretches of a partition only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = tuple(np.zeros(0, np.int64) for _ in range(3))
        sums, fresh, size = none, [], 0
        for b in batches:
            for _, runs, counts in row_counts(b.column(1), low, high):
                fresh.append(summed(runs, np.ones(len(runs), np.int64), counts))
                size += len(fresh[-1][0])
                if size > max(HELD_RUNS, len(sums[0])):
                    sums, fresh, size = summed(*map(np.concatenate, zip(sums, *fresh, strict=True))), [], 0
                if len(sums[0]) > HELD_RUNS:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, sums)), names=names)
                    sums = none
        yield pa.RecordBatch.from_arrays(list(map(pa.array, summed(*map(np.concatenate, zip(sums, *fresh, strict=True))))), names=names)

    names = ["run", "df", "total"]
    return rows.mapInArrow(run, "run long, df long, total long")


def run_term(run: Column) -> Column:
    """A run's bytes as hex text."""
    return F.substring(F.lower(F.hex(run)), 2, 2 * 7)


def most_frequent(totals: DataFrame, terms: int) -> pa.Table:
    """run, df of the runs with the highest totals, those of equal totals by their hex text; sorted by run."""
    kept, at_least = 0, None
    for r in totals.groupBy("total").agg(F.count("*").alias("n")).orderBy(F.desc("total")).limit(terms).toLocalIterator():
        if kept + r["n"] > terms:
            at_least = r["total"]
            break
        kept += r["n"]
    if at_least is None:
        return totals.select("run", "df").toArrow().sort_by("run")
    found = totals.where(F.col("total") > at_least).select("run", "df").toArrow()
    if kept < terms:
        more = totals.where(F.col("total") == at_least).orderBy(run_term(F.col("run"))).limit(terms - kept).select("run", "df")
        found = pa.concat_tables([found, more.toArrow()])
    return found.sort_by("run")


def tfidf(df: DataFrame, key: str, data: str, low: int = 1, high: int = 4, terms: int = 200_000) -> DataFrame:
    """key, term, weight: counts by smoothed inverse frequency, rows scaled to length 1; the most frequent terms only.

    Rows of one key count as one. Texts are counted where they lie, once for the terms and once for the weights; only sums for each
    distinct run are shuffled, and the kept terms go to every worker. Runs have 7 bytes at most.
    """
    if not 1 <= low <= high <= 7:
        raise ValueError("runs have 1 to 7 bytes")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = df.select(F.col(key), F.col(data).cast("binary").alias("data"))
    several = df.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    again = None
    if not several.isEmpty():
        same = F.col(key).eqNullSafe(F.col("again"))
        again = counted_runs(rows.join(several, same, "left_semi"), low, high).groupBy(key, "run").agg(F.sum("tf").alias("tf"))
        rows = rows.join(several, same, "left_anti")
    parts = run_totals(rows, low, high)
    if again is not None:
        parts = parts.unionAll(again.groupBy("run").agg(F.count("*").alias("df"), F.sum("tf").alias("total")))
    totals = written(parts.groupBy("run").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "runs")
    best = most_frequent(totals, terms)
    forgotten(totals)
    runs = best["run"].to_numpy()
    idf = np.log((1.0 + df.count()) / (1.0 + best["df"].to_numpy())) + 1.0
    shared = df.sparkSession.sparkContext.broadcast((runs, idf, pa.array([f"{r:x}"[1:] for r in runs.tolist()], pa.string())))
    out = run_weights(rows, shared, low, high)
    if again is None:
        return out
    kept = df.sparkSession.createDataFrame(pa.table({"run": runs, "idf": idf}))
    weighted = again.join(F.broadcast(kept), "run").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy(F.col(key).alias("again")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return out.unionAll(weighted.join(norm, F.col(key).eqNullSafe(F.col("again"))).select(key, run_term(F.col("run")).alias("term"), (F.col("w") / F.col("norm")).alias("weight")))


def run_weights(rows: DataFrame, shared, low: int, high: int) -> DataFrame:
    """rows: key, binary text, each key once; shared: a broadcast of the kept runs in order, their weights and terms. Columns key, term, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, idf, terms = shared.value
        for b in batches:
            for row, runs, counts in row_counts(b.column(1), low, high):
                at = np.minimum(np.searchsorted(kept, runs), max(0, len(kept) - 1))
                hit = np.flatnonzero(kept[at] == runs) if len(kept) else at[:0]
                row, at, w = row[hit], at[hit], counts[hit] * idf[at[hit]]
                weight = w / np.sqrt(np.bincount(row, w * w, b.num_rows))[row]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), terms.take(pa.array(at)), pa.array(weight)], names=names)

    names = [rows.columns[0], "term", "weight"]
    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("term", StringType()), StructField("weight", DoubleType())]))
