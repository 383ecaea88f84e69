"""Near-duplicates by one-permutation MinHash.

A text's set of word shingles is hashed once; the hash's high bits choose one of BANDS * ROWS bins, each of which
keeps its least hash. An empty bin takes the value of a bin that a fixed random sequence of its own leads to
(optimal densification). ROWS bins make a band, and texts with equal bands meet in a bucket.

Texts with equal sets are one class from the start. In a bucket of classes one is the centre, and the others are
linked to it only, so a bucket of n gives n - 1 candidates. Each bucket draws its own centres. Classes that
are in one component already need no candidate between them; buckets that still hold several components get a few
other centres in the second round.

A print is a bitmap of PRINT bits, each the parity of the set's hashes that fall on it, so two prints differ in at most as many bits as the
sets have elements that are in one of them only. Candidates whose prints differ in more bits than a link allows are no links; all others are
confirmed on the full sets, which are written once for each class that shares a bucket.

What centres leave is done in full: in buckets that still hold several components, the prints of classes of different components are compared,
and only pairs that may be links leave the comparison. They are confirmed in the same way, first the nearest pair of each two components,
then those whose classes are still apart. Components grow by the new links only, and tables go when nothing reads them any more.

Defined cases: ids are of any type that has an order; empty and null texts have no shingles and are linked with nothing; a null id is larger
than all others, and the component of null ids only is null (its rows are kept); rows with equal ids and texts are kept or not alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, buffers, map_batches
from millrace.operators.graph import connected_components
from millrace.session import forgotten, written

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Attempts of densification; the last one always succeeds, in the first bin with a value.
ATTEMPTS = 64
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Bytes that are hashed at a time.
PART = 1 << 20
#: Centres of a bucket in the first round, and in the second, in which most components have formed.
CENTRES = (1, 3)
MOST_CENTRES = max(CENTRES)
#: Bits of a print, a multiple of 64.
PRINT = 1024

_rng = np.random.default_rng(20240229)
_odd = _rng.integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_powers = np.cumprod(np.full(LONG_WORD, _odd[0], np.uint64), dtype=np.uint64)
_probe = _rng.integers(0, BINS, (ATTEMPTS, BINS))
_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += np.uint64(32)
_lower += np.uint64(1)
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_edges = (np.arange(BINS, dtype=np.uint64) * np.uint64(2**64 // BINS)).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i+1]], and the index of each text's first word."""
    space = _white[data]
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(~space & before)
    after = np.empty(len(data), bool)
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(~space & after) + 1
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    lengths = ends - starts
    letters = _lower[data[~space]]
    at = np.cumsum(lengths) - lengths
    inside = np.arange(len(letters)) - np.repeat(at, lengths)
    hashes = np.add.reduceat(letters * _powers[np.minimum(inside, LONG_WORD - 1)], at)
    for k in np.flatnonzero(lengths > LONG_WORD):
        hashes[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes().translate(_fold))
    return mixed(hashes + lengths.astype(np.uint64)), firsts


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words; of fewer words, of all of them as one."""
    n = len(words)
    if not n:
        return words
    if n < size:
        whole = (words * _odd[10 : 10 + n]).sum(dtype=np.uint64) ^ _odd[9 - n]
        return mixed(np.array([whole], np.uint64))
    runs = words[: n - size + 1] * _odd[1]
    for k in range(1, size):
        runs = runs + words[k : n - size + 1 + k] * _odd[1 + k]
    return np.unique(mixed(runs))


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, hashing about PART bytes of them at a time."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, "right")) - 1)
        words, firsts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            yield shingles(words[firsts[k] : firsts[k + 1]], size)
        i = j


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Band hashes of the sets, none of them empty: one row for each set."""
    values = np.empty((len(sets), BINS), np.uint64)
    full = np.empty((len(sets), BINS), bool)
    for k, s in enumerate(sets):
        at = np.searchsorted(s, _edges)
        full[k] = np.append(at[1:], len(s)) > at
        values[k] = s[np.minimum(at, len(s) - 1)]
    source = np.where(full, np.arange(BINS), -1)
    for attempt in _probe:
        row, bin_ = np.nonzero(source < 0)
        if not len(row):
            break
        to = attempt[bin_]
        source[row, bin_] = np.where(full[row, to], to, -1)
    row, bin_ = np.nonzero(source < 0)
    source[row, bin_] = full.argmax(axis=1)[row]
    dense = mixed(np.take_along_axis(values, source, axis=1)).reshape(len(sets), BANDS, ROWS)
    return mixed((dense * _odd[20 : 20 + ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _odd[40])


def print_of(s: np.ndarray) -> np.ndarray:
    """The parity of the number of the set's hashes on each of PRINT bits, as 64-bit numbers."""
    odd = np.bincount((s % np.uint64(PRINT)).astype(np.int64), minlength=PRINT) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_table(df: DataFrame, size: int) -> DataFrame:
    """df: node, text (binary). node and the sorted hashes of the text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in sets_of(*buffers(b.column(1)), size)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return map_batches(df, run, "node long, set array<long>")


def sketched(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row: id, n_shingles, th (hash of the text), digest of the set (null if empty), bands, print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(sets_of(*buffers(b.column(2)), size))
            filled = [k for k, s in enumerate(sets) if len(s)]
            digests: list[bytes | None] = [None] * len(sets)
            bands: list[np.ndarray | None] = [None] * len(sets)
            prints: list[np.ndarray | None] = [None] * len(sets)
            if filled:
                rows = sketches([sets[k] for k in filled]).view(np.int64)
                for k, row in zip(filled, rows, strict=True):
                    digests[k], bands[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), row
                    prints[k] = print_of(sets[k])
            columns = [pa.array([len(s) for s in sets], pa.int64()), b.column(1), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n_shingles", "th", "digest", "bands", "print"])

    one = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), as_bytes(text_col).alias("text"))
    return map_batches(one, run, f"id {df.schema[id_col].dataType.simpleString()}, n_shingles long, th long, digest binary, bands array<long>, print array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which the sets' intersection is at least percent of the union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (pc.list_flatten(b.column(k)).to_numpy() for k in (2, 3))
            at, to = (np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(k)).to_numpy())]) for k in (2, 3))
            kept = []
            for i in range(b.num_rows):
                x, y = one[at[i] : at[i + 1]], two[to[i] : to[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)], names=["a", "b"])

    side = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return map_batches(both, run, "a long, b long")


def placed(buckets: DataFrame, components: DataFrame | None) -> DataFrame:
    """buckets with each class's component c, which is the class itself as long as it has no link."""
    if components is None:
        return buckets.withColumn("c", F.col("node"))
    return buckets.join(components.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))


def apart_in(x: str, y: str):
    """Differing bits of two prints."""
    words = [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(PRINT // 64)]
    return sum(words[1:], words[0]).cast("long")


def candidates(buckets: DataFrame, components: DataFrame | None, prints: DataFrame, seed: int, centres: int, percent: int) -> DataFrame:
    """Pairs (a, b): in each bucket of several components, its centres with each member of another component, if sizes and prints allow a link.

    Sets whose sizes alone rule a link out, the smaller being less than percent of the larger, make no pair.
    """
    rows = placed(buckets, components)
    # All centres but the last are drawn from members of components first: a single class as the centre of a bucket full of one
    # component's members would be compared with every one of them.
    single = (F.col("c") == F.col("node")).cast("int")
    drawn = [F.min(F.struct((F.lit(0) if k == centres - 1 else single).alias("s"), F.xxhash64("node", "h", F.lit(seed * MOST_CENTRES + k)).alias("x"), F.col("node").alias("node"), F.col("c").alias("c"), F.col("n").alias("n"))) for k in range(centres)]
    stars = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.array(*drawn).alias("m")).where("low <> high").select("h", "m")
    pairs = rows.join(stars, "h").select("node", "n", "c", F.explode("m").alias("m")).where("c <> m.c")
    pairs = pairs.where(100 * F.least("n", "m.n") >= percent * F.greatest("n", "m.n"))
    pairs = pairs.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct()
    side = lambda end: prints.select(F.col("node").alias(end), F.col("print").alias(f"print_{end}"), F.col("n").alias(f"n_{end}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    return pairs.where((100 + percent) * apart_in("print_a", "print_b") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def remaining(buckets: DataFrame, components: DataFrame | None, prints: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes that share a bucket, are of different components, and may be linked by their sizes and prints.

    prints: node, n, print. Columns a, b, c, d (their components, the smaller first), apart (differing bits, by size).
    """
    rows = placed(buckets, components)
    mixed = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("h")
    words = PRINT // 64
    rows = rows.join(mixed, "h").join(prints.select("node", "print"), "node").select("h", "node", "n", "c", *[F.col("print")[k].alias(f"p{k}") for k in range(words)])
    x, y = rows.alias("x"), rows.alias("y")
    apart = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(1, words)), F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0")))).cast("long")
    both = F.col("x.n") + F.col("y.n")
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")))
    pairs = pairs.where((100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * apart <= (100 - percent) * both))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.least("x.c", "y.c").alias("c"), F.greatest("x.c", "y.c").alias("d"), (apart / both).alias("apart")).distinct()


def merged(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """Columns node and component, after links (a, b) between classes of different components."""
    if components is None:
        return connected_components(links, "a", "b")
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = connected_components(ends, "a", "b")
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = components.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = joined.join(components.select("node"), "node", "left_anti")
    found = written(moved.unionAll(fresh), "components")
    forgotten(joined, components)
    return found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Columns id_col, n_shingles, component_id, kept; one row for each row of df.

    size: words in a shingle. percent: of the union of two sets, the part in both from which they are linked.
    """
    return linked(df, id_col, text_col, size, percent).drop("th").withColumnRenamed("id", id_col)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, all their columns, of which one stays for each component; of rows with equal id and text one."""
    th = next(n for n in ("_" * k + "text_hash" for k in range(len(df.columns) + 1)) if n not in df.columns)
    gone = linked(df, id_col, text_col, size, percent).where(~F.col("kept")).select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    rows = df.withColumn(th, F.xxhash64(text_col))
    left = rows.join(gone, rows[id_col].eqNullSafe(gone["gone_id"]) & (rows[th] == gone["gone_th"]), "left_anti")
    return left.dropDuplicates([id_col, th]).select(*df.columns)


def linked(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Columns id, th (hash of the text), n_shingles, component_id, kept; one row for each row of df."""
    base = written(sketched(df, id_col, text_col, size), "sketches")
    # Nulls are the least of a struct, so a flag before the id puts them last.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th"))).alias("m")
    grouped = base.where("digest is not null").groupBy("digest").agg(least, F.first("bands").alias("bands"), F.first("print").alias("print"), F.first("n_shingles").alias("n"))
    classes = written(grouped.select("digest", F.col("m.id").alias("id"), F.col("m.th").alias("th"), "n", "bands", "print", F.monotonically_increasing_id().alias("node")), "classes")
    rows = classes.select("node", "n", F.explode("bands").alias("h"))
    shared = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    buckets = written(rows.join(shared, "h"), "buckets")
    prints = classes.select("node", "n", "print")
    member = buckets.select("node").distinct().join(classes.select("node", F.col("id").alias("class_id"), F.col("th").alias("class_th")), "node")
    # Repeated rows are one text; a class takes the text of one of its rows.
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), as_bytes(text_col).alias("text")).dropDuplicates(["id", "th"])
    own = member.join(source, F.col("class_id").eqNullSafe(F.col("id")) & (F.col("class_th") == F.col("th"))).select("node", "text")
    sets = written(sets_table(own, size), "sets")
    components = None
    tested: list[DataFrame] = []

    def test(pairs: DataFrame) -> None:
        nonlocal components
        for done in tested:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tested.append(pairs)
        links = written(confirmed(pairs, sets, percent), "links")
        if not links.isEmpty():
            components = merged(components, links)
        forgotten(links)

    for seed, centres in enumerate(CENTRES):
        test(candidates(buckets, components, prints, seed, centres, percent))
    # Nothing is left out from here on: one link joins two components, so their nearest pair goes first, and then what it did not settle.
    rest = remaining(buckets, components, prints, percent)
    for done in tested:
        rest = rest.join(done, ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    if not rest.isEmpty():
        test(rest.groupBy("c", "d").agg(F.min(F.struct("apart", "a", "b")).alias("m")).select("m.a", "m.b"))
        left = rest.select("a", "b")
        if components is not None:
            of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
            left = left.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
        test(left)
    forgotten(buckets, sets, rest, *tested)
    named = classes.select("digest", "node", F.col("id").alias("component_id"))
    if components is not None:
        own = classes.select("node", "id").join(components, "node")
        lowest = own.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"))).alias("m"))
        mapped = own.join(lowest, "component").select("node", F.col("m").alias("m"))
        named = named.join(mapped, "node", "left").select("digest", F.when(F.col("m").isNull(), F.col("component_id")).otherwise(F.col("m.id")).alias("component_id"))
    named = named.select("digest", "component_id")
    full = base.where("digest is not null").select("id", "th", "n_shingles", "digest").join(named, "digest").select("id", "th", "n_shingles", "component_id")
    alone = base.where("digest is null").select("id", "th", "n_shingles", F.col("id").alias("component_id"))
    return full.unionAll(alone).select("id", "th", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
