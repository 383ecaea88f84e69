"""Removal of byte strings of a given length that occur twice, by run-compressed Burrows-Wheeler indexes.

Strings are dealt out so that equal ones meet: every window of the length belongs to the anchor that its bytes
choose, and runs of windows with one anchor are segments. Segments with an anchor that occurs once are done; segments
with equal bytes are repeated as a whole. The other segments of anchors that occur again go, with all segments of
that anchor, into an index: the Burrows-Wheeler transform of their text, of which only runs are kept, with the
suffix array sampled at run ends. Longest common prefixes are computed at run ends only and carried on through the text,
where they fall by one from each place to the next, which streams the matching statistics of all places; windows with
a match of the length elsewhere are marked.

Anchors with very many segments (a passage that a third of all documents share) are dealt to several indexes by
content. Windows that are still open there, and one of each kind that is marked, are then counted by two hashes over all indexes.

Texts are known by a 64-bit hash of theirs, so copies of a text, whatever their ids, have one set of places.

Defined cases: ids are of any type; null texts count as empty; a text shorter than the length keeps all its bytes; equal rows repeat each other. What is
left of a text is its other bytes joined, which need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, buffers, map_batches, written
from millrace.llm.neardup import mixed

#: Distinct segments of one anchor in one index, and bytes of segments in an index at which it is closed.
BLOCK_SEGMENTS, INDEX_BYTES = 8192, 1 << 20
#: A segment's place is its first window's start times this, plus the number of windows.
PLACE = 1024

#: Bytes of a k-gram that anchors the strings around it, and the windows' starts that are looked at in one go.
ANCHOR = 32
STARTS = 1 << 19

_base = np.uint64(0x9E3779B97F4A7C15 | 1)
_inverse = np.uint64(pow(int(_base), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the rolling hash, and of its inverse, modulo 2 to the 64."""
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, factor in (("up", _base), ("down", _inverse)):
            t = np.full(size, factor, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"][:n], _tables["down"][:n]


def segments(text: bytes | np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of length bytes start, in runs with the same anchor: first start, number, anchor hash, content hash.

    A window's anchor is its k-gram of least hash, of equal ones the leftmost, so it depends on the window's bytes only and
    equal windows, wherever they stand, have equal anchors. Every window belongs to one run.
    """
    data = text if isinstance(text, np.ndarray) else np.frombuffer(text, np.uint8)
    parts = []
    for low in range(0, max(0, len(data) - length + 1), STARTS):
        parts.append(_segments(data[low : low + STARTS + length - 1], length, low))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def _segments(data: np.ndarray, length: int, offset: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = n - ANCHOR + 1
    hashes = mixed((sums[ANCHOR:] - sums[:grams]) * down[:grams])
    width = length - ANCHOR + 1
    # High bits of the hash, then the place: the minimum is the leftmost of the least.
    keys = (hashes & ~np.uint64((1 << 20) - 1)) | np.arange(grams, dtype=np.uint64)
    blocks = -(-grams // width)
    grid = np.full(blocks * width, np.uint64(2**64 - 1))
    grid[:grams] = keys
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    place = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    number = np.diff(np.append(first, count))
    end = first + number + length - 1
    content = mixed((sums[end] - sums[first]) * down[first] + number.astype(np.uint64))
    return first + offset, number, hashes[place[first]].view(np.int64), content.view(np.int64)


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of each suffix. symbols: small non-negative numbers; each string ends in a symbol of its own.

    Prefix doubling; each round sorts only suffixes that still tie with others.
    """
    n = len(symbols)
    s = np.zeros(n + 2, np.int64)
    s[:n] = symbols
    key = (s[:n] << 40) | (s[1 : n + 1] << 20) | s[2 : n + 2]
    order = np.argsort(key, kind="stable")
    change = np.flatnonzero(np.diff(key[order], prepend=-1))
    size = np.diff(np.append(change, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(change, size)
    open_ = order[np.repeat(size, size) > 1]
    step = 3
    while len(open_):
        later = open_ + step
        key = (rank[open_] << 32) | np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, open_ = key[order], open_[order]
        at = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.diff(key >> 32, prepend=-1) != 0, at, 0))
        new = np.diff(key, prepend=-1) != 0
        run = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = rank[open_] + run - group
        size = np.diff(np.append(np.flatnonzero(new), len(open_)))
        open_ = open_[np.repeat(size, size) > 1]
        step *= 2
    return rank


def common_prefixes(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and at b."""
    found = np.zeros(len(a), np.int64)
    left = np.flatnonzero(symbols[a] == symbols[b])
    while len(left):
        found[left] += 1
        left = left[symbols[a[left] + found[left]] == symbols[b[left] + found[left]]]
    return found


def carried(n: int, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of each place, the value at the last sampled place up to it, less the distance."""
    sample = np.full(n, -1, np.int64)
    sample[at] = np.arange(len(at))
    last = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))
    return value[sample[last]] - (np.arange(n) - last)


class RunIndex:
    """Run-length Burrows-Wheeler transform of distinct strings: run letters, and the suffix array at both ends of runs."""

    def __init__(self, strings: list[bytes]):
        m = len(strings)
        sizes = np.array([len(x) + 1 for x in strings])
        self.starts = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + m
        text[self.starts + sizes - 1] = np.arange(m)
        self.text = text
        rank = suffix_ranks(text)
        order = np.empty(len(text), np.int64)
        order[rank] = np.arange(len(text))
        letters = text[order - 1]
        heads = np.flatnonzero(np.diff(letters, prepend=-1))
        tails = np.append(heads[1:] - 1, len(text) - 1)
        self.letters, self.heads, self.tails = letters[heads], order[heads], order[tails]
        self.before, self.after = order[np.maximum(heads - 1, 0)], order[np.minimum(tails + 1, len(text) - 1)]

    def matching(self) -> np.ndarray:
        """Of each place, the length of the longest match that starts elsewhere."""
        up = common_prefixes(self.text, self.heads[1:], self.before[1:])
        down = common_prefixes(self.text, self.tails[:-1], self.after[:-1])
        n = len(self.text)
        return np.maximum(carried(n, self.heads, np.append(0, up)), carried(n, self.tails, np.append(down, 0)))


def occurrences(df: DataFrame, length: int) -> DataFrame:
    """Per segment: anchor a, content s, th of its text, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th = b.column(0).to_numpy()
            data, offsets = buffers(b.column(1))
            found = [segments(data[offsets[k] : offsets[k + 1]], length) for k in range(len(th))]
            number = np.array([len(x[0]) for x in found], np.int64)
            if not number.sum():
                continue
            first, count, anchor, content = (np.concatenate([x[k] for x in found]) for k in range(4))
            columns = (anchor, content, np.repeat(th, number), first * PLACE + count)
            for low in range(0, len(anchor), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[low : low + 20_000]) for x in columns], names=["a", "s", "th", "place"])

    return map_batches(df.select("th", "text"), run, "a long, s long, th long, place long")


def with_bytes(df: DataFrame, mixed_: DataFrame, length: int) -> DataFrame:
    """The segments of mixed_ (a, s, c, k, th, place) with their bytes and the index they belong to; df has a text once for each of its copies."""
    wanted = mixed_.groupBy("th").agg(F.collect_list(F.struct("a", "s", "c", "k", "place")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for th, text, parts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for p in parts:
                    first, count = divmod(p["place"], PLACE)
                    rows.append((p["a"], p["s"] % -(-p["k"] // BLOCK_SEGMENTS), p["k"] > BLOCK_SEGMENTS, p["c"], th, p["place"], text[first : first + count + length - 1]))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["a", "block", "open", "c", "th", "place", "bytes"])

    both = df.dropDuplicates(["th"]).join(wanted, "th").select("th", "text", "parts")
    return map_batches(both, run, "a long, block long, open boolean, c long, th long, place long, bytes binary")


def windows_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags as first and number."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def marked(rows: list[tuple], length: int) -> Iterator[tuple]:
    """rows: (a, block, open, c, th, place, bytes) of whole blocks. Yields (th, place, a, window, window2).

    Rows of marked windows have a null window. Of blocks that share their anchor with others, each open window comes with
    its two hashes, and each kind of marked window once with a null row.
    """
    number: dict[bytes, int] = {}
    for r in rows:
        number.setdefault(r[6], len(number))
    strings = list(number)
    index = RunIndex(strings)
    matching = index.matching()
    for r in rows:
        k = number[r[6]]
        first, count = divmod(r[5], PLACE)
        flags = matching[index.starts[k] : index.starts[k] + count] >= length
        if r[3] > 1:
            flags[:] = True
        for at, n in windows_of(flags):
            yield (r[4], (first + at) * PLACE + n, None, None, None)
        if r[2]:
            data = np.frombuffer(r[6], np.uint8).astype(np.uint64) + np.uint64(1)
            up, down = _powers(len(data) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)])])
            hashes = mixed((sums[length : length + count] - sums[:count]) * down[:count]).view(np.int64)
            for at in range(count):
                mine = None if flags[at] else (first + at) * PLACE + 1
                yield (r[4], mine, r[0], int(hashes[at]), xxhash.xxh3_64_intdigest(r[6][at : at + length]) - 2**63)


def indexed(segments_: DataFrame, length: int) -> DataFrame:
    """Marked windows as (th, place), and windows to be counted over several indexes (with a, window and window2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["th", "place", "a", "window", "window2"], [pa.int64()] * 5

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int, int]] = set()
            made = []
            for r in marked(rows, length):
                if r[2] is not None and r[1] is None:
                    if r[2:] in seen:
                        continue
                    seen.add(r[2:])
                made.append(r)
            for low in range(0, len(made), 20_000):
                part = list(zip(*made[low : low + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(part, kinds, strict=True)], names=names)

        rows: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if size >= INDEX_BYTES and r[:2] != last:
                    yield from out(rows)
                    rows, size = [], 0
                last = r[:2]
                rows.append(r)
                size += len(r[6])
        if rows:
            yield from out(rows)

    dealt = segments_.repartition("a", "block").sortWithinPartitions("a", "block")
    return map_batches(dealt, run, "th long, place long, a long, window long, window2 long")


def repeated_places(df: DataFrame, length: int) -> DataFrame:
    """df: th, text (binary), a row for each copy. Places (th, place) of all windows that occur elsewhere, some of them more than once."""
    occ = occurrences(df, length)
    kinds = occ.groupBy("a", "s").agg(F.count("*").alias("c"), F.min(F.struct("th", "place")).alias("at"))
    anchors = kinds.groupBy("a").agg(F.count("*").alias("k"))
    known = written(kinds.join(anchors, "a").where("c > 1 or k > 1").select("a", "s", "c", "k", "at.th", "at.place"), "anchors")
    whole = occ.join(known.where("c > 1").select("a", "s"), ["a", "s"]).select("th", "place")
    found = written(indexed(with_bytes(df, known.where("k > 1"), length), length), "windows")
    counted = found.where("window is not null")
    again = counted.groupBy("a", "window", "window2").agg(F.count("*").alias("n")).where("n > 1").select("a", "window", "window2")
    across = counted.where("place is not null").join(again, ["a", "window", "window2"]).select("th", "place")
    return whole.unionAll(found.where("window is null").select("th", "place")).unionAll(across)


def cut(text: bytes, places: list[int], length: int) -> tuple[bytes, int]:
    """text without the windows at the places, and the number of runs removed."""
    kept, end, spans = [], 0, 0
    for place in sorted(places):
        first, count = divmod(place, PLACE)
        if first > end or not spans:
            kept.append(text[end:first])
            spans += 1
        end = max(end, first + count + length - 1)
    kept.append(text[end:])
    return b"".join(kept), spans


def without_repeats(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Columns id_col, n_bytes, n_removed, n_spans and kept (binary), or with digest kept_sha256; one row for each row of df."""
    rows = df.select(F.col(id_col), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), as_bytes(text_col).alias("text"))
    places = repeated_places(rows.select("th", "text"), length)
    # Copies of a text share one set of places, which its length bounds.
    sets = places.groupBy("th").agg(F.collect_set("place").alias("places"))
    last = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                kept, spans = cut(text, at, length) if at else (text, 0)
                made.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = list(zip(*made, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", last])

    both = rows.join(sets, "th", "left").select(id_col, "text", "places")
    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(both, run, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")
