"""Byte-level BPE encoding and decoding.

The merges of pre-tokens are driven by a rank queue: one bucket of linked-list positions for each merge rank
that is waiting, and a two-level bitmap over the ranks in which find-first-set gives the next rank to
merge. An entry whose pair has changed since it was queued is skipped when it comes up. The work is
in proportion to the number of merges, so a megabyte without white space is no special case.

Nulls count as empty texts; an empty text has no tokens. Texts with equal bytes get equal ids.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, worker_cache

#: Code points with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
#: Ranks in one word of the bitmap: 2 to this power.
WORD_SHIFT, WORD_MASK = 8, 255
BITS = [1 << k for k in range(256)]
#: Chunks in each of the two generations that a worker remembers, the longest that it remembers, and pre-tokens.
CACHE_ENTRIES, CACHE_CHARS, CACHE_PIECES = 300_000, 40, 800_000
#: Characters of texts that are worked on at a time.
GROUP_CHARS = 500_000


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of base64 bytes and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge_all(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each pre-token: its lowest-ranked pair is merged first, of equal ones the leftmost.

    All pre-tokens share one queue over their joined bytes, with no pairs across their borders. A token is known by the place
    of its first byte; pair holds the rank of the pair that starts there.
    """
    made = [[whole] if (whole := ranks.get(piece)) is not None else [] for piece in pieces]
    rest = [piece for piece, ids in zip(pieces, made, strict=True) if not ids]
    text = b"".join(rest)
    n = len(text)
    get = ranks.get
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    first = bytearray(n + 1)
    pair = list(map(get, map(bytes, zip(text, text[1:], strict=False))))
    pair.append(None)
    at = 0
    for piece in rest:
        first[at] = 1
        before[at] = -1
        at += len(piece)
        pair[at - 1] = None
    first[n] = 1
    buckets: dict[int, list[int]] = {}
    for i, rank in enumerate(pair):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
    words: dict[int, int] = {}
    top = 0
    for rank in buckets:
        words[rank >> WORD_SHIFT] = words.get(rank >> WORD_SHIFT, 0) | BITS[rank & WORD_MASK]
        top |= BITS[rank >> WORD_SHIFT]
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        rank = (word << WORD_SHIFT) + low.bit_length() - 1
        words[word] = bits ^ low
        if bits == low:
            top ^= BITS[word]
        waiting = buckets.pop(rank)
        if len(waiting) > 1:
            waiting.sort()
        for k, i in enumerate(waiting):
            if pair[i] != rank:
                continue
            middle = end[i]
            stop = end[i] = end[middle]
            pair[middle] = None
            lower = False
            if first[stop]:
                pair[i] = None
            else:
                before[stop] = i
                new = pair[i] = get(text[i : end[stop]])
                if new is not None:
                    lower = new < rank
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        words[new >> WORD_SHIFT] = words.get(new >> WORD_SHIFT, 0) | BITS[new & WORD_MASK]
                        top |= BITS[new >> WORD_SHIFT]
            left = before[i]
            if left >= 0:
                new = pair[left] = get(text[left:stop])
                if new is not None:
                    lower |= new < rank
                    if new in buckets:
                        buckets[new].append(left)
                    else:
                        buckets[new] = [left]
                        words[new >> WORD_SHIFT] = words.get(new >> WORD_SHIFT, 0) | BITS[new & WORD_MASK]
                        top |= BITS[new >> WORD_SHIFT]
            if lower and k + 1 < len(waiting):  # a lower rank goes first; the rest waits again
                buckets[rank] = waiting[k + 1 :]
                words[rank >> WORD_SHIFT] |= BITS[rank & WORD_MASK]
                top |= BITS[rank >> WORD_SHIFT]
                break
    i = 0
    for ids in made:
        if not ids:
            ids.append(ranks[text[i : end[i]]])
            i = end[i]
            while not first[i]:
                ids.append(ranks[text[i : end[i]]])
                i = end[i]
    return made


class Codec:
    """Ranks with the text's splitting; remembers the encoding of short chunks.

    A chunk is what stands between two places at which the pattern always splits: an optional space with
    the run of other characters after it, or white space. The pattern is then applied inside a chunk.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = CACHE_ENTRIES, most_pieces: int = CACHE_PIECES):
        self.ranks = ranks
        self.entries, self.most_pieces = entries, most_pieces
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.chunk = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}
        self.pieces: dict[str, list[int]] = {}

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pre-tokens; those of short ones are remembered."""
        known = self.pieces
        if new := {p for p in pieces if p not in known}:
            if len(known) >= self.most_pieces:
                kept = {p: known[p] for p in pieces if p in known}
                known.clear()
                known.update(kept)
            fresh = list(new)
            known.update(zip(fresh, merge_all([p.encode() for p in fresh], self.ranks), strict=True))
        made = [known[p] for p in pieces]
        for p in new:
            if len(p) > CACHE_CHARS:
                del known[p]
        return made

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.ids_of(self.pattern.findall(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def learn(self, chunks: set[str]) -> None:
        """Of each chunk: number of ids, ids in decimal joined by a space, decoded bytes."""
        split = {c: self.pattern.findall(c) for c in chunks}
        ids_of = iter(self.ids_of([p for pieces in split.values() for p in pieces]))
        for chunk, pieces in split.items():
            ids = [i for _ in pieces for i in next(ids_of)]
            self.known[chunk] = (len(ids), " ".join(map(str, ids)).encode(), self.decode(ids))

    def digests(self, texts: list[str], with_ids: bool = False) -> list[tuple]:
        """Of each text: number of ids, digest of the ids, digest of the bytes that they decode to, and the ids if asked for."""
        split = [self.chunk.findall(text) for text in texts]
        new = {c for chunks in split for c in chunks}
        if len(self.known) >= self.entries:
            self.known, self.older = {}, self.known
        new.difference_update(self.known)
        for c in [c for c in new if c in self.older]:
            self.known[c] = self.older[c]
            new.discard(c)
        if new:
            self.learn(new)
        known, made = self.known, []
        for chunks in split:
            parts = [known[c] for c in chunks]
            ids, back = b" ".join([x[1] for x in parts]), hashlib.sha256(b"".join([x[2] for x in parts]))
            row = (sum([x[0] for x in parts]), hashlib.sha256(ids).hexdigest(), back.hexdigest())
            made.append((*row, np.array(ids.split(), np.int32)) if with_ids else row)
        for c in new:
            if len(c) > CACHE_CHARS:
                del known[c]
        return made


_codecs: dict[tuple, Codec] = worker_cache(__name__)


def codec_of(shared, pattern: str, entries: int = CACHE_ENTRIES, most_pieces: int = CACHE_PIECES) -> Codec:
    """One codec for a worker process, made when first asked for."""
    key = (shared.value[0], pattern, entries, most_pieces)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(shared.value[1]), pattern, entries, most_pieces)
    return _codecs[key]


def _share(df: DataFrame, ranks_path: str):
    """The rank file, a vocabulary of fixed size, for all executors."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and ids (array<int>) for each row of df."""
    shared = _share(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for b in batches:
            ids = [codec.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    one = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return map_batches(one, run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns id_col and bytes: what the ids stand for."""
    shared = _share(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for b in batches:
            back = [codec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.binary())], names=[id_col, "bytes"])

    return map_batches(df.select(id_col, ids_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, bytes binary")


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about GROUP_CHARS."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, entries: int = CACHE_ENTRIES, most_pieces: int = CACHE_PIECES) -> DataFrame:
    """Encodes and decodes each text in one pass over it: token count, digests of ids and of decoded bytes, and the ids if asked for.

    entries, most_pieces: what a worker remembers, chunks in each generation and pre-tokens; fewer take less memory and more time.
    """
    shared = _share(df, ranks_path)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern, entries, most_pieces)
        for b in batches:
            gc.disable()  # the caches hold no cycles, and each collection would go through them
            made = [x for texts in groups(b.column(1).to_pylist()) for x in codec.digests(texts, with_ids)]
            columns = [pa.array([x[k] for x in made], kinds[k]) for k in range(3 + with_ids)]
            gc.enable()
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    one = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(one, run, schema + ", ids array<int>" * with_ids)
