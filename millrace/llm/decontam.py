"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton accepts every run of words of every item. A document's words are streamed through it; at each
word its state gives the longest run of words, ending there, that stands in some item. A run of at least a
window's length makes the window's words hit, and the window's state names the items it stands in. Items shorter than a
window are one window as a whole.

Distinct items are collected in blocks of bounded size and each block is broadcast; documents pass through
the blocks one after the other, without a shuffle, in one stage for each block. Null texts have no words; items without words
never occur; items whose id is null count under the empty id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, map_batches, worker_cache
from millrace.session import forgotten, written

WINDOW = 10
#: Bytes of item texts in one automaton at most (but for a single longer item).
BLOCK_BYTES = 8 << 20

#: Bytes of words are kept, A-Z in lower case, all others become spaces; places stay the same.
_fold = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_word = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_fold).split()


class Automaton:
    """States by number: nxt (word to state), link (state of the longest suffix in another class), size (longest run)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.nxt: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        worded = [(name, words_of(text)) for name, text in items]
        for _, words in worded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: Of a state with runs of exactly a window's length, or of a short item's: length and items.
        self.marks: dict[int, dict[int, set[str]]] = {}
        for name, words in worded:
            if words:
                self._mark(name, words)
        self.least = min((n for found in self.marks.values() for n in found), default=1 << 60)
        #: Of each state: the nearest one with marks on its way of links, itself included; 0 if there is none.
        self.marked = [0] * len(self.nxt)
        for s in sorted(range(1, len(self.nxt)), key=self.size.__getitem__):
            self.marked[s] = s if s in self.marks else self.marked[self.link[s]]

    def _new(self, size: int, nxt: dict[bytes, int], link: int) -> int:
        self.nxt.append(nxt)
        self.size.append(size)
        self.link.append(link)
        return len(self.nxt) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state for the runs of q that are not longer than a step from p."""
        copy = self._new(self.size[p] + 1, dict(self.nxt[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.nxt[p].get(w) == q:
            self.nxt[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, size = self.nxt, self.link, self.size
        if (q := nxt[last].get(w)) is not None:
            return q if size[q] == size[last] + 1 else self._split(last, w, q)
        new = self._new(size[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
        return new

    def _mark(self, name: str, words: list[bytes]) -> None:
        n = min(self.window, len(words))
        s = 0
        for i, w in enumerate(words):
            s = self.nxt[s][w]
            while self.size[self.link[s]] >= n:
                s = self.link[s]
            if i + 1 >= n:
                self.marks.setdefault(s, {}).setdefault(n, set()).add(name)

    def stream(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit words as start, end, start, end ... of disjoint runs, and the names of the items that occur."""
        nxt, link, size, least, marked = self.nxt, self.link, self.size, self.least, self.marked
        s = n = 0
        runs: list[int] = []
        states: set[tuple[int, int]] = set()
        for i, w in enumerate(words):
            t = nxt[s].get(w)
            if t is None:
                while s and t is None:
                    s = link[s]
                    t = nxt[s].get(w)
                n = size[s]
                if t is None:
                    continue
            s = t
            n += 1
            if n >= least and (m := marked[s]):
                reach = 0
                while m:
                    for k in self.marks[m]:
                        if k <= n:
                            states.add((m, k))
                            reach = max(reach, k)
                    m = marked[link[m]]
                if reach:
                    start = i + 1 - reach
                    while runs and runs[-2] >= start:
                        del runs[-2:]
                    if runs and runs[-1] >= start:
                        runs[-1] = i + 1
                    else:
                        runs += (start, i + 1)
        return runs, {name for m, k in states for name in self.marks[m][k]}


def merged(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of disjoint runs."""
    if not a or not b:
        return list(a or b)
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and out[-1] >= start:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[bool, list[tuple[str, bytes]]]]:
    """The distinct items with words, in blocks that are collected one at a time, each with whether it is the last."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), as_bytes(text_col).alias("text"))
    one = written(named.where(F.length("text") > 0).distinct(), "items")
    total = one.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = one if count == 1 else one.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k)
        yield k + 1 == count, [(r["name"], bytes(r["text"])) for r in part.collect()]
    forgotten(one)


_automata: dict[int, Automaton] = worker_cache(__name__)


def _automaton(shared, window: int) -> Automaton:
    """One automaton for each block and worker process, built there from the block's items."""
    if shared.id not in _automata:
        _automata.clear()
        _automata[shared.id] = Automaton(shared.value, window)
    return _automata[shared.id]


class _Shared:
    """A broadcast with a number by which worker processes know it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return (self.broadcast, self.id)

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def scan(df: DataFrame, items: DataFrame, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", text_col: str = "text", block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """df with n_words, hit_runs (array<int>: start, end, ... in words) and hit_items (array<string>), with prefix before each name.

    A worker holds one block's automaton at a time: between blocks what was found so far is written, and read again for the next.
    """
    n_words, hit_runs, hit_items = (prefix + n for n in ("n_words", "hit_runs", "hit_items"))
    out = df.withColumns({n_words: F.lit(0).cast("long"), hit_runs: F.array().cast("array<int>"), hit_items: F.array().cast("array<string>")})
    context = df.sparkSession.sparkContext
    before = None
    for last, block in blocks(items, item_id, item_text, block_bytes):
        shared = _Shared(context.broadcast(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, window)
            for b in batches:
                column = lambda name, b=b: b.column(b.schema.get_field_index(name))
                texts, runs, names, counts = column(text_col).cast(pa.binary()).to_pylist(), column(hit_runs).to_pylist(), column(hit_items).to_pylist(), []
                for k, text in enumerate(texts):
                    words = words_of(text or b"")
                    found, items_found = automaton.stream(words)
                    counts.append(len(words))
                    if found:
                        runs[k] = merged(runs[k], found)
                        names[k] = sorted({*names[k], *items_found})
                made = {n_words: pa.array(counts, pa.int64()), hit_runs: pa.array(runs, pa.list_(pa.int32())), hit_items: pa.array(names, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([made.get(n, b.column(k)) for k, n in enumerate(b.schema.names)], names=b.schema.names)

        out = map_batches(out, run, out.schema)
        if not last:
            out, done = written(out, "scanned"), before
            before = out
            forgotten(done)
    return out


def n_hit(runs: str = "hit_runs"):
    """Words in runs: the sum of ends less the sum of starts."""
    return F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def digests(df: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: words, hit words, items that occur with the digest of their ids, and whether any word is hit."""
    found = scan(df.select(id_col, text_col), items, window, text_col=text_col)
    return found.select(
        F.col(id_col), "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), (F.size("hit_runs") > 0).alias("contaminated"),
    )


def without_runs(text: str, runs: list[int]) -> str:
    """text without the characters from a run's first word to its last one."""
    raw = text.encode()
    places = [m.span() for m in _word.finditer(raw.translate(_fold))]
    kept, at = [], 0
    for start, end in zip(runs[::2], runs[1::2], strict=True):
        kept.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    kept.append(raw[at:])
    return b"".join(kept).decode()


def clean(df: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = 0.8, text_col: str = "text") -> DataFrame:
    """df without the hit runs of its texts, and without rows of which more than most_coverage of the words are hit."""
    columns = list(df.columns)
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    found = scan(df, items, window, text_col=text_col, prefix=prefix)
    kept = found.where((F.size(prefix + "hit_runs") == 0) | (n_hit(prefix + "hit_runs") <= most_coverage * F.col(prefix + "n_words")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, runs = b.schema.get_field_index(text_col), b.column(b.schema.get_field_index(prefix + "hit_runs")).to_pylist()
            texts = [without_runs(t, r) if r else t for t, r in zip(b.column(k).to_pylist(), runs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == k else b.column(j) for j in range(len(columns))], names=columns)

    return map_batches(kept, run, df.schema)
