import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import neardup, repeats
from tests.llm.helpers import ROWS, components, shingles, table


def ids(rows):
    """Component ids by brute force, null ids last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    sorted_rows = [rows[k] for k in order]
    found = components([t for _, t in sorted_rows], 4)
    return Counter((sorted_rows[k][0], len(shingles(sorted_rows[k][1], 4)), sorted_rows[c][0]) for k, c in enumerate(found))


def near_rows(seed=0):
    random.seed(seed)
    out = []
    for _ in range(12):
        base = [random.choice("abcdefghij") * random.randint(1, 4) + str(random.randint(0, 50)) for _ in range(random.choice([5, 12, 60, 200]))]
        for _ in range(random.choice([1, 2, 8])):
            w = list(base)
            for _ in range(random.randint(0, max(1, len(w) // 25))):
                w[random.randrange(len(w))] = f"n{random.randint(0, 9999)}"
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize("rows", [ROWS, near_rows(1), near_rows(2)])
def test_components_equal_brute_force(spark, rows):
    got = neardup.near_duplicates(table(spark, rows), size=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == ids(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_documents(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = neardup.near_duplicates(df, size=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == ids(rows)


def variant_rows(pairs=100):
    """Copies of a text with one word changed, each with a further copy that is linked with it only but shares buckets with nearly all."""
    random.seed(5)
    base = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(pairs):
        for edits in (1, 11):
            own = list(base if edits == 1 else own)
            for at in random.sample(range(0, 400, 4), edits):
                own[at] = f"n{random.randint(0, 10**9)}"
            out.append(" ".join(own))
    return list(enumerate(out))


def test_links_between_classes_unlike_every_centre(spark):
    rows = variant_rows()
    got = neardup.near_duplicates(table(spark, rows), size=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == ids(rows)


def test_prints_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(3)
    for both, own in ((0, 1), (50, 20), (3000, 900)):
        a = np.unique(rng.integers(0, 2**63, both + own, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:both], rng.integers(0, 2**63, own, dtype=np.uint64)]))
        bits = sum(int(x).bit_count() for x in (neardup.print_of(a) ^ neardup.print_of(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and not (neardup.print_of(a) ^ neardup.print_of(a)).any()


def test_keep_one(spark):
    got = neardup.keep_one(table(spark))
    assert got.columns == table(spark).columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [0, 10, 11, 2, 3, 4, 6, 7, 8, 9]
    assert neardup.keep_one(table(spark).where("false")).count() == 0


def test_word_hashes_do_not_depend_on_neighbours():
    texts = [b"", b"a  B\tc", b"x" * 100 + b" y", b" lead", b"\xc3\xa9 z"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole, firsts = neardup.word_hashes(data, offsets)
    for k, t in enumerate(texts):
        alone, _ = neardup.word_hashes(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert list(whole[firsts[k] : firsts[k + 1]]) == list(alone) and len(alone) == len(t.split())


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = Counter()
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out[i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def hot_rows():
    random.seed(3)
    noise = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = noise(400)
    return [(k, noise(150 + k % 3) + passage + noise(200)) for k in range(40)] + [(100 + k, "zz" + passage[2 * k :]) for k in range(15)]


REPEATS = [(0, None), (1, ""), (2, "a" * 1000), (3, "ab" * 300), (3, "ab" * 300), (4, "é" * 400), (5, "x" * 199), (None, "a" * 300), (6, "q" * 200)]


@pytest.mark.parametrize("rows", [REPEATS, hot_rows()])
def test_repeats_equal_brute_force(spark, rows):
    got = repeats.without_repeats(table(spark, rows), 200, digest=True).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(rows, 200)


def test_hot_anchor_over_several_indexes(spark):
    """The same where an anchor's segments are dealt to several indexes."""
    rows = hot_rows()
    df = table(spark, rows)
    found = Counter()
    for r in marked_in_blocks([t.encode() for _, t in rows], 200, 5):
        found[r] += 1
    want = {(k, p) for k, (_, t) in enumerate(rows) for p in repeated(rows, k, 200)}
    assert set(found) == want
    assert df.count() == len(rows)


def repeated(rows, k, length):
    texts = [(t or "").encode() for _, t in rows]
    if not hasattr(repeated, "count"):
        repeated.count = Counter(t[j : j + length] for t in texts for j in range(len(t) - length + 1))
    return [j for j in range(len(texts[k]) - length + 1) if repeated.count[texts[k][j : j + length]] > 1]


def marked_in_blocks(texts, length, size):
    """repeats.marked over blocks of at most size segments of an anchor, and the count over blocks, without Spark."""
    groups = {}
    for k, t in enumerate(texts):
        for first, count, a, s in zip(*(x.tolist() for x in repeats.segments(t, length)), strict=True):
            groups.setdefault(a, {}).setdefault(s, []).append((k, first, count))
    windows, out = [], set()
    for a, kinds in groups.items():
        blocks = {}
        for s, places in kinds.items():
            if len(kinds) == 1 and len(places) == 1:
                continue
            for k, first, count in places:
                blocks.setdefault(s % -(-len(kinds) // size), []).append((a, 0, len(kinds) > size, len(places), k, first * repeats.PLACE + count, texts[k][first : first + count + length - 1]))
        for rows in blocks.values():
            windows += repeats.marked(rows, length)
    hashes = Counter(r[2:] for r in windows if r[2] is not None)
    for th, place, a, w, w2 in windows:
        if place is not None and (w is None or hashes[a, w, w2] > 1):
            first, count = divmod(place, repeats.PLACE)
            out |= {(th, first + j) for j in range(count)}
    return out


def test_run_index_matches_brute_force():
    random.seed(5)
    for _ in range(60):
        strings = list({bytes(random.choice(b"ab") for _ in range(random.randint(1, 12))) for _ in range(random.randint(1, 6))})
        index = repeats.RunIndex(strings)
        text = list(index.text)
        for i, n in enumerate(index.matching()):
            best = 0
            for j in range(len(text)):
                k = 0
                while i != j and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert n == best


def test_ids_of_any_type_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten " * 30
    rows = [(f"d{k}", text) for k in range(40)] + [("d0", text)] * 60 + [(None, text)] * 60 + [("x", None), ("y", ""), (None, "alone and short")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, size=4).collect())
    assert got == Counter((i, "d0" if t == text else i, i == ("d0" if t == text else i)) for i, t in rows)
    assert sorted(r["doc_id"] or "" for r in neardup.keep_one(df).collect()) == ["", "d0", "x", "y"]
    removed = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.without_repeats(df, 200).collect())
    assert removed == Counter((i, len(t or ""), len(text) if t == text else 0) for i, t in rows)
    assert max(r["n"] for r in repeats.repeated_places(df.selectExpr("xxhash64(text) th", "cast(text as binary) text").where("text is not null"), 200).groupBy("th").agg(F.size(F.collect_set("place")).alias("n")).collect()) < len(text)


def test_empty_tables(spark):
    assert neardup.near_duplicates(table(spark).where("false")).count() == 0
    assert repeats.without_repeats(table(spark).where("false")).count() == 0
