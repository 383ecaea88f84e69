import base64
import cmath
import dataclasses
import hashlib
import random
import zlib
from collections import Counter
import io
import itertools
import math
import os
import wave

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from millrace.llm import bpe, decontam, lm, media, quality, shards
from tests.llm.helpers import ROWS, lower, table, words


def test_bpe_equals_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    odd = ["  \n\n a  b\t c", " \x1c x\x1d\x85y", "don't I'll 'd", " " * 100, "日本語 テスト", "　　x   z", "<|endoftext|>", "".join(random.choice("abc \n'1é") for _ in range(3000)), "ab1" * 4000]
    texts = odd + [t for _, t in ROWS]
    df = table(spark, list(enumerate(texts)))
    for r in bpe.digests(df, path, public_tokenizers.PATTERN, with_ids=True).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["ids"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), ids)
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    encoded = bpe.encode(df, path, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded, path, public_tokenizers.PATTERN).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}


def test_merge_order_with_made_up_ranks():
    """Ranks in which a merge opens a lower-ranked pair."""
    random.seed(2)
    for _ in range(200):
        tokens = {bytes([c]): k for k, c in enumerate(b"abc")}
        made = sorted({bytes(random.choice(b"abc") for _ in range(random.randint(2, 4))) for _ in range(8)})
        random.shuffle(made)
        tokens |= {t: 3 + k for k, t in enumerate(made)}
        pieces = [bytes(random.choice(b"abc") for _ in range(random.randint(1, 12))) for _ in range(5)]
        for piece, got in zip(pieces, bpe.merge_all(pieces, tokens), strict=True):
            parts = [piece[k : k + 1] for k in range(len(piece))]
            if piece in tokens:
                parts = [piece]
            while True:
                ranked = [(tokens[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in tokens]
                if not ranked:
                    break
                _, k = min(ranked)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert got == [tokens[p] for p in parts]


def brute_hits(doc, items, window):
    w, hit, found = decontam.words_of(doc), set(), set()
    for name, text in items:
        v = decontam.words_of(text)
        n = min(window, len(v))
        runs = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in runs:
                hit |= set(range(k, k + n))
                found.add(name)
    return len(w), hit, found


def test_decontamination_equals_brute_force(spark):
    random.seed(3)
    for _ in range(150):
        letters = "abc"[: random.randint(1, 3)]
        items = [(str(k), " ".join(random.choice(letters) for _ in range(random.randint(0, 8))).encode()) for k in range(random.randint(0, 5))]
        doc = " ".join(random.choice("abcd") for _ in range(random.randint(0, 40))).encode()
        window = random.randint(1, 5)
        runs, names = decontam.Automaton(items, window).stream(decontam.words_of(doc))
        _, hit, found = brute_hits(doc, items, window)
        assert {x for a, b in zip(runs[::2], runs[1::2], strict=True) for x in range(a, b)} == hit and names == found
    items = [(1, "one two three four five six seven eight nine TEN eleven"), (2, "a b"), (3, None), (4, ""), (None, "quick brown"), (10, "jumps over"), (10, "jumps over")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = [("" if i is None else str(i), (t or "").encode()) for i, t in items]
    docs = [*ROWS, (20, "keep this and that and x ONE two, three-four five six seven eight nine ten! y"), (21, "one two three four five six seven eight nine")]
    for block in (decontam.BLOCK_BYTES, 20):  # one automaton, and several
        found = decontam.scan(table(spark, docs).select("doc_id", "text"), bench, block_bytes=block).collect()
        texts = Counter((r["doc_id"], r["n_words"], sum(r["hit_runs"][1::2]) - sum(r["hit_runs"][::2]), tuple(sorted(r["hit_items"]))) for r in found)
        want = Counter((i, n, len(hit), tuple(sorted(names))) for i, t in docs for n, hit, names in [brute_hits((t or "").encode(), plain, 10)])
        assert texts == want
    got = decontam.digests(table(spark, docs), bench).where("doc_id = 20").first()
    assert (got["n_hit"], got["items_sha256"], got["contaminated"]) == (10, hashlib.sha256(b"1").hexdigest(), True)
    cleaned = {r["doc_id"]: r["text"] for r in decontam.clean(table(spark, docs), bench).collect()}
    assert cleaned[20] == "keep this and that and x ! y"
    assert cleaned[21] == docs[-1][1] and 4 not in cleaned and decontam.clean(table(spark), bench).columns == table(spark).columns
    repeated = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again")] * 2000, "item_id long, text string")
    assert sorted(len(b) for _, b in decontam.blocks(repeated, "item_id", "text", 20)) == [0, 0, 1]
    many = spark.createDataFrame([(k, f"w{k} x{k} y{k}") for k in range(80)], "item_id long, text string")
    assert len(list(decontam.blocks(many, "item_id", "text", 20))) > 40
    found = decontam.scan(table(spark, [(1, " ".join(f"w{k} x{k} y{k} and" for k in range(0, 80, 9)))]).select("doc_id", "text"), many, block_bytes=100).first()
    assert found["hit_items"] == sorted(str(k) for k in range(0, 80, 9)) and found["n_words"] == 36
    assert decontam.digests(table(spark), bench.where("false")).where("contaminated").count() == 0


def test_media(spark):
    rows = {r["doc_id"]: r for r in media.digests(table(spark, [(k, t) for k, (_, t) in enumerate(ROWS)])).collect()}
    for k, (_, t) in enumerate(ROWS):
        text = (t or "").encode()
        payload = text + bytes(-len(text) % 64 or (64 if not text else 0))
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_wav(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert [(x["frame"], x["code"]) for x in r["fingerprint"]] == list(zip(*map(np.ndarray.tolist, media.fingerprint(payload)), strict=True))
    assert media.digests(table(spark).where("false")).count() == 0
    assert rows[1]["feature"] == rows[2]["feature"] and rows[8]["feature"] != rows[10]["feature"]
    df = media.with_fingerprints(table(spark, [(0, "abcdefgh" * 500)]))
    r = df.first()
    with wave.open(io.BytesIO(bytes(r["media"]))) as w:
        assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == bytes(r["payload"])
    frames, codes = media.fingerprint(bytes(r["payload"]))
    assert [(x["frame"], x["code"]) for x in r["fingerprint"]] == list(zip(frames.tolist(), codes.tolist(), strict=True)) and len(frames)


def test_fingerprint_equals_brute_force(monkeypatch):
    random.seed(4)
    data = media.padded(bytes(random.randrange(256) for _ in range(700)))
    mean, half = sum(data) / len(data), media.FRAME // 2
    line = [x - mean for x in data] + [0.0] * media.FRAME
    window = [0.5 - 0.5 * math.cos(2 * math.pi * n / (media.FRAME - 1)) for n in range(media.FRAME)]
    peaks = []
    for f in range(len(data) // media.HOP):
        part = [x * w for x, w in zip(line[f * media.HOP : f * media.HOP + media.FRAME], window, strict=True)]
        size = [abs(sum(x * cmath.exp(-2j * math.pi * k * n / media.FRAME) for n, x in enumerate(part))) for k in range(half + 1)]
        least = media.STANDS_OUT * sum(size[media.BANDS[0] : media.BANDS[-1]]) / (media.BANDS[-1] - media.BANDS[0])
        tops = [max(range(a, b), key=size.__getitem__) for a, b in zip(media.BANDS, media.BANDS[1:], strict=False)]
        peaks.append([k for k in tops if size[k] >= least])
    want = sorted((f, a << 16 | b << 8 | d) for f in range(len(peaks)) for d in range(1, media.REACH + 1) if f + d < len(peaks) for a in peaks[f] for b in peaks[f + d])
    for block in (media.BLOCK_FRAMES, 3):  # the same in blocks
        monkeypatch.setattr(media, "BLOCK_FRAMES", block)
        frames, codes = media.fingerprint(data)
        assert sorted(zip(frames.tolist(), codes.tolist(), strict=True)) == want and want


def test_tone_gives_its_bin():
    tone = (128 + 100 * np.sin(2 * np.pi * 30 * np.arange(media.FRAME * 8) / media.FRAME)).astype(np.uint8).tobytes()
    assert (media.peaks(tone)[:-1, 3] == 30).all() and (media.peaks(tone)[:-1, [0, 1, 4]] == -1).all()


def test_shards(spark):
    random.seed(6)
    rows = [(random.choice([1, 7, 7, 7, None, -5, 10**12, k]), "x" * random.choice([0, 1, 5, 300])) for k in range(700)] + [(0, None)]
    got = shards.shard(table(spark, rows), 16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 2 * 301
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["law"] for r in got} == {"bytes"} and shards.shard(table(spark).where("false")).count() == 0
    named = spark.createDataFrame([(f"d{k % 90}" if k % 5 else None, "x" * (k % 50)) for k in range(400)], "doc_id string, text string")
    by_name = shards.shard(named, 8).collect()
    assert Counter(r["doc_id"] for r in by_name) == Counter(r["doc_id"] for r in named.collect()) and len({(r["shard"], r["slot"]) for r in by_name}) == 400
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    keys = [-(2**63) if r["doc_id"] is None else r["doc_id"] for r in order]
    assert keys == sorted(keys)


def test_quality(spark):
    random.seed(8)
    good = lambda: " ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9))) for _ in range(random.randint(20, 200))) + "."
    bad = lambda: " ".join("BUY!! $$$ " + str(random.randint(0, 9)) for _ in range(random.randint(20, 100)))
    rows = [(k, good() if k % 3 else bad()) for k in range(300)] + [(1000, None), (1001, ""), (None, "x")]
    labels = spark.createDataFrame([(k, 1 if k % 3 else 0) for k in range(300)] + [(5, None), (6, 7), (None, 1)], "doc_id long, quality int")
    got = quality.digests(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["held_out"]]
    assert len(held) > 40 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held)
    assert sum(r["predicted"] == (1 if r["doc_id"] % 3 else 0) for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(table(spark, rows), labels)
    assert kept.columns == table(spark).columns and kept.where("doc_id < 300").count() == sum(r["predicted"] for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    for one in (labels.where("false"), labels.where("quality = 1")):  # no model: nothing is rejected
        assert {r["score"] for r in quality.digests(table(spark), one).collect()} == {0.5}
        assert quality.keep_good(table(spark), one).count() == len(ROWS)
    assert quality.digests(table(spark).where("false"), labels).count() == 0 and quality.keep_good(table(spark).where("false"), labels).count() == 0


def test_quality_equals_brute_force(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    labels = labels.unionAll(labels.limit(20))  # a document with two labels counts twice
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    x = {k: np.array([quality.features(texts[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in texts and not held[r["doc_id"]] and r["quality"] == k]) for k in (0, 1)}
    own = {k: np.cov(x[k].T, bias=True) for k in x}
    both = sum(len(x[k]) * own[k] for k in x) / sum(map(len, x.values()))

    def density(k, v):
        c = (1 - quality.POOLED - quality.DIAGONAL) * own[k] + quality.POOLED * both + quality.DIAGONAL * np.diag(np.diag(both)) + quality.FLOOR * np.eye(len(both))
        d = v - x[k].mean(axis=0)
        return math.log(len(x[k])) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d)

    for r in quality.digests(docs, labels).collect():
        v = np.array(quality.features(texts[r["doc_id"]]))
        assert r["held_out"] == held[r["doc_id"]] and abs(r["score"] - 1 / (1 + math.exp(min(700, density(0, v) - density(1, v))))) < 1e-6


def random_weights(seed, spread):
    rng = np.random.default_rng(seed)
    return lm.first_weights(np.zeros(lm.CLASSES)) + rng.normal(0, spread, sum(math.prod(s) for s in lm.SHAPES.values())), rng


def test_lm_gradient():
    flat, rng = random_weights(0, 0.1)
    x, y = rng.integers(0, lm.CLASSES, (3, lm.WIDTH, 2)), rng.integers(0, lm.CLASSES, (3, lm.STRIDE))
    _, grad = lm.loss_gradient(flat, x, y)
    for k in rng.integers(0, len(flat), 40):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (lm.loss_gradient(up, x, y)[0] - lm.loss_gradient(down, x, y)[0]) / 2e-5
        assert abs(slope - grad[k]) < 1e-4 + 1e-3 * abs(slope)


def test_lm_gradient_of_weights_with_large_logits():
    flat, rng = random_weights(5, 0.1)
    x, y = rng.integers(0, lm.CLASSES, (2, lm.WIDTH, 2)), rng.integers(-1, lm.CLASSES, (2, lm.STRIDE))
    w = lm.unpacked(flat)
    w["bias"] += rng.normal(0, 400, lm.CLASSES)
    loss, grad = lm.loss_gradient(flat, x, y)
    logits = lm.forward(lm.unpacked(flat), x)[0].reshape(-1, lm.CLASSES)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at = np.flatnonzero(y.ravel() >= 0)
    top = logits.max(axis=1)
    plain = (np.log(np.exp(logits - top[:, None]).sum(axis=1)) + top - logits[np.arange(len(top)), y.ravel()])[at].mean()
    p[at, y.ravel()[at]] -= 1
    assert abs(loss - plain) < 1e-9 * abs(plain) and np.allclose(lm.unpacked(grad)["bias"], p[at].sum(axis=0) / len(at))


def test_lm_gradient_by_parts_of_rows():
    """Windows together, more rows than are worked on at once, give what they give one by one, also if only some rows have large logits."""
    flat, rng = random_weights(8, 0.3)
    n = 2 * lm.ROWS_AT_ONCE // lm.STRIDE + 1
    x, y = rng.integers(0, lm.CLASSES - 1, (n, lm.WIDTH, 2)), rng.integers(-1, lm.CLASSES, (n, lm.STRIDE))
    lm.unpacked(flat)["first"][-1] = 300
    x[-2, lm.CONTEXT + 5 :: 3, 0] = lm.CLASSES - 1
    assert np.abs(lm.forward(lm.unpacked(flat), x[-2:-1])[0]).max() > 150 > np.abs(lm.forward(lm.unpacked(flat), x[:-2])[0]).max()
    counts = (y >= 0).sum(axis=1)
    each = [lm.loss_gradient(flat, x[k : k + 1], y[k : k + 1]) for k in range(n)]
    loss, grad = lm.loss_gradient(flat, x, y)
    want = sum(c * g for c, (_, g) in zip(counts, each, strict=True)) / counts.sum()
    assert np.isclose(loss, sum(c * e for c, (e, _) in zip(counts, each, strict=True)) / counts.sum()) and np.allclose(grad, want, rtol=1e-6, atol=1e-9 * np.abs(want).max())
    w = lm.unpacked(flat)
    logits = lm.forward(w, x)[0]
    top = logits.max(axis=-1)
    at = np.maximum(y, 0)
    plain = (np.take_along_axis(logits, at[:, :, None], axis=2)[:, :, 0] - top - np.log(np.exp(logits - top[:, :, None]).sum(axis=-1))) / math.log(10)
    assert np.allclose(lm.log10_probabilities(w, x, at, 2), plain, rtol=1e-5, atol=1e-5)


def test_lm_room_is_used_again():
    """Wide arrays are taken once for batches of all sizes, and results do not depend on what was in them."""
    flat, rng = random_weights(6, 0.2)
    w, room = lm.unpacked(flat.astype(np.float32)), lm.Room()
    parts = [rng.integers(0, lm.CLASSES, (n, lm.WIDTH, 2)) for n in (5, 2, 5)]
    found = [lm.forward(w, x, room)[0].copy() for x in parts]
    held = {k: id(v) for k, v in room.held.items()}
    assert all((lm.forward(w, x)[0] == f).all() for x, f in zip(parts, found, strict=True))
    lm.forward(w, parts[1], room)
    assert held == {k: id(v) for k, v in room.held.items()}


def test_lm_keeps_the_scorer_from_task_to_task(spark):
    def run(batches):
        for b in batches:
            made = []
            lm.kept_in_worker("a number", lambda: made.append(1) or "scorer")
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(made)])], names=["worker", "made"])

    found = spark.range(0, 12, 1, 12).mapInArrow(run, "worker long, made long").collect()
    workers = {r["worker"] for r in found}
    assert len(workers) < 12 and sum(r["made"] for r in found) == len(workers)


def test_lm_attends_to_the_past_only_and_sums_to_one():
    flat, rng = random_weights(1, 0.2)
    w = lm.unpacked(flat.astype(np.float32))
    x = rng.integers(0, lm.CLASSES, (1, lm.WIDTH, 2))
    later = x.copy()
    later[0, -1] = (x[0, -1] + 1) % lm.CLASSES
    a, b = lm.forward(w, x)[0], lm.forward(w, later)[0]
    assert np.allclose(a[0, :-1], b[0, :-1]) and not np.allclose(a[0, -1], b[0, -1])
    every = sum(10 ** lm.log10_probabilities(w, x, np.full((1, lm.STRIDE), c))[0, 0] for c in range(lm.CLASSES))
    assert abs(every - 1) < 1e-4


def test_lm_words_of_a_class_sum_to_one(monkeypatch):
    """Over a vocabulary of three ids and the end: all strings of ids up to a length, known ones with their counts."""
    monkeypatch.setattr(lm, "HEAD", 2)
    monkeypatch.setattr(lm, "TAILS", 1)
    monkeypatch.setattr(lm, "CLASSES", 3)
    end, stop = 3, 4
    known = {(0,): 5, (0, 1): 2, (1, 2): 1, (2, 2, 0): 3, (end,): 4}
    counts = {n: np.zeros(4, np.int64) for n in ("first", "last", "types", "held")}
    follow = Counter()
    state = np.arange(4)
    for word, c in known.items():
        counts["first"][word[0]] += c
        counts["last"][word[-1]] += c
        counts["types"][word[0]] += 1
        for a, b in zip(word, [*word[1:], stop], strict=True):
            counts["held"][a] += 1
            if word != (end,):
                follow[int(state[a]) * 5 + b] += 1
    keys = np.array(sorted(follow))
    lexicon = lm.Lexicon.make(counts, state, keys, np.array([follow[k] for k in keys]))
    strings = [list(w) for n in range(1, 9) for w in itertools.product(range(3), repeat=n)] + [[end]]
    classes, _, weight = lexicon.spelled(strings)
    inside = 10 ** lexicon.inside(classes, weight, np.array([known.get(tuple(w), 0) for w in strings]))
    sums = np.bincount(classes, inside)
    assert abs(sums[0] - 1) < 1e-9 and all(0.8 < s <= 1 + 1e-9 for s in sums[1:])


def pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return path, spark.sparkContext.broadcast(f.read())


def plain_fit(spark, texts):
    """The model of the texts, as fit() makes it."""
    _, model = pieces(spark)
    rows = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    return lm.fit(rows, lm.word_counts(rows), model)


def test_lm_trains_on_every_token_once(spark):
    _, model = pieces(spark)
    splitter = lm.Splitter(model.value)
    texts = ["", "a b", "The quick brown fox " * 60, " ".join(f"w{k}" for k in range(9000))]
    lexicon = plain_fit(spark, texts).lexicon
    found = lm.training_lines(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"), model, lexicon).collect()
    windows = [lm.windows_of([bytes(r["x"])]) for r in found]
    assert [len(x) for x in windows] == [r["windows"] for r in found] and (lm.windows_of([bytes(r["x"]) for r in found]) == np.concatenate(windows)).all()
    assert {r["turn"] for r in found} <= set(range(lm.ROUNDS))
    predicted = np.concatenate(windows)[:, lm.CONTEXT + 1 :]
    want = [(int(lexicon.of[x[0]]), int(lexicon.last[x[-1]])) for t in texts for x in splitter.ids(lm.words_of(t.encode()))]
    assert Counter(map(tuple, predicted[predicted[:, :, 0] >= 0].tolist())) == Counter(want)
    # Without the end of a line, a window goes on where the one before it ended.
    assert all((x[1:, : lm.CONTEXT + 1] == x[:-1, lm.STRIDE :]).all() for x in windows)
    flat = lm.first_weights(lexicon.prior)
    x, y = np.maximum(windows[0][:, : lm.WIDTH], 0), windows[0][:, lm.CONTEXT + 1 :, 0].astype(np.int64)
    other = np.where(y < 0, -5, y)
    assert (lm.loss_gradient(flat, x, y)[1] == lm.loss_gradient(flat, x, other)[1]).all() and np.isfinite(lm.loss_gradient(flat, x, y)[0])


def plain_score(tokens, ids, model, counts):
    """log10 probability of one text, place by place, without windows' arrays, shared words and joins."""
    w, k = lm.unpacked(model.flat.astype(np.float64)), model.lexicon
    stop = len(k.state)
    table = dict(zip(k.keys.tolist(), k.seen.tolist(), strict=True))
    pairs = [(0, 0)] * (lm.CONTEXT + 1) + [(k.of[x[0]], k.last[x[-1]]) for x in ids]
    total = 0.0
    for t, (word, x) in enumerate(zip(tokens, ids, strict=True)):
        window, place = divmod(t, lm.STRIDE)
        seen = pairs[window * lm.STRIDE : window * lm.STRIDE + lm.CONTEXT + place + 1]
        e = np.array([w["first"][a] + w["last"][b] + w["place"][i] for i, (a, b) in enumerate(seen)])
        a = np.exp((e @ w["key"]) @ (e[-1] @ w["query"]) / math.sqrt(lm.DIM))
        h = e[-1] + ((a / a.sum()) @ (e @ w["value"])) @ w["mix"]
        logits = (h + np.maximum(h @ w["up"] + w["up_bias"], 0) @ w["down"]) @ w["out"] + w["bias"]
        c = int(k.of[x[0]])
        total += (logits[c] - np.log(np.exp(logits).sum())) / math.log(10)
        if word != "\n":
            spelled = k.left[c] + k.opening[x[0]] + sum(table.get(int(k.state[p]) * (stop + 1) + q, k.alone[q] - k.unseen[k.state[p]]) for p, q in zip(x, [*x[1:], stop], strict=True))
            total += (math.log10(max(counts[word] - lm.DISCOUNT, 0) + 10.0**spelled) if spelled > -300 or counts[word] else spelled) - k.whole[c]
    return total


def test_lm_scores_equal_brute_force(spark, data, monkeypatch):
    path, model = pieces(spark)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(table(spark).select("doc_id", "text"))
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r["doc_id"]) for w in [*words(r["text"]), "\n"])
    n, v = sum(counts.values()), len(counts)
    fitted = plain_fit(spark, [r["text"] or "" for r in rows if not held(r["doc_id"])])
    assert (fitted.total, fitted.distinct) == (n, v)
    splitter = lm.Splitter(model.value)
    want, model_scores = Counter(), []
    for r in rows:
        tokens = [*words(r["text"]), "\n"]
        want[r["doc_id"], held(r["doc_id"]), len(tokens), sum(counts[t] > 0 for t in tokens), n, f"{sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens):.6g}"] += 1
        if len(tokens) < 400:
            model_scores.append((len(tokens), plain_score(tokens, splitter.ids(lm.words_of((r["text"] or "").encode())), fitted, counts)))
    for most in (lm.COMMON_WORDS, 50, 0):  # all words common, most of them joined, and all of them
        monkeypatch.setattr(lm, "COMMON_WORDS", most)
        got = lm.scores(docs, path, model=fitted).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6g}") for r in got) == want
        assert np.allclose(sorted((r["n_tokens"], r["score"]) for r in got if r["n_tokens"] < 400), sorted(model_scores), rtol=1e-4)
    assert lm.scores(docs.where("false"), path).count() == 0
    assert lower("ÀB") == "Àb"


def test_lm_tokens_of_a_batch():
    """Words of all texts at once are those of each text, whatever is at its ends and between them."""
    odd = ["".join(map(chr, range(256))), "", " ", "\t\n a\x0b\x0cB \r", "\x1c\x85x\xa0Y\u2003z\u2028", "É ß İ Ⅷ ﬁ K", "a A  a", "\n", "x\n\nX"]
    texts = [t.encode() for t in odd] + [f" {t} ".encode() for t in odd]
    for kind in (pa.binary(), pa.large_binary()):
        for part in (slice(0, len(texts)), slice(3, 9), slice(1, 2), slice(0, 0)):
            found, at, sizes = lm.tokens_of(pa.array([b"none", *texts], kind)[1:][part])
            assert [found[k] for k in at] == [w for t in texts[part] for w in lm.words_of(t)] and sizes.tolist() == [len(lm.words_of(t)) for t in texts[part]]
            assert len(set(found)) == len(found) and set(found) - {lm.END} <= set(found[k] for k in at)


def test_lm_reads_texts_twice(spark):
    """Training texts are read to count their words, and all texts once more; training and scoring go on from their classes."""
    path, _ = pieces(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(k, f"a text of few words {k} " * 20) for k in range(40)], "doc_id long, text string").coalesce(2)
    training = docs.where(~lm.held_out("doc_id")).count()
    seen = docs.mapInArrow(counted, docs.schema)
    assert lm.scores(seen, path).count() == 40 and 0 < training < 40
    assert read.value == 2 * 40


def test_lm_learns_from_context(spark):
    """Held-out texts: the trained network is better than the same lexicon with the classes' frequencies alone."""
    path, _ = pieces(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    training = docs.where(~lm.held_out("doc_id"))
    fitted = plain_fit(spark, [r["text"] or "" for r in training.collect()])
    mean = lambda m: docs.sparkSession.createDataFrame(lm.scores(docs, path, model=m).where("held_out").select("score", "n_tokens").collect()).selectExpr("sum(score) / sum(n_tokens)").first()[0]
    without = dataclasses.replace(fitted, flat=lm.first_weights(fitted.lexicon.prior))
    assert mean(fitted) > mean(without) + 0.25
