"""Brute-force versions of the operators, and awkward rows."""

import re

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog again and again today"), (1, "the QUICK brown fox jumps over the lazy dog again and again today"), (1, "the QUICK brown fox jumps over the lazy dog again and again today"),
    (2, ""), (3, None), (None, "The quick brown fox jumps over the lazy dog again and again today"), (4, "a b"), (5, "A B"), (6, "é 😀 mail me at x.y@z.org or +49 30 1234567 now"),
    (7, "token=abcdefgh1234 " * 3), (8, "x" * 30_000), (9, "ab " * 5_000), (10, "    "), (11, "12 word"),
]


def table(spark, rows=None):
    """Rows with extra columns whose names operators might use for themselves."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, n_words int")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts, n, percent=80):
    """For each text: the smallest index that links lead to."""
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]
