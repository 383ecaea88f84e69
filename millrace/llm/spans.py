"""Spans of regular expressions in texts, by SQL functions only.

`split` gives what stands between the matches of a pattern and `regexp_extract_all` the matches, both in the
order of one scan, so running sums of their lengths are the matches' places in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters on either side of a match that count as its context.
CONTEXT = 48
#: Matches whose lengths are summed one by one at a time.
BLOCK = 128

SPAN = "array<struct<kind: string, rank: int, start: int, end: int, score: double>>"


def found(text: Column, pattern: str, groups: tuple[int, ...] = (0,)) -> Column:
    """Array of structs: start, end, g0 (the match), gN for other groups, left and right context in lower case.

    pattern must have all of its text as group 0 and must not match the empty string.
    """
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    more = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups if g]
    rows = F.arrays_zip(whole.alias("g0"), F.slice(between, 1, F.size(whole)).alias("pre"), F.slice(between, 2, F.size(whole)).alias("post"), *(c.alias(f"g{g}") for c, g in zip(more, [g for g in groups if g], strict=True)))
    names = ["g0", *(f"g{g}" for g in groups if g)]

    def placed(rows: Column, sizes: Column, ends: Column) -> Column:
        def place(row: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(ends, block) + total(F.slice(sizes, block * BLOCK + 1, i % BLOCK)) + F.length(row["pre"])
            return F.struct(
                start.cast("int").alias("start"), (start + F.length(row["g0"])).cast("int").alias("end"), *(row[n].alias(n) for n in names),
                F.lower(F.right(row["pre"], F.lit(CONTEXT))).alias("left"), F.lower(F.left(row["post"], F.lit(CONTEXT))).alias("right"),
            )

        return F.transform(rows, place)

    fields = ", ".join(f"{n}: string" for n in [*names, "left", "right"])
    none = F.from_json(F.lit("[]"), f"array<struct<start: int, end: int, {fields}>>")
    # Sums over whole blocks first, so that the work for n matches is n * BLOCK at most and not n * n.
    walked = let(rows, lambda r: let(F.transform(r, lambda x: F.length(x["pre"]) + F.length(x["g0"])), lambda sizes: let(block_ends(sizes), lambda ends: placed(r, sizes, ends))))
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(none)


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def block_ends(sizes: Column) -> Column:
    """0, and the running sum at the end of each block of sizes."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    return F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


def as_spans(matches: Column, kind: str, rank: int, score: Column | None = None, keep=lambda m: F.lit(True), scored=None) -> Column:
    """Matches for which keep holds, as an array of (kind, rank, start, end, score)."""
    of = scored or (lambda m: F.lit(1.0))
    return F.transform(
        F.filter(matches, keep),
        lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), of(m).cast("double").alias("score")),
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, start_first: bool) -> Column:
    """By rank, then start; or by start, then rank."""
    keys = ("start", "rank", "end") if start_first else ("rank", "start", "end")
    names = [*keys, *(n for n in ("kind", "score"))]
    return F.array_sort(F.transform(spans, lambda s: F.struct(*(s[n].alias(n) for n in names))))
