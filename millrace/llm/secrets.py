"""Secrets in texts: fixed forms, and strings that look random to a pair of character Markov models.

Two first-order models, one of random strings and one of ordinary identifiers, are trained from labelled
samples: counts of character pairs, smoothed. A candidate's score is the mean log-likelihood ratio of its
pairs. Candidates over the threshold are added as kind `random`; the fixed forms (assign, access, hex) are
kept whatever their score. Training and scoring are SQL functions; no shuffle but that of the pair counts, whose
number is bounded by the alphabet. Null texts count as empty and have no spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.spans import as_spans, found, in_order, joined

BASE = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+",
}
#: Symbols of the models; 0 stands for any other character.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-."
SIZE = len(ALPHABET) + 1
SMOOTHING = 0.5
#: Mean log-likelihood ratio of a pair, in nats, from which a candidate counts as random.
THRESHOLD = 0.6

#: Fixed words of which the ordinary identifiers among the samples are made.
WORDS = (
    "account action active address admin agent alert array asset async audit back base batch binary block body branch bucket buffer build "
    "button byte cache call cancel card cart category channel check child class click client clock close cloud code collection color column "
    "command comment commit config connect console container content context control copy count create current custom data date debug default "
    "delete delta depth detail device dialog disk display document domain download draft driver edge edit element email enable engine entity "
    "error event exchange execute export factory feature field file filter final find first flag folder font form format frame function game "
    "gateway global graph group handle hash head header height helper host html image import index info init input insert instance item job "
    "join json kernel label language layer layout left length level library limit line link list load local lock logger login loop machine "
    "main manager map margin master match memory menu merge message method metric model module monitor mount mouse name network node number "
    "object offset open option order output owner package page panel parent parse partition path pattern payload point policy pool position "
    "prefix preview price print process product profile project property proxy public query queue range rate read record region release "
    "remote render report request reset resource response result return right role root route rule sample scale schema scope screen script "
    "search section select send sequence server service session shape share size sort source space split stack start state static status "
    "step store stream string style submit suffix switch symbol sync system table target task template test text theme thread time title "
    "total trace track train transform tree trigger type update upload user util value vector version video view watch width window worker"
)


def samples(spark: SparkSession, count: int = 4000, first: int = 0) -> DataFrame:
    """Labelled samples (value, random) by rule, from number first on: digests in several encodings, and words joined in usual ways."""
    ids = spark.range(first, first + count)
    digest = lambda k: F.unhex(F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256))
    kind = F.col("id") % 4
    value = F.when(kind == 0, F.base64(digest(0))).when(kind == 1, F.lower(F.hex(digest(1)))).when(kind == 2, F.regexp_replace(F.base64(digest(2)), "[+/=]", "")).otherwise(F.upper(F.regexp_replace(F.base64(digest(3)), "[+/=]", "")))
    words = F.split(F.lit(WORDS), " ")
    word = lambda k: F.get(words, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.size(words)).cast("int"))
    parts = [word(k) for k in range(4)]
    number = F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(1000)).cast("string")
    plain = (
        F.when(kind == 0, F.concat_ws("_", *parts, number)).when(kind == 1, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]], number))
        .when(kind == 2, F.concat_ws("/", *parts)).otherwise(F.concat_ws("-", F.upper(parts[0]), parts[1], parts[2], number))
    )
    return ids.select(value.alias("value"), F.lit(True).alias("random")).unionAll(ids.select(plain, F.lit(False)))


def symbol(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c))


def pairs_of(value: Column) -> Column:
    """Numbers of the pairs of symbols in a string."""
    at = F.transform(F.split(value, ""), symbol)
    return F.zip_with(F.slice(at, 1, F.greatest(F.length(value) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.length(value) - 1, F.lit(0))), lambda a, b: a * SIZE + b)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of the second symbol after the first, by pair number.

    labelled: columns value and random. Nulls are ignored. What comes to the driver is bounded by the alphabet.
    """
    known = labelled.where(F.col("value").isNotNull() & F.col("random").isNotNull())
    counts = known.select("random", F.explode(pairs_of(F.col("value"))).alias("pair")).groupBy("random", "pair").count().collect()
    table = {True: [SMOOTHING] * SIZE**2, False: [SMOOTHING] * SIZE**2}
    for r in counts:
        table[r["random"]][r["pair"]] += r["count"]

    def log_row(t: list[float], a: int) -> list[float]:
        row = t[a * SIZE : (a + 1) * SIZE]
        return [math.log(x / sum(row)) for x in row]

    return [x - y for a in range(SIZE) for x, y in zip(log_row(table[True], a), log_row(table[False], a), strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's pairs; 0 for strings without any."""
    weights = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    numbers = pairs_of(value)
    return F.aggregate(numbers, F.lit(0.0), lambda a, p: a + F.get(weights, p)) / F.greatest(F.size(numbers), F.lit(1))


def spans_of(text: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """All spans of a text as an array of (start, rank, end, kind, score), in that order; the score is the ratio."""
    scored = lambda m: ratio(m["g0"], model)
    base = F.concat(
        as_spans(found(text, PATTERNS["assign"], (0, 2)), "assign", 0, keep=lambda m: F.length(m["g2"]) >= 8, scored=lambda m: ratio(m["g2"], model)),
        as_spans(found(text, PATTERNS["access"]), "access", 1, scored=scored),
        as_spans(found(text, PATTERNS["hex"]), "hex", 2, scored=scored),
    )
    odd = F.filter(as_spans(found(text, PATTERNS["random"]), "random", 3, scored=scored), lambda s: s["score"] >= threshold)

    def beside(bases: Column) -> Column:
        return F.filter(odd, lambda s: ~F.exists(bases, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    return in_order(F.concat(base, F.when(F.size(odd) > 0, beside(base)).otherwise(odd)), start_first=True)


def with_spans(df: DataFrame, model: list[float], text_col: str = "text", spans_col: str = "secret_spans", threshold: float = THRESHOLD) -> DataFrame:
    """df with its texts' spans in one more column; a column that has its name already is replaced, so name another one to keep it."""
    return df.withColumn(spans_col, spans_of(F.coalesce(F.col(text_col), F.lit("")), model, threshold))


def digests(df: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of their spans, all spans, and the highest ratio."""
    model = train(samples(df.sparkSession) if labelled is None else labelled)
    spans = with_spans(df.select(F.col(id_col), F.col(text_col)), model, text_col).select(id_col, "secret_spans")
    kept = F.filter("secret_spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        F.col(id_col), *map(count, BASE), F.sha2(joined(kept), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"),
        F.array_max(F.transform("secret_spans", lambda s: s["score"])).alias("max_ratio"),
    )
