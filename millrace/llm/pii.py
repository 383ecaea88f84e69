"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Everything runs as SQL functions inside the scan's stage: no shuffle, no Python. Patterns use possessive
quantifiers and look-behind so that each scan is linear in the text's length.

Kinds, in order: email, ip, card (Luhn), phone, then those that the score admits beside them: iban (mod 97),
short_card (13 to 15 digits, Luhn and a context word), ssn (form and a context word). Base kinds are kept
whatever their score. Null texts count as empty and have no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import as_spans, found, in_order, joined

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "ssn")

PATTERNS = {
    # A start inside a run of local characters is only tried right behind a match: elsewhere the run's own start has failed already.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "short_card": r"(?<![0-9A-Za-z+.-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
CONTEXT_WORDS = {
    "email": r"\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)",
    "ip": r"\b(?:ip|host|server|address|login|addr)\b",
    "card": r"\b(?:card|visa|master|amex|credit|debit|tarjeta|carte|karte|payment)",
    "phone": r"\b(?:phone|tel|call|mobile|fax|cell|telefon|tel[eé]f|t[eé]l)",
    "iban": r"\b(?:iban|account|bank|konto|cuenta|compte)",
    "ssn": r"\b(?:ssn|social|security)\b",
}
#: Score of a pattern alone, what a passed checksum adds, and what a context word adds.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.5, "iban": 0.2, "short_card": 0.1, "ssn": 0.3}
CHECKED, CHECKSUM, CONTEXT = ("card", "iban", "short_card"), 0.5, 0.2
#: The score that a kind needs which is not a base kind.
ADMITTED = {"iban": 0.5, "short_card": 0.75, "ssn": 0.45}


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m["g0"], r"[^0-9]", "")


def valid_ip(m: Column) -> Column:
    return F.forall(F.split(m["g0"], r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def valid_card(m: Column) -> Column:
    digits = digits_of(m)
    return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)


def luhn(digits: Column) -> Column:
    """The sum of the digits, each second one from the right doubled and reduced by 9 above 9, ends in 0."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.try_to_number(d, F.lit("9")).cast("int"))))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid_iban(m: Column) -> Column:
    """mod 97 of the number in which the first four characters stand last and letters are 10 to 35 is 1."""
    plain = F.regexp_replace(m["g0"], " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    alphabet = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def step(a: Column, c: Column) -> Column:
        v = F.instr(alphabet, c) - 1
        return F.when(c == "", a).when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def context(kind: str):
    words = CONTEXT_WORDS[{"short_card": "card"}.get(kind, kind)]
    return lambda m: F.when(F.regexp_like(m["left"], F.lit(words)) | F.regexp_like(m["right"], F.lit(words)), CONTEXT).otherwise(0.0)


def score_of(kind: str):
    alone = PRIOR[kind] + (CHECKSUM if kind in CHECKED else 0)
    return lambda m: F.lit(alone) + context(kind)(m)


def admits(kind: str, valid):
    """Base kinds need to be valid; the others need a score as well."""
    if kind in BASE:
        return valid
    score = score_of(kind)
    return lambda m: valid(m) & (score(m) >= ADMITTED[kind])


def spans_of(text: Column) -> Column:
    """All spans of a text as an array of (rank, start, end, kind, score), in that order."""
    always = lambda m: F.lit(True)
    check = {
        "email": always, "ip": valid_ip, "card": valid_card, "phone": lambda m: F.length(digits_of(m)).between(8, 15),
        "iban": valid_iban, "short_card": lambda m: luhn(digits_of(m)), "ssn": lambda m: ~F.regexp_like(m["g0"], F.lit(r"^(?:000|666|9)|-00-|-0000$")),
    }
    parts = []
    for rank, kind in enumerate(KINDS):
        parts.append(as_spans(found(text, PATTERNS[kind]), kind, rank, keep=admits(kind, check[kind]), scored=score_of(kind)))
    return in_order(F.concat(*parts), start_first=False)


def with_spans(df: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """df with its texts' spans in one more column; a column that has its name already is replaced, so name another one to keep it."""
    return df.withColumn(spans_col, spans_of(F.coalesce(F.col(text_col), F.lit(""))))


def redacted(text: Column, spans: Column) -> Column:
    """text with every span, overlapping ones as one, replaced by the kind in brackets."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        inside = s["start"] < done["at"]
        return F.struct(
            F.when(inside, done["out"]).otherwise(F.concat(done["out"], F.substr(text, done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        )

    return F.aggregate(by_start, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1)))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with personal data in text_col replaced; null texts stay null."""
    text = F.col(text_col)
    return df.withColumn(text_col, F.when(text.isNotNull(), redacted(text, spans_of(F.coalesce(text, F.lit(""))))))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of their spans, all spans, and the highest score."""
    spans = with_spans(df.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, "pii_spans")
    kept = F.filter("pii_spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        F.col(id_col), *map(count, BASE), F.sha2(joined(kept), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"),
        F.array_max(F.transform("pii_spans", lambda s: s["score"])).alias("max_score"),
    )
