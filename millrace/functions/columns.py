"""Column expressions for flows: endpoints, flags, buckets, hashes, byte views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: TCP flag letters by bit, lowest bit first.
FLAG_LETTERS = "FSRPAUEC"


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat_ws(":", ip, port.cast("string"))


def endpoint_pair(one: Column, other: Column) -> Column:
    """Struct a, b: the two endpoints in string order, which is a flow's key whatever its direction."""
    return F.struct(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))


def host_of(end: Column, unknown: str | None = None) -> Column:
    """What stands before the last colon, all of it if there is none; null gives an empty host.

    With unknown: bracketed addresses lose their brackets, and an empty endpoint gives that name.
    """
    end = F.coalesce(end, F.lit(""))
    plain = F.when(end.contains(":"), F.regexp_extract(end, r"^(.*):[^:]*$", 1)).otherwise(end)
    if unknown is None:
        return plain
    return F.when(end == "", F.lit(unknown)).when(end.startswith("[") & end.contains("]"), F.regexp_extract(end, r"^\[([^\]]*)\]", 1)).otherwise(plain)


def port_of(end: Column) -> Column:
    """What stands behind the last colon, empty if there is none."""
    end = F.coalesce(end, F.lit(""))
    return F.when(end.contains(":"), F.substring_index(end, ":", -1)).otherwise("")


def endpoint_parts(end: Column) -> Column:
    """Struct host, port (int; null if it is no number)."""
    return F.struct(host_of(end).alias("host"), F.substring_index(end, ":", -1).try_cast("int").alias("port"))


def protocol_name(raw: Column) -> Column:
    """6 and 17, also as text with decimals, by name; others in lower case, null as empty."""
    text = F.lower(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))
    number = text.try_cast("double")
    return F.when(number == 6, "tcp").when(number == 17, "udp").otherwise(text)


def tcp_flag_letters(bits: Column) -> Column:
    """Letters of the set bits, lowest first."""
    return F.concat(*[F.when(bits.bitwiseAND(1 << k) != 0, c).otherwise("") for k, c in enumerate(FLAG_LETTERS)])


def flow_id(source_file: Column, key_text: Column, session: Column, start: Column) -> Column:
    """File stem, 16 hex digits of a digest of file, key, session and start, and the session's number."""
    stem = F.regexp_replace(F.regexp_extract(source_file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    digest = F.left(F.sha1(F.concat_ws("|", source_file, key_text, session.cast("string"), F.format_string("%.6f", start))), F.lit(16))
    return F.concat_ws("_", stem, digest, F.format_string("%06d", session))


def connection_type(protocol: Column, has_payload: Column, flags: Column) -> Column:
    """flags: all flag letters of the flow's packets joined."""
    return (
        F.when((protocol == "udp") & has_payload, "udp_payload").when(protocol == "udp", "udp_empty").when(protocol != "tcp", F.concat(protocol, F.lit("_other")))
        .when(has_payload, "tcp_payload").when(flags.contains("R"), "tcp_reset_or_refused").when(flags.contains("S"), "tcp_handshake_only")
        .when(flags.rlike("[FAPUEC]"), "tcp_control_only").otherwise("tcp_empty")
    )


def length_bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    """Name of the first range low-high whose bound value does not exceed; the first range starts at 1."""
    lows = (1, *(b + 1 for b in bounds))
    out = F.lit(f">{bounds[-1]}")
    for low, bound in reversed(list(zip(lows, bounds, strict=False))):
        out = F.when(value <= bound, f"{low}-{bound}").otherwise(out)
    return out


def payload_bucket(value: Column) -> Column:
    value = F.coalesce(value, F.lit(0))
    return F.when(value <= 0, "0").otherwise(length_bucket(value, (31, 127, 511, 2047, 8191)))


def packet_count_bucket(value: Column) -> Column:
    return F.when(value <= 0, "0").when(value <= 2, value.cast("string")).otherwise(length_bucket(value, (4, 8, 16, 32, 64)))


def packet_length_bins(lengths: Column, limit: int = 8) -> Column:
    return F.transform(F.slice(F.coalesce(lengths, F.array()), 1, limit), lambda v: length_bucket(v, (63, 127, 511, 1500)))


def direction_pattern(directions: Column, limit: int = 8) -> Column:
    """f for forward names, b for backward ones, ? for others."""
    letter = lambda d: F.when(F.lower(d).isin("fwd", "forward", "client"), "f").when(F.lower(d).isin("bwd", "backward", "server"), "b").otherwise("?")
    return F.array_join(F.transform(F.slice(F.coalesce(directions, F.array().cast("array<string>")), 1, limit), letter), "")


def shape_signature(connection: Column, lengths: Column, payload: Column, directions: Column) -> Column:
    """First 16 hex digits of the digest of the shape's text, the text being written as a Python tuple of strings."""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    bins = packet_length_bins(lengths)
    inner = F.when(F.size(bins) == 1, F.concat(F.lit("("), quoted(bins[0]), F.lit(",)"))).otherwise(F.concat(F.lit("("), F.array_join(F.transform(bins, quoted), ", "), F.lit(")")))
    count = packet_count_bucket(F.coalesce(F.size(lengths), F.lit(0)))
    parts = [quoted(F.coalesce(connection, F.lit("None"))), quoted(count), quoted(payload_bucket(payload)), quoted(direction_pattern(directions)), inner]
    return F.left(F.sha1(F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))), F.lit(16))


def stable_bucket(text: Column, buckets: int = 10_000) -> Column:
    """The first 12 hex digits of a text's SHA-1 as a number, modulo buckets."""
    return F.conv(F.left(F.sha1(F.coalesce(text, F.lit(""))), F.lit(12)), 16, 10).cast("long") % buckets


def bytes_digest(data: Column) -> Column:
    return F.sha1(F.coalesce(data, F.lit(b"")))


def overlaid_zeros(data: Column, spans: list[tuple[int, int]]) -> Column:
    """data with zero bytes at each (offset, length) that lies inside it."""
    out = data
    for offset, size in spans:
        out = F.when(F.length(data) >= offset + size, F.overlay(out, F.lit(bytes(size)), F.lit(offset + 1), F.lit(size))).otherwise(out)
    return out


def trimmed_payload_length(values: Column) -> Column:
    """Length of an array of byte values after its trailing zeros are dropped."""
    places = F.transform(values, lambda v, i: F.when(v != 0, i + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0))


def log_features(names: list[str]) -> Column:
    """log(1 + x) of the named columns, nulls as 0."""
    return F.array(*[F.log1p(F.coalesce(F.col(n), F.lit(0)).cast("double")) for n in names])


def packet_chunks(data: Column, lengths: Column) -> Column:
    """data cut into pieces of the given lengths; an error if they don't add up to its length."""
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda a, n: F.array_append(a, F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + n))
    pieces = F.zip_with(ends, lengths, lambda end, n: F.substring(data, end - n + 1, n))
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    return F.when(total == F.length(data), pieces).otherwise(F.raise_error(F.lit("packet lengths don't add up to the bytes")).cast("array<binary>"))


def view_bytes(view: Column, payload: Column, full: Column, masked: Column) -> Column:
    """The byte view that a view's name asks for."""
    return F.when(view == "payload_only", payload).when(view == "full_packet", full).when(view == "masked_header_packet", masked)


def normalized_name(name: str) -> str:
    """A column's name trimmed, in lower case, with blanks, slashes and hyphens as underscores."""
    return name.strip().lower().translate(str.maketrans(" /-", "___"))
