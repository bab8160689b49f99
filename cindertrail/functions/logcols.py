"""Scalar column functions over log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrail.operators.parallel import scan

#: Levels in order with their severity numbers.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
SEVERITY_NUMBERS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
ERROR_LEVELS = ("ERROR", "FATAL")


def ts_ms(ts: Column | None = None) -> Column:
    """Epoch milliseconds; all bucket arithmetic is done on these."""
    return F.unix_millis((F.col("ts") if ts is None else ts).cast("timestamp"))


def in_ms(from_ms: Column | int, to_ms: Column | int | None = None, closed: bool = False) -> Column:
    """ts in [from, to) or, if ``closed``, [from, to] by whole milliseconds, as bounds on ``ts`` a scan can use."""
    at = lambda v: F.timestamp_millis(v if isinstance(v, Column) else F.lit(v))
    cond = F.col("ts") >= at(from_ms)
    if to_ms is not None:
        cond = cond & (F.col("ts") < at(to_ms + 1 if closed else to_ms))
    return cond


def level_ord(level: Column) -> Column:
    out = F.lit(-1)
    for i, name in enumerate(LEVELS):
        out = F.when(F.upper(level) == name, i).otherwise(out)
    return out


def severity_number(level: Column) -> Column:
    out = F.lit(0)
    for name, n in SEVERITY_NUMBERS.items():
        out = F.when(F.upper(level) == name, n).otherwise(out)
    return out


def is_error(level: Column) -> Column:
    return F.coalesce(level.isin(*ERROR_LEVELS), F.lit(False))


def searchable_text() -> Column:
    """``LEVEL service endpoint message`` with nulls as empty text, separators kept."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("level", "service", "endpoint", "message")]
    return F.concat(*[x for p in parts for x in (p, F.lit(" "))][:-1])


def render_dataset(events: DataFrame) -> DataFrame:
    """id, start, line: the events as one text, a searchable line each and line ends between, as rows.

    ``start`` is the offset of the line in the text, so that a place in it is found again by the
    last start at or before it; the text itself is never put together.
    """
    lines = events.select("id", searchable_text().alias("line")).withColumn("width", F.length("line") + 1)
    return scan(lines, ["id"], "width", inclusive=False).select("id", F.col("scan").alias("start"), "line")


def normalize_message(message: Column) -> Column:
    """Template of a message: tokens that vary become <*>, other tokens keep letters, digits, . _ -.

    A token varies if it holds a digit or one of # { } $, or has 8 or more characters that
    are all hexadecimal or dashes (fixed values: these classes and lengths).
    """
    tokens = F.split(F.trim(F.regexp_replace(message, r"\s+", " ")), " ")

    def one(t: Column) -> Column:
        varies = t.rlike(r"[\p{Nd}#{}$]") | ((F.length(t) >= 8) & t.rlike(r"^[0-9a-fA-F-]+$"))
        return F.when(varies, F.lit("<*>")).otherwise(F.regexp_replace(t, r"[^\p{L}\p{N}._-]", ""))

    return F.array_join(F.filter(F.transform(tokens, one), lambda t: t != ""), " ")


def quote_regex(text: str) -> str:
    """A Java regular expression that matches ``text`` literally."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def overlapping_count(text: Column, pattern: str) -> Column:
    """Occurrences of ``pattern`` in ``text``, overlaps counted."""
    if not pattern:
        return F.lit(0)
    return F.regexp_count(text, F.lit(f"(?={quote_regex(pattern)})"))


def match_positions(text: Column, pattern: str) -> Column:
    """0-based starts of every occurrence, overlaps included, as an array."""
    m = len(pattern)
    starts = F.when(F.length(text) >= m, F.sequence(F.lit(1), F.length(text) - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, lambda i: F.substring(text, i, F.lit(m)) == pattern), lambda i: i - 1)


def snippet(text: Column, pattern: str, before: int = 30, after: int = 40, width: int = 140) -> Column:
    """The first hit (any case) with its surroundings, dots where cut; without a hit the start of the text."""
    at = F.locate(pattern.lower(), F.lower(text)) if pattern else F.lit(0)
    start = F.greatest(F.lit(1), at - before)
    stop = F.least(F.length(text), at + len(pattern) - 1 + after)
    hit = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, stop - start + 1), F.when(stop < F.length(text), "…").otherwise(""))
    return F.when(at > 0, hit).otherwise(F.trim(F.substring(F.trim(text), 1, width)))


def similarity_pct(distance: Column, longest: Column) -> Column:
    """round(100 (1 - distance / longest)), within 0..100; 100 for two empty texts."""
    pct = F.round(F.lit(100.0) * (F.lit(1.0) - distance / F.nullif(longest, F.lit(0)))).cast("int")
    return F.when(longest == 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), pct)))


def health_state(error_pct: Column, latency: Column, baseline: Column) -> Column:
    return (
        F.when((error_pct >= 8) | (latency >= 4 * baseline), "critical")
        .when((error_pct >= 3) | (latency >= 2 * baseline), "degraded")
        .otherwise("healthy")
    )


def error_band(share: Column) -> Column:
    """Band of a tick's share of errors."""
    return F.when(share >= 0.1, "elevated").when(share >= 0.02, "watch").otherwise("normal")


def polynomial_hash(text: Column, base: int = 911382323, mod: int = 1_000_000_007) -> Column:
    """Rolling hash of the code points of a text, in exact arithmetic."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda h, c: F.pmod((h * F.lit(base) + F.ascii(c)).cast("decimal(38,0)"), F.lit(mod)).cast("decimal(20,0)")
    return F.aggregate(chars, F.lit(0).cast("decimal(20,0)"), step).cast("long")


def universal_hash(key: Column, a: int, b: int, m: int) -> Column:
    """((a key + b) mod 2^61 - 1) mod m without overflow."""
    return universal_hash_columns(key, F.lit(a), F.lit(b), F.lit(m))


def universal_hash_columns(key: Column, a: Column, b: Column, m: Column) -> Column:
    """The same with a member of the family per row; null where m is 0."""
    p = F.lit(2**61 - 1).cast("decimal(20,0)")
    x = F.pmod(key.cast("decimal(19,0)"), p).cast("decimal(19,0)")
    return F.pmod(F.pmod((x * a.cast("decimal(19,0)") + b.cast("decimal(19,0)")).cast("decimal(38,0)"), p), F.nullif(m.cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))).cast("long")
