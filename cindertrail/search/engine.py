"""Search, paging, typeahead and did-you-mean over log events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindertrail.functions.logcols import overlapping_count, searchable_text, similarity_pct, snippet
from cindertrail.search.query import Query, ordering, parse, predicate

MAX_PAGE = 200


def search(events: DataFrame, query: str | Query | None) -> DataFrame:
    """All matching rows with ``matches`` (overlapping hits of the phrase) and ``snippet``."""
    q = query if isinstance(query, Query) else parse(query)
    text = searchable_text()
    hits = overlapping_count(F.lower(text), q.phrase.lower()) if q.phrase else F.lit(0)
    return events.where(predicate(q)).withColumns({"matches": hits.cast("int"), "snippet": snippet(text, q.phrase)})


def page(events: DataFrame, query: str | Query | None, number: int = 1, size: int = 50) -> DataFrame:
    """One 1-based page of at most 200 rows; empty past the end."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError("page from 1, size from 1 to 200")
    q = query if isinstance(query, Query) else parse(query)
    return search(events, q).orderBy(*ordering(q)).offset((number - 1) * size).limit(size)


def total(events: DataFrame, query: str | Query | None) -> DataFrame:
    """One row: matching rows and phrase hits."""
    return search(events, query).agg(F.count("*").alias("rows"), F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("hits"))


def events_slice(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit from 1 to 1000, offset from 0")
    return events.orderBy("id").offset(offset).limit(limit)


def event_by_id(events: DataFrame, id_: int) -> DataFrame:
    return events.where(F.col("id") == id_)


def suggest(events: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """kind, value of levels, statuses, services, hosts, sources and endpoints that contain the text."""
    limit = max(1, min(50, limit))
    kinds = ["level", "status", "service", "host", "source", "endpoint"]
    cells = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("kind"), (F.nullif(F.col(k), F.lit(0)) if k == "status" else F.col(k)).cast("string").alias("value")) for i, k in enumerate(kinds)])
    flat = events.select("id", F.explode(cells).alias("c")).select("id", "c.*").where(F.contains(F.lower("value"), F.lit(text.lower())))
    return flat.groupBy("ord", "kind", "value").agg(F.min("id").alias("first_id")).orderBy("ord", "first_id", "value").limit(limit).select("kind", "value")


def did_you_mean(events: DataFrame, text: str, share: float = 0.35, least: int = 2) -> DataFrame:
    """The message nearest to ``text`` if within max(2, ceil(.35 longest)) edits: message, distance, similarity."""
    m = events.where("message is not null").groupBy("message").agg(F.min("id").alias("first_id"))
    longest = F.greatest(F.length("message"), F.lit(len(text)))
    near = m.where(F.abs(F.length("message") - len(text)) <= F.greatest(F.lit(least), F.ceil(longest * share)))
    near = near.withColumn("distance", F.levenshtein(F.col("message"), F.lit(text)))
    near = near.where(F.col("distance") <= F.greatest(F.lit(least), F.ceil(longest * share)))
    best = near.orderBy("distance", "first_id").limit(1)
    return best.select("message", "distance", similarity_pct(F.col("distance"), longest).alias("similarity"))


def fuzzy_lines(lines: DataFrame, text: str, max_distance: int = 2, column: str = "message", key: str = "id") -> DataFrame:
    """key, line, distance of whole lines within ``max_distance`` edits; lengths are compared first."""
    line = F.col(column)
    near = lines.where(F.abs(F.length(line) - len(text)) <= max_distance)
    return near.select(key, line.alias("line"), F.levenshtein(line, F.lit(text), max_distance).alias("distance")).where("distance >= 0")


def token_search(events: DataFrame, tokens: list[str]) -> DataFrame:
    """Rows that hold all tokens (of two or more characters) of service, endpoint or searchable text."""
    text = F.lower(F.concat_ws("$", F.coalesce("service", F.lit("")), F.coalesce("endpoint", F.lit("")), searchable_text()))
    found = F.filter(F.split(text, r"[ $/:{}|.@_\-]+"), lambda t: F.length(t) >= 2)
    cond = F.lit(True)
    for t in tokens:
        cond = cond & F.array_contains(found, t.lower())
    return events.where(cond)
