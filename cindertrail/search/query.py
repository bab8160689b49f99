"""A small field-and-phrase query language, turned into column predicates.

``level:ERROR level:WARN service:billing "timed out"``: tokens are separated by white space
outside double quotes; known fields filter, everything else is one phrase.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cindertrail.functions.logcols import LEVELS, level_ord, searchable_text, ts_ms

#: Field of the language and the column it filters exactly.
EXACT = {"service": "service", "host": "host", "source": "source", "status": "status", "trace": "trace_id", "request": "request_id"}
SORTS = ("timestamp", "level", "service", "id")


@dataclass
class Query:
    phrase: str = ""
    levels: list[str] = field(default_factory=list)
    exact: dict[str, str] = field(default_factory=dict)
    from_ms: int | None = None
    to_ms: int | None = None
    sort: str = "timestamp"
    ascending: bool = False


def split_tokens(raw: str) -> list[str]:
    tokens, now, quoted, seen = [], [], False, False
    for ch in raw:
        if ch == '"':
            quoted, seen = not quoted, True
        elif ch.isspace() and not quoted:
            if now or seen:
                tokens.append("".join(now))
            now, seen = [], False
        else:
            now.append(ch)
    if now or seen:
        tokens.append("".join(now))
    return tokens


def parse(raw: str | None, from_ms: int | None = None, to_ms: int | None = None, sort: str | None = None) -> Query:
    """Field names are case-sensitive; ``level`` accumulates, of other fields the last counts;
    an empty value is an error; an unknown ``x:y`` belongs to the phrase."""
    if from_ms is not None and to_ms is not None and from_ms > to_ms:
        raise ValueError("from is after to")
    q = Query(from_ms=from_ms, to_ms=to_ms)
    phrase: list[str] = []
    for token in split_tokens(raw or ""):
        name, colon, value = token.partition(":")
        if colon and name in (*EXACT, "level", "message"):
            if not value.strip():
                raise ValueError(f"{name} needs a value")
            if name == "level":
                q.levels.append(value)
            elif name == "message":
                phrase.append(value)
            else:
                q.exact[name] = value
        elif token:
            phrase.append(token)
    q.phrase = " ".join(phrase)
    if sort:
        key, _, way = sort.partition(":")
        q.sort, q.ascending = (key if key in SORTS else "timestamp"), way == "asc"
    return q


def predicate(q: Query) -> Column:
    """Cheap structured predicates first, the text last."""
    cond = F.lit(True)
    if q.levels:
        cond = cond & F.col("level").isin(*[v.upper() for v in q.levels if v.upper() in LEVELS] or [""])  # stored in upper case
    for name, value in q.exact.items():
        col = F.col(EXACT[name])
        if name == "status":
            number = int(value) if value.isdigit() and str(int(value)) == value and int(value) else None
            cond = cond & (col == number if number is not None else F.lit(False))
        else:
            cond = cond & (col == value)
    if q.from_ms is not None:
        cond = cond & (F.col("ts") >= F.timestamp_millis(F.lit(q.from_ms)))
    if q.to_ms is not None:
        cond = cond & (F.col("ts") < F.timestamp_millis(F.lit(q.to_ms)))
    if q.phrase:
        cond = cond & F.contains(F.lower(searchable_text()), F.lit(q.phrase.lower()))
    return cond


def ordering(q: Query) -> list[Column]:
    """The requested sort; ties in ascending order of id both ways."""
    key = {"timestamp": ts_ms(), "level": level_ord(F.col("level")), "service": F.coalesce("service", F.lit("")), "id": F.col("id")}[q.sort]
    return [key.asc() if q.ascending else key.desc(), F.col("id").asc()]
