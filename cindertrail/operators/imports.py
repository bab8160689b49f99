"""Rows that fail to parse, set apart with the reason while the valid rows are loaded.

Blocks of records are parsed on a fast columnar path (Arrow kernels over whole columns,
accepting only what is certainly valid). A block with a record it refuses is bisected, again
and again, until the refused records stand alone; these are diagnosed strictly, one by one,
in the order of REASONS. Kernels judge every record of a block they can read, so its halves
aren't parsed anew; a block that can't be read (broken JSON) is split and its parts are read
again. A record the fast path refuses but the strict reading accepts is loaded like any other.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fields of the delimited formats in order, the levels, the methods and the reasons.
FIELDS = ("timestamp", "level", "service", "ipAddress", "httpMethod", "endpoint", "statusCode", "responseTime", "requestId", "userId", "message")
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
REASONS = ("format", "json", "quoting", "columns", "timestamp", "level", "method", "status", "latency", "message")
MAX_LONG = 2**63 - 1

STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?Z", re.ASCII)
WHOLE = re.compile(r"[+-]?\d+", re.ASCII)
CSV_FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'
CSV_RECORD = "(?s)^" + ",".join(f"(?P<f{i}>{CSV_FIELD})" for i in range(len(FIELDS))) + "$"

LOADED = pa.schema(
    [
        ("row_id", pa.int64()), ("batch", pa.string()), ("row_no", pa.int64()), ("reason", pa.string()),
        ("ts", pa.timestamp("us", tz="UTC")), ("level", pa.string()), ("service", pa.string()), ("ip", pa.string()),
        ("http_method", pa.string()), ("endpoint", pa.string()), ("status", pa.int32()), ("response_ms", pa.int64()),
        ("request_id", pa.string()), ("user_id", pa.string()), ("message", pa.string()), ("attributes", pa.string()),
    ]
)
DDL = (
    "row_id long, batch string, row_no long, reason string, ts timestamp, level string, service string, ip string, http_method string, "
    "endpoint string, status int, response_ms long, request_id string, user_id string, message string, attributes string"
)
VALUES = LOADED.names[4:]
#: Times the kernels vouch for: any day but 29 February, years from 1000.
PLAIN_STAMP = (
    r"^[1-9]\d{3}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
    r"T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?Z$"
)
#: A number of a JSON record that isn't written as a whole number.
NO_INTEGER = r'"(?:statusCode|responseTime)"\s*:\s*(?:["\[{tf]|-?\d+[.eE]|-?\d{19})'
AT_ROW = re.compile(r"in row (\d+)$")


class Refused(Exception):
    """The columnar reader can't read the block; ``at``: the record it stopped at, if it says so."""

    def __init__(self, at: int | None = None):
        super().__init__(at)
        self.at = at


def stamp_us(value) -> int | None:
    """Epoch microseconds of yyyy-MM-ddTHH:mm:ss[.fraction]Z if such an instant exists."""
    m = STAMP.fullmatch(value) if isinstance(value, str) else None
    if not m:
        return None
    y, mo, d, h, mi, s, frac = m.groups()
    try:
        at = datetime(int(y), int(mo), int(d), int(h), int(mi), int(s), tzinfo=timezone.utc)
    except ValueError:
        return None
    whole = int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000
    return whole + int((frac or "")[:6].ljust(6, "0") or 0)


def split_csv(record: str) -> list[str] | None:
    """Fields of a record by the strict quoting rules; None if its quoting is broken."""
    fields, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            i += 1
            part = []
            while True:
                j = record.find('"', i)
                if j < 0:
                    return None
                part.append(record[i:j])
                if record[j + 1 : j + 2] == '"':
                    part.append('"')
                    i = j + 2
                else:
                    i = j + 1
                    break
            if i < n and record[i] != ",":
                return None
            fields.append("".join(part))
        else:
            j = record.find(",", i)
            j = n if j < 0 else j
            if '"' in record[i:j]:
                return None
            fields.append(record[i:j])
            i = j
        if i >= n:
            return fields
        i += 1
        if i == n:
            fields.append("")
            return fields


def _number(value, text: bool) -> int | None:
    if text:
        return int(value) if isinstance(value, str) and WHOLE.fullmatch(value) and len(value) < 40 else None
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _plain(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return "" if isinstance(value, (dict, list)) else json.dumps(value)


def _object(record: str) -> dict | None:
    """The one JSON object of a record; None if it is anything else."""
    try:
        o = json.loads(record, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def _others(o: dict) -> str | None:
    """The members beyond the known fields as JSON text."""
    rest = {k: v for k, v in o.items() if k not in FIELDS}
    return json.dumps(rest, sort_keys=True, ensure_ascii=False) if rest else None


def diagnose(record: str, kind: str) -> tuple[str | None, tuple | None]:
    """(reason, None) or (None, values of a loaded row) of one record, strictly."""
    record = record.strip()
    delimited = kind != "jsonl"
    extra = None
    if kind == "jsonl":
        o = _object(record)
        if o is None:
            return "json", None
        f = {k: o.get(k) for k in FIELDS}
        extra = _others(o)
    else:
        parts = split_csv(record) if kind == "csv" else record.split(" | ")
        if parts is None:
            return "quoting", None
        if len(parts) != len(FIELDS):
            return "columns", None
        f = dict(zip(FIELDS, parts))
    ts = stamp_us(f["timestamp"])
    if ts is None:
        return "timestamp", None
    level = _plain(f["level"])
    if delimited or level is not None:
        level = level.strip().upper()
        if level not in LEVELS:
            return "level", None
    method = _plain(f["httpMethod"])
    if delimited or method is not None:
        method = method.strip().upper()
        if method not in METHODS:
            return "method", None
    status = 0 if not delimited and f["statusCode"] is None else _number(f["statusCode"], delimited)
    if status is None or not (status == 0 or 100 <= status <= 599):
        return "status", None
    latency = 0 if not delimited and f["responseTime"] is None else _number(f["responseTime"], delimited)
    if latency is None or not 0 <= latency <= MAX_LONG:
        return "latency", None
    message = _plain(f["message"])
    if message is None or not message.strip():
        return "message", None
    user = _plain(f["userId"])
    return None, (
        ts, level, _plain(f["service"]), _plain(f["ipAddress"]), method, _plain(f["endpoint"]), status, latency,
        _plain(f["requestId"]), None if user == "-" else user, message, extra,
    )


def _sure(mask) -> np.ndarray:
    """A kernel's verdict on each record; null is no."""
    return pc.fill_null(mask, False).to_numpy(zero_copy_only=False)


def _fields(records: pa.Array, kind: str) -> tuple[np.ndarray, dict[str, pa.Array], pa.Array | None]:
    """(places of the records with the right shape, their fields, their further members); Refused if one can't be read."""
    if kind == "txt":
        parts = pc.split_pattern(records, " | ")
        at = np.flatnonzero(_sure(pc.equal(pc.list_value_length(parts), len(FIELDS))))
        parts = parts.take(pa.array(at))
        return at, {name: pc.list_element(parts, i) for i, name in enumerate(FIELDS)}, None
    if kind == "csv":
        found = pc.extract_regex(records, CSV_RECORD)
        at = np.flatnonzero(_sure(found.is_valid()))
        found = found.take(pa.array(at))
        out = {}
        for i, name in enumerate(FIELDS):
            col = pc.struct_field(found, i)
            quoted = pc.starts_with(col, '"')
            if pc.any(quoted, min_count=0).as_py():
                bare = pc.replace_substring(pc.utf8_slice_codeunits(col, 1, -1), '""', '"')
                col = pc.if_else(quoted, bare, col)
            out[name] = col
        return at, out, None
    whole = pc.and_(pc.starts_with(records, "{"), pc.ends_with(records, "}"))
    odd = pc.or_(pc.match_substring_regex(records, r"[\x00-\x1f]"), pc.match_substring_regex(records, NO_INTEGER))
    at = np.flatnonzero(_sure(pc.and_not(whole, odd)))
    records = records.take(pa.array(at))
    schema = pa.schema([(n, pa.int64() if n in ("statusCode", "responseTime") else pa.string()) for n in FIELDS])
    if not len(at):
        return at, {n: pa.array([], schema.field(n).type) for n in FIELDS}, None
    try:
        got = pj.read_json(
            io.BytesIO("\n".join(records.to_pylist()).encode()),
            read_options=pj.ReadOptions(use_threads=False),
            parse_options=pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="infer"),
        )
    except pa.ArrowInvalid as e:
        row = AT_ROW.search(str(e))
        raise Refused(int(at[int(row[1])]) if row and int(row[1]) < len(at) else None) from e
    if got.num_rows != len(records):
        raise Refused
    got = got.combine_chunks()
    others = [c for c in got.column_names if c not in FIELDS]
    extra = None
    if others:
        table = got.select(others)
        plain = all(pa.types.is_int64(c.type) or pa.types.is_boolean(c.type) for c in table.columns)
        null = pc.match_substring(records, "null").to_pylist()  # a null member and an absent one look alike in columns
        texts = []
        for i, (r, record, doubtful) in enumerate(zip(table.to_pylist(), records.to_pylist(), null)):
            if plain and not doubtful:
                kept = {k: v for k, v in r.items() if v is not None}
                texts.append(json.dumps(kept, sort_keys=True, ensure_ascii=False) if kept else None)
            else:  # as written: inferred types and merged structs aren't
                o = _object(record)
                if o is None:
                    raise Refused(int(at[i]))
                texts.append(_others(o))
        extra = pa.array(texts, pa.string())
    return at, {n: got[n].chunk(0) for n in FIELDS}, extra


def survey(records: pa.Array, kind: str) -> tuple[np.ndarray, list[pa.Array]]:
    """(places of the records that are certainly valid, their loaded columns) of a trimmed block, or Refused."""
    at, f, extra = _fields(records, kind)
    delimited = kind != "jsonl"
    fine = _sure(pc.match_substring_regex(f["timestamp"], PLAIN_STAMP))
    level, method = (pc.utf8_upper(pc.utf8_trim_whitespace(f[n])) for n in ("level", "httpMethod"))
    for col, allowed in ((level, LEVELS), (method, METHODS)):
        known = pc.is_in(col, value_set=pa.array(allowed))
        fine &= _sure(known if delimited else pc.or_(known, pc.is_null(col)))
    status, latency = f["statusCode"], f["responseTime"]
    if delimited:
        fine &= _sure(pc.match_substring_regex(status, r"^\d{1,3}$")) & _sure(pc.match_substring_regex(latency, r"^\d{1,18}$"))
    fine &= _sure(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(f["message"])), 0))
    keep = pa.array(np.flatnonzero(fine))
    at, f, level, method = at[fine], {n: c.take(keep) for n, c in f.items()}, level.take(keep), method.take(keep)
    extra = pa.nulls(len(at), pa.string()) if extra is None else extra.take(keep)
    status, latency = (pc.cast(f[n], pa.int64()) if delimited else pc.fill_null(f[n], 0) for n in ("statusCode", "responseTime"))
    numbers = pc.or_(pc.equal(status, 0), pc.and_(pc.greater_equal(status, 100), pc.less_equal(status, 599)))
    numbers = _sure(pc.and_(numbers, pc.greater_equal(latency, 0)))
    user = pc.if_else(pc.fill_null(pc.equal(f["userId"], "-"), False), pa.scalar(None, pa.string()), f["userId"])
    cols = [
        pc.cast(f["timestamp"], pa.timestamp("us", tz="UTC")), level, f["service"], f["ipAddress"], method, f["endpoint"],
        pc.cast(pc.if_else(pa.array(numbers), status, 0), pa.int32()), latency, f["requestId"], user, f["message"], extra,
    ]
    if not numbers.all():
        keep = pa.array(np.flatnonzero(numbers))
        at, cols = at[numbers], [c.take(keep) for c in cols]
    return at, cols


def _strict(records: list[str], kind: str) -> tuple[pa.Array, list[pa.Array]]:
    reasons, rows = [], []
    for r in records:
        reason, values = diagnose(r, kind)
        reasons.append(reason)
        rows.append(values or (None,) * len(VALUES))
    cols = []
    for name, col in zip(VALUES, zip(*rows) if rows else [()] * len(VALUES)):
        if name == "ts":
            cols.append(pa.array(col, pa.int64()).cast(pa.timestamp("us")).cast(pa.timestamp("us", tz="UTC")))
        else:
            cols.append(pa.array(col, LOADED.field(name).type))
    return pa.array(reasons, pa.string()), cols


def isolate(upto: np.ndarray, lo: int, hi: int) -> Iterator[int]:
    """The refused records in [lo, hi) by bisection; ``upto[i]`` refused records stand before record i."""
    if upto[hi] == upto[lo]:
        return
    if hi - lo == 1:
        yield lo
        return
    half = (lo + hi) // 2
    yield from isolate(upto, lo, half)
    yield from isolate(upto, half, hi)


def parse_block(records: pa.Array, kind: str) -> list[tuple[np.ndarray, pa.Array, list[pa.Array]]]:
    """(places, reasons, columns) pieces of a block, in any order; every record is in one of them.

    A block the columnar reader can't read is split at the record it stopped at, or halved, and
    its parts are read again. A block it can read is bisected on the kernels' verdicts. Either
    way single records remain, and these alone are diagnosed.
    """
    trimmed = pc.utf8_trim_whitespace(records)
    out, alone = [], []
    todo = [(0, len(records))]
    while todo:
        lo, hi = todo.pop()
        if hi == lo:
            continue
        try:
            at, cols = survey(trimmed.slice(lo, hi - lo), kind)
        except Refused as e:
            if e.at is None and hi - lo > 1:
                half = (lo + hi) // 2
                todo += [(lo, half), (half, hi)]
            else:
                cut = lo + (e.at or 0)
                alone.append(cut)
                todo += [(lo, cut), (cut + 1, hi)]
            continue
        out.append((at + lo, pa.nulls(len(at), pa.string()), cols))
        refused = np.ones(hi - lo, dtype=np.int64)
        refused[at] = 0
        alone += [lo + i for i in isolate(np.concatenate(([0], np.cumsum(refused))), 0, hi - lo)]
    if alone:
        out.append((np.array(alone), *_strict(records.take(pa.array(alone, pa.int64())).to_pylist(), kind)))
    return out


def load_rows(rows: DataFrame, block: int = 2048) -> DataFrame:
    """All rows with ``reason`` (null: loaded) and the fields of a log event.

    The suffix of ``batch`` names the format; other suffixes and null batches are rejected
    as ``format``. A null record is an empty one. Attributes of JSON records beyond the
    known fields are kept as JSON text. Extra columns are ignored; rows are never dropped.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = pc.fill_null(b.column("batch"), "")
            raw = pc.fill_null(b.column("raw_message"), "")
            kinds = {k: pc.ends_with(names, f".{k}") for k in ("txt", "csv", "jsonl")}
            none = pc.invert(pc.or_(pc.or_(kinds["txt"], kinds["csv"]), kinds["jsonl"]))
            for kind, mask in [*kinds.items(), ("", none)]:
                at = pc.indices_nonzero(mask)
                for lo in range(0, len(at), block):
                    take = at.slice(lo, block)
                    if kind:
                        pieces = parse_block(raw.take(take), kind)
                    else:
                        blank = [pa.nulls(len(take), LOADED.field(n).type) for n in VALUES]
                        pieces = [(np.arange(len(take)), pa.array(["format"] * len(take), pa.string()), blank)]
                    for places, reason, values in pieces:
                        rows_at = take.take(pa.array(places))
                        head = [b.column(c).take(rows_at).cast(LOADED.field(c).type) for c in ("row_id", "batch", "row_no")]
                        cols = [_flat(v).cast(LOADED.field(n).type) for n, v in zip(VALUES, values)]
                        yield pa.RecordBatch.from_arrays([*head, reason, *cols], schema=LOADED)

    return rows.select("row_id", "batch", "row_no", "raw_message").mapInArrow(read, DDL)


def _flat(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("row_id", "batch", "row_no", "reason")


def reject_report(parsed: DataFrame) -> DataFrame:
    """batch, rows, rejected, and the share rejected per batch."""
    bad = F.count_if(F.col("reason").isNotNull())
    return parsed.groupBy("batch").agg(F.count("*").alias("rows"), bad.alias("rejected"), (bad / F.count("*")).alias("reject_share"))
