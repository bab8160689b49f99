"""Log time stamps to epoch milliseconds in plain Python, for the Arrow-batched parsers."""

from __future__ import annotations

import re
from datetime import date, datetime, timezone
from functools import lru_cache

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?\s?(Z|[+-]\d\d:?\d\d)?")
CLF = re.compile(r"(\d\d)/([A-Za-z]{3})/(\d{4}):(\d\d):(\d\d):(\d\d) ([+-]\d{4})")
EPOCH = re.compile(r"\d{9,10}(?:\.\d+)?|\d{12,13}")
_DAY0 = date(1970, 1, 1).toordinal()


@lru_cache(maxsize=4096)
def _day_ms(y: int, m: int, d: int) -> int:
    return (date(y, m, d).toordinal() - _DAY0) * 86_400_000


def _zone_ms(z: str | None) -> int:
    if not z or z == "Z":
        return 0
    sign = -1 if z[0] == "-" else 1
    return sign * (int(z[1:3]) * 60 + int(z[-2:])) * 60_000


def _clock(h: str, m: str, s: str) -> int:
    if int(h) > 23 or int(m) > 59 or int(s) > 59:
        raise ValueError("no such time")
    return ((int(h) * 60 + int(m)) * 60 + int(s)) * 1000


def epoch_ms(value) -> int | None:
    """Milliseconds of an ISO, access-log or epoch time; no zone means UTC; None if it is none."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value * 1000) if abs(value) < 10**11 else int(value)
    v = value.strip()
    try:
        if m := ISO.fullmatch(v):
            y, mo, d, h, mi, s, f, z = m.groups()
            frac = int((f or "")[:3].ljust(3, "0")) if f else 0
            return _day_ms(int(y), int(mo), int(d)) + _clock(h, mi, s) + frac - _zone_ms(z)
        if m := CLF.fullmatch(v):
            d, mon, y, h, mi, s, z = m.groups()
            return _day_ms(int(y), MONTHS[mon.lower()], int(d)) + _clock(h, mi, s) - _zone_ms(z)
        if EPOCH.fullmatch(v):
            n = float(v) if "." in v else int(v)
            return int(n * 1000) if n < 10**11 else int(n)
    except (ValueError, KeyError):
        return None
    return None


def to_datetime(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, tz=timezone.utc)
