"""Log lines of unknown programs as entries with time, level, component and message.

A fixed-depth template tree learns the layouts. Lines are split into tokens with their
variables masked (times, levels, addresses, numbers, quoted text), routed by token count
and the kinds of their leading tokens, and merged with the most similar template of their
leaf; positions that differ become variables. Trees are grown per task and merged in levels.

The templates then decide where the fields are. A line's *core* is what surely is header: its
time, its level, bracketed groups and the words between them. What follows is settled by all
templates of a core together, each weighed by its lines: a sign that stands at one place after
the core ends the header (``name - text``, ``name: text``, ``name] text``), a word that varies
while the words behind it stay is a component, the usual number of separators tells the last
field of separated lines. Key=value lines are read by their keys. A line of an unknown core is
settled by itself, so that no bound drops anything.

Entries may span lines. Line to entry is a running maximum of opening line numbers, taken
in two levels (within blocks of a stream, then over its blocks), so that one stream with a
third of all rows is no single task. A JSON object printed over several lines is an entry
if its text has a time and a message at top level.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.functions.logcols import SEVERITY_NUMBERS as SEVERITY
from cindertrail.functions.timestamps import epoch_ms
from cindertrail.session import materialise

#: Spellings of the six levels.
LEVEL_WORDS = {
    "TRACE": ("trace", "trc", "finest"),
    "DEBUG": ("debug", "dbg"),
    "INFO": ("info", "inf", "information"),
    "WARN": ("warn", "wrn", "warning"),
    "ERROR": ("error", "err", "severe"),
    "FATAL": ("fatal", "ftl", "critical", "crit"),
}
LEVEL_OF = {w: lvl for lvl, words in LEVEL_WORDS.items() for w in words}
LETTERS = {lvl[0]: lvl for lvl in LEVEL_WORDS}

TIME_KEYS = ("timestamp", "ts", "time", "@timestamp", "datetime")
LEVEL_KEYS = ("level", "lvl", "severity", "severityNumber", "loglevel")
COMPONENT_KEYS = ("service", "component", "app", "logger", "source")
MESSAGE_KEYS = ("message", "msg")

KEYS = frozenset((*TIME_KEYS, *LEVEL_KEYS, *COMPONENT_KEYS, *MESSAGE_KEYS))
#: Masked tokens a layout is told by; templates never merge them with others.
LAYOUT = frozenset({"<TS>", "<LVL>", "[", "]", "|", "\t", "-", ":", "=", *KEYS})

ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
TIMES = (
    r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?(?![\w])"
    r"|\d\d/[A-Za-z]{3}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}"
    r"|(?<!\S)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d(?!\S)"
    r"|^\d{10}(?:\.\d{1,9})?(?=\s)"
    r"|(?<![\w.])\d{13}(?![\w.])"
)
QUOTED = r'"(?:[^"\\]|\\.)*"'
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])"
SIGNS = r"\[\]|:=\"(){},"
TOKEN = re.compile(
    rf"(?P<TS>{TIMES})|(?P<QUOTED>{QUOTED})|(?P<IP>{ADDRESS})|(?P<WORD>[^\s{SIGNS}]+)|(?P<TAB>\t)|(?P<INNER>:(?=\S)|\|(?! ))|(?P<PUNCT>[{SIGNS}])"
)
#: The same tokens without their kinds, a colon or bar with the blank behind it; and what tells the kinds of single pieces.
PIECE = re.compile(rf"{TIMES}|{QUOTED}|{ADDRESS}|[^\s{SIGNS}]+|\t|[:|] ?|[{SIGNS}]")
IS_ADDRESS = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
EPOCH_FIRST = re.compile(r"\d{10}(?:\.\d{1,9})?(?=\s)")
HAS_DIGIT = re.compile(r"\d")
DEPTH, MAX_TEMPLATES, SIMILAR = 3, 4000, 0.6
#: Tokens in which a core ends, words between a core and the sign that ends the header, and layouts told to the tasks.
CORE, WORDS, MAX_LAYOUTS = 16, 3, 10_000
#: Separators of the log format of imports, and the fewest that hold time, level, component and message; each counts as one line more.
USUAL = {"|": 10, "\t": 3}
#: What it takes to let a sign end the header of lines whose core names a component already.
SURE_SHARE, SURE_LINES = 0.9, 20
#: Share of a core's lines that makes a second sign the end of a header.
GOOD_SHARE = 0.25


def level_of(value) -> str | None:
    """TRACE..FATAL of a word, letter, abbreviation or severity number."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return next((lvl for lvl, n in SEVERITY.items() if n <= value <= n + 3), None)
    v = ANSI.sub("", str(value)).strip()
    if v.isdigit():
        return level_of(int(v))
    return LEVEL_OF.get(v.lower()) or LETTERS.get(v if len(v) == 1 else "")


def tokenize(line: str, head: int | None = None) -> tuple[list[str], list[tuple[int, int]]]:
    """Masked tokens of a line and their spans; of a line that isn't key=value only the first ``head``."""
    masked, spans = [], []
    for m in TOKEN.finditer(line):
        if len(masked) == head and masked[1:2] != ["="]:
            break
        kind, tok = m.lastgroup, m.group()
        if kind == "WORD":
            if tok.lower() in LEVEL_OF or (len(tok) == 1 and tok in LETTERS and m.start() == 0):
                tok = "<LVL>"
            elif HAS_DIGIT.search(tok):
                tok = "<NUM>"
        elif kind in ("TS", "QUOTED", "IP", "INNER"):
            tok = f"<{kind}>"
        masked.append(tok)
        spans.append(m.span())
    return masked, spans


class Masks(dict):
    """Pieces of a line to masked tokens; words without digits are remembered. Emptied when it grows large."""

    def __missing__(self, piece: str) -> str:
        if len(piece) > 2 and piece[0] == '"':
            return "<QUOTED>"
        if len(piece) > 2 and ":" in piece or len(piece) == 13 and piece.isdigit():
            return "<TS>"
        if HAS_DIGIT.search(piece):
            return "<IP>" if IS_ADDRESS.fullmatch(piece) else "<NUM>"
        if len(self) > 200_000:
            self.clear()
        other = {":": "<INNER>", ": ": ":", "|": "<INNER>", "| ": "|", '""': "<QUOTED>"}.get(piece, piece)
        self[piece] = word = "<LVL>" if piece.lower() in LEVEL_OF else other
        return word


def shape_of(line: str, masks: Masks) -> tuple[str, ...]:
    """The masked tokens of a line, as ``tokenize`` has them, without their spans."""
    pieces = PIECE.findall(line)
    out = [masks[p] for p in pieces]
    if pieces:
        if pieces[0] in LETTERS and line.startswith(pieces[0]):
            out[0] = "<LVL>"
        elif out[0] == "<NUM>" and EPOCH_FIRST.match(line):
            out[0] = "<TS>"
        if pieces[-1] == ":":
            out[-1] = ":"
    return tuple(out)


def route_of(tokens: list[str]) -> str:
    """Token count and leading tokens, words of any kind alike."""
    return "\x1f".join([str(len(tokens)), *[t if t in LAYOUT or t[0] in "<({" else "<W>" for t in tokens[:DEPTH]]])


@dataclass
class TemplateTree:
    """Token count, then DEPTH leading tokens, then a leaf of templates [tokens, lines].

    At its limit a tree counts further shapes under one template of variables per token count.
    """

    limit: int = MAX_TEMPLATES
    leaves: dict[str, list[list]] = field(default_factory=dict)
    known: dict[tuple, list] = field(default_factory=dict)  # shapes met before; emptied when it grows large
    size: int = 0

    @staticmethod
    def likeness(a: list[str], b: tuple[str, ...]) -> float:
        """Share of equal tokens; 0 if a token of the layout meets something else."""
        same = 0
        for x, y in zip(a, b):
            if x == y:
                same += 1
            elif x in LAYOUT or y in LAYOUT:
                return 0.0
        return same / max(1, len(a))

    def add(self, tokens: tuple[str, ...], count: int = 1) -> None:
        if (known := self.known.get(tokens)) is not None:
            known[1] += count
            return
        leaf = self.leaves.setdefault(route_of(tokens), [])
        best = max(leaf, key=lambda t: self.likeness(t[0], tokens), default=None)
        if best is not None and self.likeness(best[0], tokens) >= SIMILAR:
            best[0] = [x if x == y else "<*>" for x, y in zip(best[0], tokens)]
        elif self.size < self.limit:
            best = [list(tokens), 0]
            leaf.append(best)
            self.size += 1
        else:
            rest = self.leaves.setdefault(f"{len(tokens)}\x1f<*>", [])
            best = rest[0] if rest else [["<*>"] * len(tokens), 0]
            rest[:] = [best]
        best[1] += count
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[tokens] = best

    def rows(self) -> list[tuple[str, list[str], int]]:
        return [(route_of(t), t, n) for leaf in self.leaves.values() for t, n in leaf]


@dataclass(frozen=True)
class FieldMap:
    """Token positions of the fields. ``sep``: fields are the line's parts between ``sep``."""

    ts: int = -1
    level: int = -1
    component: int = -1
    message: int = -1
    sep: str = ""


@dataclass
class Core:
    """What surely is header. ``name``: the core with its words alike; ``end``: the token behind it;
    ``component``: the word or group of the core that may name the component."""

    name: str
    ts: int = -1
    level: int = -1
    component: int = -1
    end: int = 0
    sep: str = ""


def is_word(token: str) -> bool:
    return token == "<NUM>" or token == "<*>" or token[0] not in "<[]|:=\"(){},\t"


def core_of(t: list[str] | tuple[str, ...]) -> Core | None:
    """The core of a line or template; None if it has no time among its first elements or no level."""
    if len(t) > 1 and t[1] == "=":
        if t[0] not in KEYS:
            return None
        found: dict[str, int] = {}
        for i in range(len(t) - 2):
            if t[i + 1] == "=" and t[i] in KEYS:
                for name, keys in (("ts", TIME_KEYS), ("level", LEVEL_KEYS), ("component", COMPONENT_KEYS), ("message", MESSAGE_KEYS)):
                    if t[i] in keys and name not in found:
                        found[name] = i + 2
        if {"ts", "level", "message"} <= found.keys():
            return Core("=", found["ts"], found["level"], found.get("component", -1), found["message"], "=")
        return None
    if len(t) > 1 and t[1] in ("|", "\t") and t[0] in ("<TS>", "<LVL>"):
        return Core(f"{t[0]}{t[1]}", 0, 0, sep=t[1])
    ts = level = -1
    words: list[int] = []  # words inside the core
    groups: list[int] = []
    pending: list[int] = []  # words after the core as far as it is known
    i = end = 0
    while i < min(len(t), CORE):
        tok = t[i]
        if tok == "[":
            close = next((j for j in range(i + 1, min(len(t), i + 7)) if t[j] == "]"), -1)
            inside = t[i + 1 : close]
            if close < 0 or (pending and ts >= 0 and level >= 0):
                break
            if ts < 0 and list(inside) == ["<TS>"]:
                ts = i + 1
            elif level < 0 and list(inside) == ["<LVL>"]:
                level = i + 1
            elif ts < 0:
                return None
            else:
                groups.append(i + 1)
            i = close + 1
        elif tok == "<TS>" and ts < 0 or tok == "<LVL>" and level < 0:
            if tok == "<TS>":
                ts = i
            else:
                level = i
            i += 1
        elif ts < 0 and not (t[0] == "<IP>" and i < 3):
            return None
        elif is_word(tok) and tok != "-" and len(pending) < WORDS or ts < 0:
            pending.append(i)
            i += 1
            continue
        elif tok == ":" and t[i + 1 : i + 2] in (["<LVL>"], ("<LVL>",)) and level < 0:
            i += 1
            continue
        else:
            break
        words += pending
        pending, end = [], i
    if ts < 0 or (level < 0 and t[0] != "<IP>"):
        return None
    named = [w for w in words if w > min(ts, level)] if level >= 0 else []
    held = [g for g in groups if t[g] != "<NUM>"]  # a process or thread is numbered
    name = " ".join(x if x in LAYOUT or x == "<IP>" else "<W>" for x in t[:end])
    return Core(name, ts, level, named[-1] if named else held[0] if held else -1, end)


def ending_of(t: list[str] | tuple[str, ...], core: Core) -> str:
    """What follows a core: the sign that may end the header and its distance, ``*`` for a variable word, else nothing.

    Of separated lines the number of separators.
    """
    if core.sep == "=":
        return ""
    if core.sep:
        return str(t.count(core.sep))
    i, seen = core.end, 0
    while i < len(t) and seen <= WORDS:
        if t[i] in ("-", ":", "]"):
            return f"{t[i]}{i - core.end}"
        if t[i] == "[":
            close = next((j for j in range(i + 1, min(len(t), i + 7)) if t[j] == "]"), -1)
            if close < 0:
                break
            i = close + 1
            continue
        if not is_word(t[i]):
            break
        i, seen = i + 1, seen + 1
    return "*" if t[core.end : core.end + 1] in (["<*>"], ("<*>",)) else ""


def settle(endings: dict[str, int], named: bool, sep: str = "") -> tuple[str, ...]:
    """The endings of a core's lines, from the lines that have each: the most frequent one first.

    Where a sign ends the header, programs may differ in it: other signs of a good share of the
    lines count too. ``named``: the core has a component, so only an ending of nearly all of many
    lines counts.
    """
    if sep:
        endings = Counter(endings)
        if any(int(e) >= USUAL[sep] for e in endings):
            endings[str(USUAL[sep])] += 1
    total = sum(endings.values())
    best = min(endings, key=lambda e: (-endings[e], len(e), e))
    if named and best and not sep:
        if best == "*" or (best[1:] != "0" and (endings[best] < SURE_SHARE * total or total < SURE_LINES)):
            return ("",)
    if sep or named or best in ("", "*"):
        return (best,)
    others = (e for e in sorted(endings) if e not in ("", "*", best) and endings[e] >= GOOD_SHARE * total)
    return best, *others


def map_fields(t: list[str] | tuple[str, ...], layouts: dict[str, tuple[str, ...]] | None = None) -> FieldMap | None:
    """Positions of the fields in a line or template; None if it opens no entry.

    ``layouts``: the endings of each core; a line of another core is settled by itself.
    """
    core = core_of(t)
    if core is None:
        return None
    if core.sep == "=":
        return FieldMap(core.ts, core.level, core.component, core.end, "=")
    own = ending_of(t, core)
    settled = (layouts or {}).get(core.name) or settle({own: 1}, core.component >= 0, core.sep)
    ending = own if own in settled else settled[0]
    if core.sep:
        last = int(ending)
        return FieldMap(0, 1, 2, last, core.sep) if last > 2 and int(own) >= last else None
    if ending == "*":
        ok = core.end < len(t) and is_word(t[core.end])
        return FieldMap(core.ts, core.level, core.end, core.end + 1) if ok else None
    if not ending:
        if core.component < 0 and t[core.end : core.end + 1] in (["["], ("[",)):  # a group that doesn't end in the header
            return None
        skip = t[core.end : core.end + 1] in (["-"], [":"], ("-",), (":",))
        return FieldMap(core.ts, core.level, core.component, core.end + skip)
    at = core.end + int(ending[1:])
    if at >= len(t) or t[at] != ending[0]:
        return None
    if at == core.end:
        return FieldMap(core.ts, core.level, core.component, at + 1)
    before = [i for i in range(core.end, at) if is_word(t[i]) and "[" not in t[core.end : i]]
    return FieldMap(core.ts, core.level, before[-1], at + 1) if before else None


ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def unescape(quoted: str) -> str:
    if len(quoted) >= 2 and quoted[0] == quoted[-1] == '"':
        return re.sub(r"\\(.)", lambda m: ESCAPES.get(m.group(1), m.group(1)), quoted[1:-1], flags=re.S)
    return quoted


YEARLESS = re.compile(r"[A-Z][a-z]{2} [ \d]\d ")


def extract(line: str, spans: list[tuple[int, int]], fm: FieldMap) -> tuple[int, str, str | None, str] | None:
    """(ts_ms, level, component, message) by the template's positions, None if they don't hold."""

    def token(i: int) -> str | None:
        return line[spans[i][0] : spans[i][1]] if 0 <= i < len(spans) else None

    if fm.sep in ("|", "\t"):
        parts = [p.strip() for p in line.split(" | " if fm.sep == "|" else fm.sep, fm.message)]
        if len(parts) <= fm.message:
            return None
        fields = [*parts[:3], parts[fm.message]]
        at = 1 if level_of(fields[0]) and not level_of(fields[1]) else 0  # time and level may change places
        ts, level, component, message = fields[at], fields[1 - at], fields[2], fields[3]
    elif fm.sep == "=":
        ts, level, component, message = token(fm.ts), token(fm.level), token(fm.component), token(fm.message)
        if message is not None and not message.startswith('"'):
            message = line[spans[fm.message][0] :].split(" ", 1)[0]
        component = unescape(component) if component else component
        ts, level, message = (unescape(x) if x else x for x in (ts, level, message))
    else:
        ts, level, component = token(fm.ts), token(fm.level), token(fm.component)
        message = line[spans[fm.message][0] :] if fm.message < len(spans) else ""
    at, lvl = epoch_ms(ts) if ts else None, level_of(level)
    if (at is None and not YEARLESS.match(ts or "")) or (lvl is None and level is not None) or message is None:
        return None
    component = component.strip() if component else None
    return at, lvl, component or None, message.strip()


def from_object(o) -> tuple[int, str | None, str | None, str] | None:
    """Fields at the top level of a JSON object; None if it is no log entry."""
    if not isinstance(o, dict):
        return None

    def pick(keys):
        return next((o[k] for k in keys if o.get(k) is not None and not isinstance(o[k], (dict, list))), None)

    at, message = epoch_ms(pick(TIME_KEYS)), pick(MESSAGE_KEYS)
    if at is None or message is None:
        return None
    component = pick(COMPONENT_KEYS)
    return at, level_of(pick(LEVEL_KEYS)), None if component is None else str(component), str(message).strip()


MEMBER = re.compile(r'^(\s*)"((?:[^"\\]|\\.)*)"\s*:\s*(.*?),?\s*$')


def from_text(text: str) -> tuple[int, str | None, str | None, str] | None:
    """Like ``from_object`` for printed JSON; of text that breaks off, the members at the outer indent."""
    try:
        return from_object(json.loads(text))
    except ValueError:
        pass
    outer, members = None, {}
    for line in text.split("\n")[1:]:
        if m := MEMBER.match(line):
            outer = len(m.group(1)) if outer is None else outer
            if len(m.group(1)) == outer:
                try:
                    members[m.group(2)] = json.loads(m.group(3))
                except ValueError:
                    pass
    return from_object(members)


def _clean(raw) -> str:
    line = raw if isinstance(raw, str) else ""
    line = line.rstrip("\r\n")
    return ANSI.sub("", line) if "\x1b" in line else line


def local_templates(lines: DataFrame, raw: str = "raw_message") -> DataFrame:
    """Each task's template tree: route, part, tokens, n."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, masks = TemplateTree(), Masks()
        for batch in batches:
            shapes: Counter = Counter()
            for value in batch[raw]:
                line = _clean(value)
                if line and not line[0].isspace() and line[0] not in "{}":
                    shapes[shape_of(line, masks)] += 1
            for tokens, n in shapes.items():
                tree.add(tokens, n)
        yield pd.DataFrame(tree.rows(), columns=["route", "tokens", "n"])

    return lines.select(raw).mapInPandas(grow, "route string, tokens array<string>, n long").withColumn("part", F.spark_partition_id())


def merged_templates(local: DataFrame, limit: int = MAX_TEMPLATES, fan_in: int = 32) -> DataFrame:
    """The tasks' templates merged route by route (route, tokens, n), those of ``fan_in`` tasks first, so that a route is no single task's work."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = TemplateTree(limit)
        rows = sorted(((int(n), tuple(t)) for t, n in zip(pdf["tokens"], pdf["n"])), key=lambda r: (-r[0], r[1]))
        for n, tokens in rows:
            tree.add(tokens, n)
        return pd.DataFrame(tree.rows(), columns=["route", "tokens", "n"])

    shape = "route string, tokens array<string>, n long"
    few = local.groupBy("route", F.floor(F.col("part") / fan_in).alias("part")).applyInPandas(merge, shape)
    return few.groupBy("route").applyInPandas(merge, shape)


def layouts_of(templates: DataFrame, limit: int = MAX_LAYOUTS) -> dict[str, tuple[str, ...]]:
    """The endings of each core, settled by the lines of its templates; read to the driver.

    Of more than ``limit`` cores and endings those of most lines are kept; other lines are settled by themselves.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for tokens, n in zip(batch["tokens"], batch["n"]):
                tokens = list(tokens)
                if (core := core_of(tokens)) is not None and core.sep != "=":
                    seen[core.name, core.component >= 0, ending_of(tokens, core)] += int(n)
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["core", "named", "ending", "n"])

    found = templates.select("tokens", "n").mapInPandas(look, "core string, named boolean, ending string, n long")
    found = found.groupBy("core", "named", "ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "core", "ending").limit(limit)
    endings: dict[str, Counter] = {}
    named: dict[str, Counter] = {}
    for r in found.collect():
        endings.setdefault(r.core, Counter())[r.ending] += r.n
        named.setdefault(r.core, Counter())[r.named] += r.n
    return {c: settle(seen, named[c].most_common(1)[0][0], c[-1] if c[-1] in USUAL else "") for c, seen in endings.items()}


def template_table(lines: DataFrame, raw: str = "raw_message") -> DataFrame:
    """template, lines, opens_entry: what the tree learned (lines that start with a blank or brace aside)."""
    templates = materialise(merged_templates(local_templates(lines, raw)), "templates")
    layouts = layouts_of(templates)

    @F.pandas_udf("boolean")
    def opens(tokens: pd.Series) -> pd.Series:
        return pd.Series([map_fields(list(t), layouts) is not None for t in tokens], dtype=bool)

    return templates.select(F.array_join("tokens", " ").alias("template"), F.col("n").alias("lines"), opens("tokens").alias("opens_entry"))


HEADER, OBJECT = 1, 2
#: A line of a printed JSON object starts, after its indent, with one of these.
JSON_STARTS = frozenset('{}[]"-0123456789tfn')
PARSED_NAMES = ["stream", "line_no", "raw", "kind", "blank", "closes", "ts_ms", "level", "component", "msg"]
PARSED_DDL = ["string", "long", "string", "int", "boolean", "boolean", "long", "string", "string", "string"]
PARSED_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()]
NO_FIELDS = (None,) * 4


def parse_lines(lines: DataFrame, stream: str = "stream", order: str = "line_no", raw: str = "raw_message") -> DataFrame:
    """Each line with ``kind`` (1 opens an entry, 2 may open a printed JSON object, 0 neither).

    ``raw`` is kept of lines that can be part of a printed object, the fields of openers.
    """
    layouts = layouts_of(merged_templates(local_templates(lines, raw)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple, FieldMap | None] = {}  # by masked line; emptied when it grows large
        for batch in batches:
            kept, kinds, blank, closes, found = [], [], [], [], []
            for value in batch.column(2).to_pylist():
                line = _clean(value)
                body = line.strip()
                fields, kind = None, 0
                if body and not line[0].isspace():
                    if line[0] == "{":
                        if body == "{":
                            kind = OBJECT
                        elif body[-1] == "}":
                            try:
                                fields = from_object(json.loads(body))
                            except ValueError:
                                pass
                    elif line[0] != "}":
                        tokens, spans = tokenize(line, CORE + 8)
                        shape = tuple(tokens)
                        if shape[1:2] in (("|",), ("\t",)):  # separators are counted in the whole line
                            shape = (*shape[:1], *shape[1:2] * (line.count(" | ") if shape[1] == "|" else line.count("\t")))
                        if shape not in maps:
                            if len(maps) > 100_000:
                                maps.clear()
                            maps[shape] = map_fields(shape, layouts)
                        fm = maps[shape]
                        fields = extract(line, spans, fm) if fm else None
                kept.append(value if body and body[0] in JSON_STARTS else None)
                kinds.append(kind if fields is None else HEADER)
                blank.append(not body)
                closes.append(line.rstrip() == "}")
                found.append(fields or NO_FIELDS)
            columns = [batch.column(0), batch.column(1).cast(pa.int64()), kept, kinds, blank, closes, *(zip(*found) if found else [()] * 4)]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, PARSED_TYPES)]
            yield pa.RecordBatch.from_arrays(arrays, names=PARSED_NAMES)

    schema = ", ".join(f"{n} {t}" for n, t in zip(PARSED_NAMES, PARSED_DDL))
    return lines.select(F.col(stream).cast("string"), order, raw).where(F.col(stream).isNotNull() & F.col(order).isNotNull()).mapInArrow(read, schema)


def running_max(df: DataFrame, key: str, order: str, marks: dict[str, tuple[Column, bool]], block: int) -> DataFrame:
    """Per name the largest mark at or before each row of its key (before it, if the flag is set).

    Two levels: windows of at most ``block`` consecutive orders, then windows over the blocks.
    """
    df = df.withColumn("__b", F.floor(F.col(order) / F.lit(block)).cast("long"))
    for name, (mark, _) in marks.items():
        df = df.withColumn(f"__m_{name}", mark)
    over = Window.partitionBy(key, "__b").orderBy(order)
    heads = df.groupBy(key, "__b").agg(*[F.max(f"__m_{n}").alias(f"__h_{n}") for n in marks])
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(key, "__b", *[F.max(f"__h_{n}").over(before).alias(f"__c_{n}") for n in marks])
    for name, (_, strict) in marks.items():
        df = df.withColumn(f"__l_{name}", F.max(f"__m_{name}").over(over.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)))
    df = df.join(heads, [key, "__b"])
    for name in marks:
        df = df.withColumn(name, F.greatest(f"__l_{name}", f"__c_{name}"))
    return df.drop("__b", *[f"__{p}_{n}" for n in marks for p in "mlc"])


def log_entries(
    lines: DataFrame,
    stream: str = "stream",
    order: str = "line_no",
    raw: str = "raw_message",
    block: int = 8192,
    max_object_lines: int = 10_000,
) -> DataFrame:
    """stream, first_line_no, last_line_no, ts_ms, level, component, msg of every entry.

    Lines before a stream's first entry belong to none; trailing blank lines of an entry
    don't count. Null lines are blank; rows without stream or line number are in no stream.
    A printed JSON object of more than ``max_object_lines`` lines is read by the member lines
    at its outer indent, wherever they stand (of the lines beyond that many, the last of each
    field name and indent is kept). Extra columns are ignored; an empty table has no entries.
    """
    parsed = materialise(parse_lines(lines, stream, order, raw), "lines")
    mark = F.when(F.col("kind") > 0, F.struct(F.col("line_no").alias("at"), "kind"))
    close = F.when(F.col("closes"), F.struct(F.col("line_no").alias("at"), "kind"))
    slim = parsed.select("stream", "line_no", "kind", "blank", "closes", "raw")  # the fields wait for the last join
    owned = running_max(slim, "stream", "line_no", {"owner": (mark, False), "closed": (close, True)}, block).where("owner is not null")
    owned = owned.withColumn("first", F.col("owner.at")).withColumn("by", F.col("owner.kind"))
    inside = (F.col("by") == OBJECT) & (F.coalesce(F.col("closed.at"), F.lit(-(2**62))) < F.col("first"))
    plain = F.regexp_replace(F.coalesce("raw", F.lit("")), ANSI.pattern, "")
    slot = F.regexp_extract(plain, r'^(\s*"(?:' + "|".join(TIME_KEYS + LEVEL_KEYS + COMPONENT_KEYS + MESSAGE_KEYS) + r')")\s*:', 1)
    late = F.col("line_no") >= F.col("first") + max_object_lines
    picked = owned.select(
        "stream", "first", "by", F.when(inside & late, slot).alias("slot"),
        F.when(inside, F.struct("line_no", "raw")).alias("line"), F.when(~F.col("blank"), F.col("line_no")).alias("full"),
    )
    early = F.collect_list(F.when(F.col("slot").isNull(), F.col("line"))).alias("early")
    slots = picked.groupBy("stream", "first", "by", "slot").agg(early, F.max(F.when(F.col("slot") != "", F.col("line"))).alias("late"), F.max("full").alias("last"))
    text = F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("lines"))), lambda s: F.coalesce(s["raw"], F.lit(""))), "\n")
    lines_of = F.when(F.col("slot").isNull(), F.col("early")).otherwise(F.array_compact(F.array("late"))).alias("lines")
    parts = slots.select("stream", "first", "by", lines_of, "last").groupBy("stream", "first", "by").agg(text.alias("text"), F.max("last").alias("last"))

    @F.pandas_udf("ok boolean, ts_ms long, level string, component string, msg string")
    def read_object(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = from_text("\n".join(_clean(x) for x in t.split("\n"))) if t else None
            rows.append((found is not None, *(found or NO_FIELDS)))
        frame = pd.DataFrame(rows, columns=["ok", "ts_ms", "level", "component", "msg"])
        frame["ts_ms"] = frame["ts_ms"].astype("Int64")
        return frame

    fields = ("ts_ms", "level", "component", "msg")
    parts = parts.select("stream", "first", "by", "last", read_object(F.when(F.col("by") == OBJECT, F.col("text"))).alias("o"))
    parts = materialise(parts.withColumn("valid", (F.col("by") == HEADER) | F.col("o.ok")), "parts")
    entry = running_max(parts, "stream", "first", {"entry": (F.when(F.col("valid"), F.col("first")), False)}, block).where("entry is not null")
    object_of = F.max(F.when((F.col("by") == OBJECT) & (F.col("first") == F.col("entry")), F.col("o"))).alias("o")
    spans = entry.groupBy("stream", "entry").agg(F.max("last").alias("last_line_no"), object_of)
    heads = parsed.where(F.col("kind") == HEADER).select(F.col("stream").alias("s"), F.col("line_no").alias("n"), *[F.col(f).alias(f"h_{f}") for f in fields])
    both = spans.join(heads, (F.col("stream") == F.col("s")) & (F.col("entry") == F.col("n")), "left")
    return both.select("stream", F.col("entry").alias("first_line_no"), "last_line_no", *[F.when(F.col("o").isNull(), F.col(f"h_{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields])
