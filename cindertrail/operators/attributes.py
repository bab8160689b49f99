"""Attribute-value rows as one wide, typed row per entity: log-structured upserts.

A batch of (entity, attribute, value) rows becomes a *delta*: one sparse wide row per
entity, a map from attribute to a cell that carries its version. Runs of deltas are sorted
by entity and compacted by taking, per cell, the value of the highest version. Compaction is
associative, so deltas of days, files or batches can be merged in any order, a few at a time.

Rows are folded to one row per entity, batch and attribute before the first shuffle, so a hot
entity costs as many rows as it has cells in a batch, and a wide row is never longer than the
catalogue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrail.functions.cleaning import stripped

TYPES = {"int": "decimal(38,0)", "dec": "decimal(38,3)", "bool": "boolean", "time": "timestamp", "text": "string"}
#: Words and signs that stand for "nothing".
PLACEHOLDERS = (
    "", "-", "--", "---", "?", "none", "null", "nil", "nan", "n/a", "na", "n.a.", "#n/a", "undefined",
    "(none)", "(null)", "<none>", "<null>", "\\n", "–", "—",
)
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"
#: Versions in a row that make one batch, and the most batches an entity's deltas can come from.
BATCH, BATCHES = 100_000, 64
#: Columns of a catalogue are read to the driver; a catalogue beyond this is refused.
MAX_ATTRIBUTES = 2000


def plain_name(col: Column) -> Column:
    """Letters and digits in lower case: what makes two spellings one name."""
    return F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]", ""))


def readable(value: Column) -> Column:
    """The trimmed value, null for blanks and placeholders."""
    v = stripped(value)
    return F.when(~F.lower(v).isin(*PLACEHOLDERS), v)


def as_int(v: Column) -> Column:
    """Whole numbers; a comma groups thousands; exponents and fractions of zero allowed."""
    plain = F.when(v.rlike(r"^[+-]?\d{1,3}(,\d{3})+([.eE].*)?$"), F.regexp_replace(v, ",", "")).otherwise(v)
    number = F.when(plain.rlike(NUMBER), plain.try_cast("decimal(38,12)"))
    wide = F.when(plain.rlike(r"^[+-]?\d{1,38}$"), plain.try_cast("decimal(38,0)"))
    return F.coalesce(wide, F.when(number == F.floor(number), number.cast("decimal(38,0)")))


def as_dec(v: Column) -> Column:
    """Numbers with three decimals; a single comma is the decimal mark."""
    plain = F.when(v.rlike(r"^[+-]?\d*,\d+([eE][+-]?\d+)?$"), F.regexp_replace(v, ",", ".")).otherwise(v)
    return F.when(plain.rlike(NUMBER), plain.try_cast("decimal(38,3)"))


def as_bool(v: Column) -> Column:
    low = F.lower(v)
    return F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))


def as_time(v: Column) -> Column:
    """ISO forms (basic and extended), access-log form, epoch seconds or milliseconds.

    Without a zone the time is UTC. A bare number under 10^11 is seconds.
    """
    plain = v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$")  # the common form, read as it is
    iso = F.regexp_replace(F.upper(v), r"^(\d{4}-\d{2}-\d{2})[T ]+", "$1T")
    iso = F.regexp_replace(iso, ",", ".")
    iso = F.regexp_replace(iso, r"\s+|UTC$|GMT$", "")
    basic = F.regexp_replace(F.upper(v), r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    iso = F.when(v.rlike(r"^\d{8}[Tt]\d{6}"), basic).otherwise(iso)
    iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    extended = F.when(zoned.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"), zoned.try_cast("timestamp"))
    day = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(v, F.lit("T00:00:00Z")).try_cast("timestamp"))
    clf = F.when(v.rlike(r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(v, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    bare = F.when(v.rlike(r"^\d{1,15}(\.\d{1,9})?$"), v.try_cast("decimal(24,9)"))
    millis = F.when(bare < F.lit(10**11), bare * 1000).otherwise(bare).cast("long")
    return F.when(plain, v.try_cast("timestamp")).when(bare.isNotNull(), F.timestamp_millis(millis)).otherwise(F.coalesce(extended, day, clf))


READERS = {"int": as_int, "dec": as_dec, "bool": as_bool, "time": as_time, "text": lambda v: v}


def catalogue(attr_catalog: DataFrame) -> list[tuple[str, str]]:
    """(attr_name, attr_type) in name order, read to the driver (at most MAX_ATTRIBUTES)."""
    rows = attr_catalog.select("attr_name", "attr_type").where("attr_name is not null").distinct().limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"the catalogue has more than {MAX_ATTRIBUTES} attributes")
    bad = sorted({r.attr_type for r in rows} - set(TYPES), key=str)
    if bad:
        raise ValueError(f"unknown attribute types {bad}")
    return sorted((r.attr_name, r.attr_type) for r in rows)


def plain_names(attributes: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Attributes by plain name; two of one plain name are both filled."""
    out: dict[str, list[tuple[str, str]]] = {}
    for name, kind in attributes:
        out.setdefault("".join(ch for ch in name.lower() if ch.isalnum()), []).append((name, kind))
    return out


def wide_delta(
    rows: DataFrame, attributes: list[tuple[str, str]], entity: str = "event_id", version: str = "rec_no", batch: Column | None = None
) -> DataFrame:
    """Batches as sparse wide rows: batch, entity, cells (attribute to struct(version, value)).

    ``batch`` tells the batches apart; without it all rows are one. Rows with a null entity,
    version or name, of names outside the catalogue or with unreadable values fill no cell; an
    entity without a filled cell has no row. Of two rows of one version the larger value stands.
    """
    owners = plain_names(attributes)
    kinds = {(plain, kind) for plain, held in owners.items() for _, kind in held}
    raw = rows.select(
        (F.lit(0) if batch is None else batch).cast("long").alias("batch"), F.col(entity).alias("entity"), F.col(version).cast("long").alias("version"),
        plain_name(F.col("attr_name")).alias("name"), readable(F.col("attr_value")).alias("v"),
    ).where("entity is not null and version is not null")
    # Each value is read once, in the type of its attribute; nulls leave after the fold, for a filter here would read all values twice.
    cell = F.lit(None).cast("string")
    for kind in sorted({k for _, k in kinds}):
        cell = F.when(F.col("name").isin(*[p for p, k in kinds if k == kind]), canonical_text(READERS[kind](F.col("v")), kind)).otherwise(cell)
    cells = raw.select("batch", "entity", "name", "version", cell.alias("value"))
    newest = F.max(F.when(F.col("value").isNotNull(), F.struct("version", "value"))).alias("cell")
    cells = cells.groupBy("batch", "entity", "name").agg(newest).where("cell is not null")
    named = F.transform(F.collect_list(F.struct("name", "cell")), lambda c: F.struct(c["name"], c["cell"]))  # at most the catalogue
    return cells.repartition("entity").groupBy("batch", "entity").agg(F.map_from_entries(named).alias("cells")).withColumnRenamed("entity", entity)


def canonical_text(value: Column, kind: str) -> Column:
    """A typed value as the text that represents it in a cell."""
    if kind == "time":
        return F.unix_millis(value).cast("string")
    return value.cast("string")


def batch_of(version: Column) -> Column:
    """Ranges of BATCH versions as batches, numbered round BATCHES, so that an entity never has more deltas than that."""
    return F.pmod(F.floor(version / BATCH), F.lit(BATCHES))


def newer(a: Column, b: Column) -> Column:
    """Two sparse wide rows as one: per cell the one of the higher version."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def compact(*runs: DataFrame, entity: str = "event_id") -> DataFrame:
    """entity, cells: runs of deltas merged, per entity and cell the value of the highest version.

    A run may hold many batches; an entity has one row a batch and run, and these are merged one
    after the other.
    """
    union = reduce(lambda a, b: a.unionByName(b), [r.select(entity, "cells") for r in runs])
    none = F.create_map().cast("map<string,struct<version:bigint,value:string>>")
    deltas = F.collect_list("cells")
    return union.groupBy(entity).agg(F.when(F.size(deltas) == 1, deltas[0]).otherwise(F.aggregate(deltas, none, newer)).alias("cells"))


def cell_text(name: str) -> Column:
    return F.col("cells")["".join(ch for ch in name.lower() if ch.isalnum())]["value"]


def typed_wide(run: DataFrame, attributes: list[tuple[str, str]], entity: str = "event_id") -> DataFrame:
    """A compacted run as plain typed columns, versions dropped."""
    return run.select(entity, *[typed_cell(cell_text(n), k).alias(n) for n, k in attributes])


def typed_cell(cell: Column, kind: str) -> Column:
    if kind == "time":
        return F.timestamp_millis(cell.cast("long"))
    return cell.cast(TYPES[kind])


def filled_cells(run: DataFrame, attributes: list[tuple[str, str]], entity: str = "event_id") -> DataFrame:
    """entity, attr_name, attr_value: one row per filled cell of a compacted run."""
    if not attributes:
        return run.select(entity, F.lit("").alias("attr_name"), F.lit("").alias("attr_value")).limit(0)
    cells = F.array(*[F.struct(F.lit(n).alias("attr_name"), cell_text(n).alias("attr_value")) for n, _ in attributes])
    return run.select(entity, F.explode(F.filter(cells, lambda c: c["attr_value"].isNotNull())).alias("c")).select(entity, "c.attr_name", "c.attr_value")
