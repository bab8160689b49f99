"""Column expressions shared by several operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that counts as a surrounding blank.
BLANKS = " \t\n\r\x0b\x0c "


def stripped(col: Column) -> Column:
    """Without surrounding blanks (Spark's own ``trim`` takes only the space)."""
    return F.btrim(col, F.lit(BLANKS))


def folded(col: Column) -> Column:
    """Trimmed and in lower case: the identity of a source name or user id."""
    return F.lower(stripped(col))


def user_key(col: Column) -> Column:
    """Canonical user id; null for null, blank and ``-``."""
    key = folded(col)
    return F.when((key != "") & (key != "-"), key)


def row_digest(df: DataFrame, ignore: Iterable[str] = ()) -> list[Column]:
    """Two independent 64-bit hashes of all columns but ``ignore``, null-aware.

    Spark's hash skips nulls, so the pattern of nulls is hashed as well: ('a', null) and
    (null, 'a') differ.
    """
    names = sorted(c for c in df.columns if c not in set(ignore))
    cols = [F.col(f"`{c}`") for c in names]
    if not cols:
        return [F.lit(0).cast("long"), F.lit(0).cast("long")]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    return [F.xxhash64(F.lit(seed), nulls, *cols) for seed in (17, 40503)]


def with_scalars(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row DataFrame, read by one scalar subquery (null if it is empty)."""
    whole = row.select(F.struct(*row.columns)).scalar()
    return df.withColumns({c: whole[c] for c in row.columns})


def unit(*parts: Column | int | str) -> Column:
    """A number in [0, 1), fixed by its parts: the first 40 bits of the MD5 of the parts joined with slashes."""
    text = F.concat_ws("/", *[(c if isinstance(c, Column) else F.lit(c)).cast("string") for c in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long") / F.lit(float(1 << 40))
