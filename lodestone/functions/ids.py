"""Identifiers of 128 bits as strings of 32 lower-case hex digits, whose order is the order of the numbers.

Other forms: a UUID (dashes and case don't count), two BIGINTs (low and high 64 bits, as their two's
complement), 16 little-endian bytes. All are column expressions; null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import ColumnLike, col


def from_uuid(uuid: ColumnLike) -> Column:
    """Null unless 32 hex digits remain without the dashes."""
    bare = F.lower(F.regexp_replace(col(uuid), "-", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def to_uuid(id_: ColumnLike) -> Column:
    h = col(id_)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def from_halves(low: ColumnLike, high: ColumnLike) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(col(high)), 16, "0"), F.lpad(F.hex(col(low)), 16, "0")))


def low_half(id_: ColumnLike) -> Column:
    return F.conv(F.substring(col(id_), 17, 16), 16, -10).cast("long")


def high_half(id_: ColumnLike) -> Column:
    return F.conv(F.substring(col(id_), 1, 16), 16, -10).cast("long")


def resolve(uuid: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    """The UUID if there is one, else both halves; null if either half is missing."""
    return F.coalesce(from_uuid(uuid), from_halves(low, high))


def _turned(digits: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substr(digits, (15 - i) * 2 + 1, F.lit(2)))
    return F.array_join(pairs, "")


def to_bytes(id_: ColumnLike) -> Column:
    """16 bytes, lowest first."""
    return F.unhex(_turned(col(id_)))


def from_bytes(raw: ColumnLike) -> Column:
    """Null unless there are 16 bytes."""
    return F.when(F.length(col(raw)) == 16, _turned(F.lower(F.hex(col(raw)))))
