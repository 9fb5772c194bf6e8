"""Strict scalars and formatting."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.errors import InvalidRefName, MalformedObject

INT = "^(0|[1-9][0-9]*)$"
_UNITS = ["KiB", "MiB", "GiB", "TiB", "PiB"]


def human_bytes(n: Column) -> Column:
    """Bytes below 1024 as they are, else one decimal in the largest fitting unit of 1024, ties to even.

    The decimal is made in exact integers."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, u in enumerate(_UNITS):
        unit = 1024 ** (i + 1)
        tenfold = n.cast("decimal(20,0)") * 10
        rest = (tenfold % unit).cast("long")
        tenths = ((tenfold - rest) / unit).cast("long")
        tenths = tenths + F.when((2 * rest > unit) | (2 * rest == unit) & (tenths % 2 == 1), 1).otherwise(0)
        value = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {u}"))
        out = out.when(n < 1024 ** (i + 2), value) if i + 1 < len(_UNITS) else out.otherwise(value)
    return out


def strict_int(s: Column) -> Column:
    """The number of a canonical spelling, else null."""
    return F.when(s.rlike(INT), s.try_cast("long"))


def strict_time(s: Column) -> Column:
    """The instant of a canonical spelling (seconds, Z), else null."""
    t = F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") & (F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'") == s), t)


def parse_int(s: str) -> int:
    if not re.fullmatch(r"0|[1-9][0-9]*", s, re.ASCII) or int(s) >= 1 << 63:
        raise MalformedObject(f"{s!r} is not a canonical number")
    return int(s)


def format_time(t: dt.datetime) -> str:
    if t.tzinfo:
        t = t.astimezone(dt.UTC)
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}Z"


def parse_time(s: str) -> dt.datetime:
    try:
        t = dt.datetime.strptime(s, "%Y-%m-%dT%H:%M:%SZ")
    except ValueError as e:
        raise MalformedObject(str(e)) from e
    if format_time(t) != s:
        raise MalformedObject(f"{s!r} is not canonical")
    return t


def check_text(field: str, value: str) -> str:
    if not value or value != value.strip() or any(ord(c) < 0x20 or ord(c) == 0x7F for c in value):
        raise MalformedObject(f"{field} is empty, padded or holds a control character")
    return value


REF_SEGMENT = r"[A-Za-z0-9._-]+"


def ref_name_ok(name: Column) -> Column:
    """1 to 200 characters; segments of letters, digits, ., _ and -, not . or .., not ending in .lock."""
    seg = F.split(name, "/", -1)
    bad = F.exists(seg, lambda s: ~s.rlike(f"^{REF_SEGMENT}$") | s.isin(".", "..") | s.endswith(".lock"))
    return F.coalesce((F.length(name) >= 1) & (F.length(name) <= 200) & ~bad, F.lit(False))


def check_ref_name(name: str) -> str:
    if not 1 <= len(name) <= 200 or any(not re.fullmatch(REF_SEGMENT, s, re.ASCII) or s in (".", "..") or s.endswith(".lock") for s in name.split("/")):
        raise InvalidRefName(repr(name))
    return name


def change_line(kind: Column, before: Column, after: Column) -> Column:
    """A change as a line: +, -, M or R, and the paths."""
    return (
        F.when(kind == "added", F.concat(F.lit("+ "), after)).when(kind == "removed", F.concat(F.lit("- "), before))
        .when(kind == "changed", F.concat(F.lit("M "), after)).when(kind == "renamed", F.concat(F.lit("R "), before, F.lit(" -> "), after))
    )
