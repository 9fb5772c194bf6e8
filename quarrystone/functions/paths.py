"""Paths: normal form, validity, case folding, reserved names, collisions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quarrystone.errors import CaseCollision, InvalidPath

_CONTROL = r"[\x00-\x1f\x7f]"


@pandas_udf(StringType())
def nfc(v: pd.Series) -> pd.Series:
    return v.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@pandas_udf(StringType())
def fold_key(v: pd.Series) -> pd.Series:
    """The full Unicode case folding of a path, by which two paths collide."""
    return v.map(lambda s: None if s is None else s.casefold())


def fold(path: Column, ascii_only: bool = False) -> Column:
    """With ``ascii_only``, A-Z only: an expression without Python."""
    return F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if ascii_only else fold_key(path)


def problem(path: Column, check_nfc: bool = False) -> Column:
    """Why a path is invalid, or null; the first rule that it breaks."""
    seg = F.split(path, "/", -1)
    out = (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.startswith("/"), "absolute")
        .when(path.contains("\\"), "backslash")
        .when(path.rlike(_CONTROL), "control character")
        .when(F.array_contains(seg, ""), "empty segment")
        .when(F.array_contains(seg, ".") | F.array_contains(seg, ".."), "dot segment")
    )
    return out.when(nfc(path) != path, "not NFC") if check_nfc else out


def problem_of(path: str) -> str | None:
    """The same for one path on the driver; text that isn't valid Unicode is invalid."""
    if not path:
        return "empty"
    try:
        path.encode()
    except UnicodeEncodeError:
        return "not UTF-8"
    if path.startswith("/"):
        return "absolute"
    if "\\" in path:
        return "backslash"
    if any(ord(c) < 0x20 or ord(c) == 0x7F for c in path):
        return "control character"
    parts = path.split("/")
    if "" in parts:
        return "empty segment"
    if "." in parts or ".." in parts:
        return "dot segment"
    return None if unicodedata.normalize("NFC", path) == path else "not NFC"


def normalize(path: str) -> str:
    """NFC, then valid or an error."""
    try:
        path = unicodedata.normalize("NFC", path)
    except (TypeError, ValueError) as e:
        raise InvalidPath(str(e)) from e
    why = problem_of(path)
    if why:
        raise InvalidPath(f"{path!r}: {why}")
    return path


#: Device names that Windows reserves.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def is_reserved(path: Column) -> Column:
    """Whether a segment is a reserved device name or ends in a space or dot."""
    return F.exists(F.split(path, "/", -1), lambda s: F.upper(F.substring_index(s, ".", 1)).isin(*RESERVED) | s.rlike("[ .]$"))


def is_reserved_name(path: str) -> bool:
    return any(s.split(".")[0].upper() in RESERVED or s[-1:] in (" ", ".") for s in path.split("/"))


def collisions(paths: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Groups of different paths with one folded key: fold, the first two of them, and how many.

    The paths themselves are counted by key, so the shuffle carries partial counts only."""
    seen = paths.select("path", fold(F.col("path"), ascii_only).alias("fold")).distinct()
    got = seen.groupBy("fold").agg(F.min("path").alias("first_path"), F.max("path").alias("last_path"), F.count("*").alias("n_paths"))
    return got.where("n_paths > 1")


def check_collisions(paths: DataFrame) -> None:
    bad = collisions(paths).orderBy("fold").limit(1).collect()
    if bad:
        raise CaseCollision(f"{bad[0]['first_path']!r} and {bad[0]['last_path']!r}")
