"""Identifiers: typed content hashes, their spelling, short forms and snapshot names."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarrystone.errors import MalformedId

from . import blake3

KINDS = ("chunk", "file", "manifest", "version", "graph", "signature")
HEX = "^[0-9a-f]{64}$"


@dataclass(frozen=True)
class Format:
    """Names that separate the domains; give an existing store's name to keep its identities."""

    name: str = "quarrystone"

    def context(self, kind: str) -> str:
        return f"{self.name} {kind} v1"

    def header(self, kind: str) -> str:
        return f"{self.name}-{kind} v1"

    @property
    def table_context(self) -> str:
        return f"{self.name} buzhash table v1"


DEFAULT = Format()


def content_ids(kind: str, data: list[bytes], algorithm: str = "blake3", form: Format = DEFAULT) -> list[str]:
    if kind not in KINDS:
        raise MalformedId(f"no kind {kind!r}")
    if algorithm == "sha256":
        return [hashlib.sha256(x).hexdigest() for x in data]
    return [x.hex() for x in blake3.digests(data, form.context(kind))]


def content_id(kind: str, data: bytes, algorithm: str = "blake3", form: Format = DEFAULT) -> str:
    return content_ids(kind, [data], algorithm, form)[0]


class ContentHasher:
    """B2: the id of content that comes in parts."""

    def __init__(self, kind: str, algorithm: str = "blake3", form: Format = DEFAULT):
        if kind not in KINDS:
            raise MalformedId(f"no kind {kind!r}")
        self._of = hashlib.sha256() if algorithm == "sha256" else blake3.Hasher(form.context(kind))
        self.size = 0

    def update(self, data: bytes) -> None:
        self._of.update(data)
        self.size += len(data)

    def id(self) -> str:
        return self._of.digest().hex()


def content_id_column(kind: str, data: Column, algorithm: str = "blake3", form: Format = DEFAULT) -> Column:
    """sha256 is a built-in expression; blake3 runs on Arrow batches."""
    if algorithm == "sha256":
        return F.sha2(data, 256)

    @pandas_udf("string")
    def ids(v: pd.Series) -> pd.Series:
        known = [x is not None for x in v]
        got = iter(content_ids(kind, [bytes(x) for x in v if x is not None], "blake3", form))
        return pd.Series([next(got) if k else None for k in known], index=v.index, dtype=object)

    return ids(data.cast("binary"))


def is_id(c: Column) -> Column:
    return F.coalesce(c.rlike(HEX), F.lit(False))


def is_key(kind: Column, digest: Column) -> Column:
    return F.coalesce(kind.isin(*KINDS), F.lit(False)) & is_id(digest)


def parse_id(s: str) -> str:
    import re

    if not re.fullmatch(HEX[1:-1], s or ""):
        raise MalformedId(repr(s))
    return s


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 12)


def snapshot_ref_name(time: Column, version: Column) -> Column:
    return F.concat(F.lit("snapshots/"), F.date_format(time, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(version, 1, 8))


def object_place(kind: Column, digest: Column) -> Column:
    """A10: an object's place in a fanned-out folder."""
    return F.concat_ws("/", F.lit("objects"), kind, F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.substring(digest, 5, 60))


def key_of_place(path: Column) -> tuple[Column, Column]:
    """The inverse: kind and digest; null for a foreign file."""
    spelled = rf"^objects/({'|'.join(KINDS)})/([0-9a-f]{{2}})/([0-9a-f]{{2}})/([0-9a-f]{{60}})$"
    part = lambda i: F.regexp_extract(path, spelled, i)
    ok = path.rlike(spelled)
    return F.when(ok, part(1)).alias("kind"), F.when(ok, F.concat(part(2), part(3), part(4))).alias("digest")
