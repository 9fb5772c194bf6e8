"""Canonical text objects: encoding, strict decoding, digests.

An object is UTF-8 text without a byte order mark: a framing line, then one line for each
record, fields apart by tabs, every line ended by a line feed, no blank lines and no white
space at a line's end.  Only a version's message, at its end, may have blank lines inside.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.errors import InconsistentObject, InvalidPath, MalformedId, MalformedObject
from quarrystone.functions import paths
from quarrystone.functions.ids import DEFAULT, Format, content_id, parse_id
from quarrystone.functions.text import check_text, format_time, parse_int, parse_time

MESSAGE = b"\nmessage\n"


@dataclass(frozen=True)
class File:
    size: int
    chunks: tuple[tuple[str, int], ...] = ()

    def check(self) -> None:
        if any(n <= 0 or c == "0" * 64 for c, n in self.chunks) or sum(n for _, n in self.chunks) != self.size:
            raise InconsistentObject("the chunks don't make the file")


@dataclass(frozen=True)
class Manifest:
    entries: tuple[tuple[str, str, int], ...] = ()  # path, file id, size

    def check(self) -> None:
        last = None
        for path, file_id, size in self.entries:
            why = paths.problem_of(path)
            if why:
                raise InvalidPath(f"{path!r}: {why}")
            key = path.encode()
            if last is not None and key <= last:
                raise InconsistentObject(f"{path!r} isn't in order")
            if size < 0 or file_id == "0" * 64:
                raise InconsistentObject(f"{path!r} has no content")
            last = key
        folded = [p.casefold() for p, _, _ in self.entries]
        if len(set(folded)) < len(folded):
            from quarrystone.errors import CaseCollision

            raise CaseCollision("two paths differ by case only")


@dataclass(frozen=True)
class Version:
    manifest: str
    author: str
    time: dt.datetime
    parents: tuple[str, ...] = ()
    expiry: dt.datetime | None = None
    graph: str | None = None
    message: str = ""

    def check(self) -> None:
        check_text("author", self.author)
        if len(set(self.parents)) < len(self.parents):
            raise InconsistentObject("a parent is there twice")
        if "0" * 64 in (self.manifest, *self.parents):
            raise InconsistentObject("an id is empty")
        if self.message:
            _message(self.message.encode() + b"\n")


@dataclass(frozen=True)
class Graph:
    extractors: tuple[tuple[str, str, str], ...] = ()  # name, version, scope
    edges: tuple[tuple[str, str, str], ...] = ()  # source, target, type

    def check(self) -> None:
        for rows in (self.extractors, self.edges):
            keys = [tuple(x.encode() for x in r) for r in rows]
            if any(a >= b for a, b in zip(keys, keys[1:], strict=False)):
                raise InconsistentObject("records aren't in order, each once")
        for r in self.extractors:
            for x in r:
                check_text("extractor", x)
        for s, t, kind in self.edges:
            for p in (s, t):
                why = paths.problem_of(p)
                if why:
                    raise InvalidPath(f"{p!r}: {why}")
            check_text("type", kind)


@dataclass(frozen=True)
class Signature:
    version: str
    key: str
    signature: bytes

    def check(self) -> None:
        check_text("key", self.key)
        if not self.signature or self.version == "0" * 64:
            raise InconsistentObject("the signature is empty")


KIND_OF = {File: "file", Manifest: "manifest", Version: "version", Graph: "graph", Signature: "signature"}


def encode(o, form: Format = DEFAULT) -> bytes:
    o.check()
    kind = KIND_OF[type(o)]
    rows: list[tuple] = [(form.header(kind),)]
    if kind == "file":
        rows += [("size", o.size), *o.chunks]
    elif kind == "manifest":
        rows += o.entries
    elif kind == "version":
        rows += [("manifest", o.manifest), *(("parent", p) for p in o.parents), ("author", o.author), ("time", format_time(o.time))]
        rows += [("expiry", format_time(o.expiry))] if o.expiry else []
        rows += [("graph", o.graph)] if o.graph else []
        rows += [("message",), (o.message,)] if o.message else []
    elif kind == "graph":
        rows += [("extractor", *e) for e in o.extractors] + [("edge", *e) for e in o.edges]
    else:
        rows += [("version", o.version), ("key", o.key), ("signature", o.signature.hex())]
    return "".join("\t".join(map(str, r)) + "\n" for r in rows).encode()


def _message(block: bytes) -> str:
    if not block or b"\r" in block or not block.endswith(b"\n"):
        raise MalformedObject("the message is empty, not ended, or has carriage returns")
    try:
        lines = block.decode()[:-1].split("\n")
    except UnicodeDecodeError as e:
        raise MalformedObject("not UTF-8") from e
    if not lines[0] or not lines[-1] or any(x != x.rstrip(" \t") for x in lines):
        raise MalformedObject("the message has a blank edge or a line that ends in white space")
    return "\n".join(lines)


class _Lines:
    def __init__(self, data: bytes, header: str):
        try:
            text = data.decode()
        except UnicodeDecodeError as e:
            raise MalformedObject("not UTF-8") from e
        if not text or text.startswith("﻿") or "\r" in text or not text.endswith("\n"):
            raise MalformedObject("empty, not ended, or with a byte order mark or carriage returns")
        self.rows = text[:-1].split("\n")
        if any(not x or x[-1] in " \t" for x in self.rows):
            raise MalformedObject("a blank line, or one that ends in white space")
        if self.rows[0] != header:
            raise MalformedObject(f"framing line {self.rows[0]!r}")
        self.at = 1

    def key(self) -> str | None:
        return self.rows[self.at].split("\t")[0] if self.at < len(self.rows) else None

    def take(self, n: int, key: str | None = None) -> list[str]:
        if self.at >= len(self.rows):
            raise MalformedObject("ends too soon")
        got = self.rows[self.at].split("\t")
        if len(got) != n or key is not None and got[0] != key:
            raise MalformedObject(f"line {self.at + 1}")
        self.at += 1
        return got

    def each(self, n: int, key: str | None = None) -> list[list[str]]:
        out = []
        while self.at < len(self.rows) and (key is None or self.key() == key):
            out.append(self.take(n, key))
        return out

    def end(self) -> None:
        if self.at < len(self.rows):
            raise MalformedObject(f"line {self.at + 1} is not expected")


def decode(kind: str, data: bytes, form: Format = DEFAULT):
    """The object of canonical bytes; any other spelling is an error."""
    message = ""
    if kind == "version" and (at := data.find(MESSAGE)) >= 0:
        message, data = _message(data[at + len(MESSAGE) :]), data[: at + 1]
    r = _Lines(data, form.header(kind))
    if kind == "file":
        size = parse_int(r.take(2, "size")[1])
        o = File(size, tuple((parse_id(c), parse_int(n)) for c, n in r.each(2)))
    elif kind == "manifest":
        o = Manifest(tuple((p, parse_id(f), parse_int(n)) for p, f, n in r.each(3)))
    elif kind == "version":
        manifest = parse_id(r.take(2, "manifest")[1])
        parents = tuple(parse_id(p) for _, p in r.each(2, "parent"))
        author, time = r.take(2, "author")[1], parse_time(r.take(2, "time")[1])
        expiry = parse_time(r.take(2, "expiry")[1]) if r.key() == "expiry" else None
        graph = parse_id(r.take(2, "graph")[1]) if r.key() == "graph" else None
        o = Version(manifest, author, time, parents, expiry, graph, message)
    elif kind == "graph":
        ex = tuple(tuple(x[1:]) for x in r.each(4, "extractor"))
        o = Graph(ex, tuple(tuple(x[1:]) for x in r.each(4, "edge")))
    elif kind == "signature":
        v, k, s = parse_id(r.take(2, "version")[1]), r.take(2, "key")[1], r.take(2, "signature")[1]
        try:
            raw = bytes.fromhex(s)
        except ValueError as e:
            raise MalformedObject("signature") from e
        if raw.hex() != s:
            raise MalformedObject("signature")
        o = Signature(v, k, raw)
    else:
        raise MalformedId(f"no kind {kind!r}")
    r.end()
    o.check()
    return o


def identity(o, algorithm: str = "blake3", form: Format = DEFAULT) -> str:
    """The id of an object; a file's is that of its content, not of this text."""
    return content_id(KIND_OF[type(o)], encode(o, form), algorithm, form)


def manifest_lines(entries: DataFrame) -> DataFrame:
    """Each entry's canonical line."""
    return entries.select("path", F.concat_ws("\t", "path", "file_id", F.col("size").cast("string")).alias("line"))


def manifest_digest(entries: DataFrame, form: Format = DEFAULT) -> DataFrame:
    """The sha256 identity of a manifest, made in one aggregate over its sorted lines.

    A manifest is one object whose bytes are hashed in order, so it is gathered in one row; the
    text is that of a version's manifest (about 100 bytes a path), not of the content."""
    lines = manifest_lines(entries).agg(F.count("*").alias("entries"), F.array_sort(F.collect_list(F.struct("path", "line"))).alias("rows"))
    body = F.concat(F.lit(form.header("manifest") + "\n"), F.when(F.col("entries") > 0, F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))).otherwise(F.lit("")))
    return lines.select(F.lit("manifest").alias("kind"), F.sha2(body, 256).alias("digest"), "entries")


def digested(rows: DataFrame, kind: str, of: Callable[[dict], object], key: str, form: Format = DEFAULT) -> DataFrame:
    """(kind, key, digest): sha256 of the canonical bytes of the object that ``of`` makes of each row; the bytes are decoded
    again, and must give the same object.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                o = of(r)
                data = encode(o, form)
                if decode(kind, data, form) != o:
                    raise MalformedObject(f"{kind} {r[key]} doesn't survive its spelling")
                out.append((kind, r[key], hashlib.sha256(data).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["kind", "key", "digest"])

    return rows.mapInArrow(run, "kind string, key string, digest string")
