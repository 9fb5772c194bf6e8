"""Ignore rules: an ordered list of glob patterns, the last match wins."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.errors import InvalidIgnore


@dataclass(frozen=True)
class IgnoreRule:
    pos: int
    negate: bool
    dir_only: bool
    regex: str | None  # null: never matches
    source: str


def glob_regex(glob: str) -> str | None:
    """A regular expression for a glob over whole path segments; * and ? stay within one, ** is any number of them.

    A broken character class or a trailing backslash never matches."""
    *front, last = glob.split("/")
    out, joined = "", False  # joined: a segment stands before, so the next one needs a /
    for seg in front:
        if seg == "**":
            out += "(?:/[^/]+)*" if joined else "(?:[^/]+/)*"
            continue
        body = _segment(seg)
        if body is None:
            return None
        out, joined = out + "/" * joined + body, True
    if last == "**":
        return out + ("(?:/[^/]+)*" if joined else "(?:[^/]+(?:/[^/]+)*)?")
    body = _segment(last)
    return None if body is None else out + "/" * joined + body


def _segment(seg: str) -> str | None:
    out, i = "", 0

    def member() -> str | None:
        """The next character of a class; - and ] only escaped."""
        nonlocal i
        if i < len(seg) and seg[i] == "\\":
            i += 1
        elif i < len(seg) and seg[i] in "-]":
            return None
        if i >= len(seg):
            return None
        i += 1
        return seg[i - 1]

    while i < len(seg):
        c = seg[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i >= len(seg):
                return None
            out += re.escape(seg[i])
            i += 1
        elif c == "[":
            neg = i < len(seg) and seg[i] == "^"
            i += neg
            ranges = []
            while not (ranges and i < len(seg) and seg[i] == "]"):
                lo = hi = member()
                if lo is not None and i < len(seg) and seg[i] == "-":
                    i += 1
                    hi = member()
                if lo is None or hi is None:
                    return None
                ranges.append((lo, hi) if lo <= hi else None)  # a range that runs down holds nothing
            i += 1
            inside = "".join(f"{re.escape(r[0])}-{re.escape(r[1])}" if r[0] != r[1] else re.escape(r[0]) for r in ranges if r)
            out += f"[^/{inside}]" if neg else f"[{inside}]" if inside else "(?!)"
        else:
            out += re.escape(c)
    return out


def parse_line(line: str, pos: int) -> IgnoreRule | None:
    source, line = line, line.rstrip(" \t")
    if not line or line.startswith("#"):
        return None
    negate = line.startswith("!")
    line = line[negate:]
    dir_only = line.endswith("/")
    line = line.removesuffix("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        raise InvalidIgnore(repr(source))
    body = glob_regex(line if anchored else f"**/{line}")
    return IgnoreRule(pos, negate, dir_only, None if body is None else f"^{body}$", source)


def parse(text: str | Iterable[str]) -> list[IgnoreRule]:
    lines = text.removeprefix("﻿").split("\n") if isinstance(text, str) else list(text)
    rules = (parse_line(x.removesuffix("\r"), i) for i, x in enumerate(lines))
    return [r for r in rules if r]


def matches(rules: list[IgnoreRule], path: str, is_dir: bool = False) -> bool:
    for r in reversed(rules):
        if r.regex and (is_dir or not r.dir_only) and re.match(r.regex, path):
            return not r.negate
    return False


def ignored(rules: list[IgnoreRule], path: str) -> bool:
    """Whether a scan skips a file: it or a directory above it matches; below an ignored directory nothing is looked at."""
    parts = path.split("/")
    return any(matches(rules, "/".join(parts[:i]), True) for i in range(1, len(parts))) or matches(rules, path)


def match_column(path: Column, is_dir: Column | bool, rules: list[IgnoreRule]) -> Column:
    """Match as a CASE over the rules from the last, so that evaluation stops at the winner."""
    is_dir = F.lit(is_dir) if isinstance(is_dir, bool) else is_dir
    out = None
    for r in reversed(rules):
        if not r.regex:
            continue
        hit = path.rlike(r.regex)
        hit = hit & is_dir if r.dir_only else hit
        out = F.when(hit, F.lit(not r.negate)) if out is None else out.when(hit, F.lit(not r.negate))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def top_ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """The top-most ignored directory above a file, or the file itself if it is ignored, else null."""
    seg = F.split(path, "/", -1)
    ups = F.transform(F.sequence(F.lit(1), F.size(seg)), lambda n: F.array_join(F.slice(seg, F.lit(1), n), "/"))
    # sequence's last entry is the file itself
    hits = F.filter(ups, lambda p, i: match_column(p, i < F.size(seg) - 1, rules))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1))


def ignored_bytes(files: DataFrame, rules: list[IgnoreRule]) -> DataFrame:
    """Ignored paths, a matched directory measured whole as one row."""
    got = files.withColumn("ignored", top_ignored(F.col("path"), rules)).where("ignored IS NOT NULL")
    return got.groupBy("ignored").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def match_paths(paths: DataFrame, pattern: str) -> DataFrame:
    """C14: paths that a lock pattern names; a plain path or a glob from the root."""
    body = glob_regex(pattern)
    return paths.where(F.lit(False) if body is None else F.col("path").rlike(f"^{body}$"))
