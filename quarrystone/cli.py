"""The command line (J14): ``python -m quarrystone <verb>``; every verb is one call of the workspace API."""

from __future__ import annotations

import argparse
import datetime as dt
import re
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrystone.errors import EngineError, Usage
from quarrystone.functions import text
from quarrystone.workspace import Space

VERSION = "0.1"
#: Verbs without arguments; what follows them is ignored.
PLAIN = ("status", "snapshot", "log", "snapshots", "expire", "restore", "sync", "locks", "version", "help")
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Usage(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="quarrystone")
    verbs = p.add_subparsers(dest="verb", required=True, parser_class=_Parser)

    def verb(name: str, *positional: str, message: bool = False, **flags: str) -> None:
        v = verbs.add_parser(name)
        for a in positional:
            v.add_argument(a)
        if message:
            v.add_argument("-m", dest="message", default="")
        for f, kind in flags.items():
            v.add_argument(f"--{f.replace('_', '-')}", dest=f, **({"action": "store_true"} if kind == "flag" else {"default": None}))

    for name in PLAIN:
        verb(name)
    verb("init", "store")
    verb("commit", message=True)
    verb("promote", "name", message=True)
    verb("checkout", "name")
    verb("diff", "before", "after")
    verb("gc", dry_run="flag")
    verb("check", verbose="flag")
    verb("clear", include_ignored="flag")
    verb("locking", "state", expiry="text")
    verb("lock", "pattern", message=True, force="flag")
    verb("unlock", "pattern", force="flag")
    return p


def seconds(duration: str | None) -> int | None:
    if duration is None:
        return None
    m = re.fullmatch(r"(\d+)([smhd])", duration)
    if not m:
        raise Usage(f"{duration!r} is no duration, like 12h or 14d")
    return int(m[1]) * _UNITS[m[2]]


def main(argv: list[str], spark: SparkSession, folder: str = ".", now: dt.datetime | None = None, out: Callable[[str], None] = print, **space) -> int:
    """Runs a verb; 0, or 2 for a usage error, or 1 for any other."""
    try:
        if not argv or argv[0] in ("-h", "--help"):
            argv = ["help"]
        if argv[0] == "space":  # the verbs on the space itself: space check, space clear
            if argv[1:2] not in (["check"], ["clear"]):
                raise Usage("space check or space clear")
            argv = argv[1:]
        a = parser().parse_args(argv[:1] if argv[0] in PLAIN else argv)
        _run(a, spark, folder, now or dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0), out, space)
    except Usage as e:
        out(f"usage: {e}")
        return 2
    except EngineError as e:
        out(f"{type(e).__name__}: {e}")
        return 1
    return 0


def _run(a: argparse.Namespace, spark: SparkSession, folder: str, now: dt.datetime, out: Callable[[str], None], space: dict) -> None:
    if a.verb == "version":
        return out(VERSION)
    if a.verb == "help":
        return out(parser().format_help())
    if a.verb == "init":
        Space.init(spark, folder, a.store, **space)
        return out(f"space with store {a.store}")
    s = Space.open(spark, folder, **{k: v for k, v in space.items() if k != "author"})
    if a.verb == "status":
        for r in s.lost_locks().collect():
            out(f"lost lock: {r.path} ({r.now_owner or 'nobody'})")
        for p in s.pending_conflicts():
            out(f"conflict: {p}")
        for r in s.status().where("status <> 'clean'").collect():
            out(f"{r.status} {r.path}")
    elif a.verb in ("snapshot", "commit"):
        got = s.snapshot(now) if a.verb == "snapshot" else s.commit(a.message, now)
        out(f"{got.version[:12]} {got.ref}: {got.files} files, {got.hashed} hashed, {got.new_objects} new objects")
        if a.verb == "snapshot" and s.budget:
            b = s.budget_state().first()
            out(f"{b.used} of {s.budget} bytes" + (", budget reached" if b.reached else ""))
    elif a.verb == "log":
        for r in s.log().collect():
            out(f"{r.version_id[:12]} {text.format_time(r.time)} {r.author}: {(r.message or '').splitlines()[0] if r.message else ''}")
    elif a.verb == "snapshots":
        for r in s.timeline().collect():
            out(f"{r.ref_name} {r.version_id[:12]} {text.format_time(r.time)} until {text.format_time(r.expiry) if r.expiry else '-'}")
    elif a.verb == "promote":
        out(s.promote(a.name, a.message, now)[:12])
    elif a.verb == "checkout":
        out("{} written, {} removed".format(*s.checkout(a.name, now)))
    elif a.verb == "diff":
        changes = s.diff(a.before, a.after)
        for r in changes.select(text.change_line(F.col("kind"), F.col("path_before"), F.col("path_after")).alias("line")).orderBy("line").collect():
            out(r.line)
    elif a.verb == "expire":
        for name in s.expire(now):
            out(name)
    elif a.verb == "gc":
        out(", ".join(f"{k} {v}" for k, v in s.gc(now, dry_run=a.dry_run).items()))
    elif a.verb == "check":
        rows = s.check().orderBy("path").collect()
        for r in rows:
            if a.verbose or r.verdict != "safe":
                out(f"{r.verdict} {r.path}")
        out(f"{sum(r.verdict == 'safe' for r in rows)} of {len(rows)} files are safe to remove")
    elif a.verb == "clear":
        out(f"{s.clear(now, a.include_ignored)} files removed")
    elif a.verb == "restore":
        out(f"{s.restore()} files written")
    elif a.verb == "sync":
        got = s.sync(now)
        out(f"{got.written} written, {got.removed} removed, {len(got.conflicts)} conflicts")
        for p, kind in got.conflicts:
            out(f"{kind} {p}")
    elif a.verb == "locking":
        if a.state not in ("on", "off", "status"):
            raise Usage("locking on, off or status")
        if a.state != "status":
            s.locking(a.state == "on", seconds(a.expiry))
        x = s.store.settings()
        out(f"locking {'on' if x['locking'] else 'off'}, expiry {x['lock_expiry_seconds']} s")
    elif a.verb == "lock":
        out("\n".join(s.lock(a.pattern, now, a.message, a.force)))
    elif a.verb == "unlock":
        out("\n".join(s.unlock(a.pattern, a.force)))
    elif a.verb == "locks":
        for r in s.lost_locks().collect():
            out(f"lost: {r.path} ({r.now_owner or 'nobody'})")
        for r in s.locks().collect():
            out(f"{r.path} {r.owner} since {text.format_time(r.since)}" + (f" ({r.reason})" if r.reason else ""))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()))
