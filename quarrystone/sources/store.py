"""The object store: Parquet relations for objects, small atomic files for refs, locks and settings.

Objects live under ``objects/kind=<kind>/prefix=<two hex digits>``, so that a lookup by key
prunes to one folder.  A put anti-joins the keys that are there; Spark's commit protocol makes
each write whole or absent.  Refs, locks and settings are driver-side files: an exclusive
lock file orders writers, a rename publishes.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import fcntl
import json
import os
import re
import tempfile
import time
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrystone import schemas
from quarrystone.errors import CorruptObject, EngineError, InvalidStore, LockHeld, LockNotFound, MalformedId, ObjectNotFound, RefConflict, RefNotFound
from quarrystone.functions.ids import DEFAULT, Format, content_id
from quarrystone.functions.text import check_ref_name
from quarrystone.operators import codec
from quarrystone.operators.locks import effective_expiry

MARK = "quarrystone-store"
_OBJECTS = schemas.OBJECTS
_STORED = "digest string, size long, modified timestamp, data binary, kind string, prefix string"


def _atomic(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".tmp-")
    with os.fdopen(fd, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


@contextlib.contextmanager
def _exclusive(path: str, attempts: int = 200) -> Iterator[None]:
    """One holder of ``path`` among processes; the system frees it when its holder dies, and the file stays."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    held = os.open(path, os.O_CREAT | os.O_RDWR)
    try:
        for n in range(attempts):
            try:
                fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                time.sleep(min(0.1, 0.01 * (n + 1)))
        else:
            raise RefConflict(f"{path} stays locked")
        yield
    finally:
        os.close(held)


class Store:
    def __init__(self, spark: SparkSession, path: str, form: Format = DEFAULT):
        if not os.path.isfile(os.path.join(path, MARK)):
            raise InvalidStore(f"{path} holds no store")
        self.spark, self.path, self.form = spark, path, form

    @classmethod
    def create(cls, spark: SparkSession, path: str, form: Format = DEFAULT) -> Store:
        """A store in a new or empty folder, or the one that is there."""
        os.makedirs(path, exist_ok=True)
        if not os.path.exists(os.path.join(path, MARK)):
            if os.listdir(path):
                raise InvalidStore(f"{path} isn't empty")
            _atomic(os.path.join(path, MARK), "1\n")
        return cls(spark, path, form)

    # objects

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def objects(self, data: bool = False) -> DataFrame:
        """Every object, without its bytes unless asked for; a scan that leaves them on disk."""
        root = self._at("objects")
        if not os.path.isdir(root):
            df = self.spark.createDataFrame([], _OBJECTS)
        else:
            df = self.spark.read.schema(_STORED).parquet(root).select("kind", "digest", "size", "modified", "data", "prefix")
        return df if data else df.drop("data")

    def put(self, new: DataFrame, now: dt.datetime) -> int:
        """Writes the (kind, digest, data) that aren't there, once each; the number of rows written."""
        there = self.objects().select("kind", "digest")
        rows = new.dropDuplicates(["kind", "digest"]).join(there, ["kind", "digest"], "left_anti")
        rows = rows.select("digest", F.octet_length("data").cast("long").alias("size"), F.lit(now).cast("timestamp").alias("modified"), "data", "kind", F.substring("digest", 1, 2).alias("prefix"))
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("kind", "prefix").parquet(self._at("objects"))
        return seen.get["n"]

    def get(self, kind: str, digest: str) -> bytes:
        """A5: the bytes of an object, which are checked: by their digest, or, for lists of chunks, by their form."""
        got = self.objects(data=True).where((F.col("kind") == kind) & (F.col("prefix") == digest[:2]) & (F.col("digest") == digest)).select("data").limit(1).collect()
        if not got:
            raise ObjectNotFound(f"{kind} {digest}")
        data = bytes(got[0][0])
        if kind in ("file", "manifest"):
            try:
                codec.decode("file", data, self.form)
            except EngineError as e:
                raise CorruptObject(f"{kind} {digest}: {e}") from e
        elif content_id(kind, data, form=self.form) != digest:
            raise CorruptObject(f"{kind} {digest}")
        return data

    def delete(self, doomed: DataFrame) -> None:
        """Writes what stays of the files that hold doomed keys anew, then removes those files; idempotent.

        Files that a put adds meanwhile aren't touched, and nothing that stays is ever away; after
        a crash it may be there twice."""
        keys = doomed.select("kind", "digest").distinct()
        touched = [f"{r['kind']}/{r['prefix']}" for r in keys.select("kind", F.substring("digest", 1, 2).alias("prefix")).distinct().collect()]  # at most 6 * 256
        if not touched or not os.path.isdir(self._at("objects")):
            return
        here = self.objects(data=True).where(F.concat_ws("/", "kind", "prefix").isin(*touched))
        files = [r[0] for r in here.select("kind", "digest", F.input_file_name().alias("f")).join(keys, ["kind", "digest"], "left_semi").select("f").distinct().collect()]
        if not files:
            return
        old = self.spark.read.schema(_STORED).option("basePath", self._at("objects")).parquet(*files)
        stay = old.join(keys, ["kind", "digest"], "left_anti").dropDuplicates(["kind", "digest"])
        stay.select("digest", "size", "modified", "data", "kind", "prefix").write.mode("append").partitionBy("kind", "prefix").parquet(self._at("objects"))
        for f in files:
            path = unquote(urlparse(f).path)
            for x in (path, os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")):
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(x)

    # refs

    def _ref(self, scope: str, name: str) -> str:
        return self._at("refs", scope, quote(check_ref_name(name), safe=""))

    def ref(self, scope: str, name: str) -> str:
        try:
            with open(self._ref(scope, name)) as f:
                return f.read().strip()
        except FileNotFoundError as e:
            raise RefNotFound(name) from e

    def swap_ref(self, scope: str, name: str, old: str | None, new: str) -> None:
        """Sets a ref if it is what the caller saw last; of several writers exactly one wins."""
        if not new.strip("0"):
            raise MalformedId("a ref to no version")
        path = self._ref(scope, name)
        with _exclusive(self._at("lockfiles", f"{scope}-{quote(name, safe='')}")):
            now = None
            with contextlib.suppress(FileNotFoundError), open(path) as f:
                now = f.read().strip()
            if now != old:
                raise RefConflict(f"{name} is {now}, not {old}")
            _atomic(path, new + "\n")

    def delete_ref(self, scope: str, name: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(self._ref(scope, name))

    def refs(self) -> DataFrame:
        """All refs by name."""
        rows = []
        for scope in ("local", "remote"):
            root = self._at("refs", scope)
            for f in sorted(os.listdir(root) if os.path.isdir(root) else []):
                if not f.startswith(".tmp-"):
                    with open(os.path.join(root, f)) as h:
                        rows.append((scope, unquote(f), h.read().strip()))
        return self.spark.createDataFrame(rows, schemas.REFS)

    # locks and settings

    def _lock(self, path: str) -> str:
        return self._at("locks", quote(path, safe=""))

    def locks(self) -> DataFrame:
        return self.spark.createDataFrame([self._lock_row(x) for x in self.lock_list()], schemas.LOCKS)

    @staticmethod
    def _lock_row(x: dict) -> tuple:
        t = lambda v: dt.datetime.fromisoformat(v) if v else None
        return x["path"], x["owner"], t(x["since"]), x.get("reason"), x.get("broken_from"), t(x.get("broken_at"))

    def lock_list(self) -> list[dict]:
        root = self._at("locks")
        out = []
        for f in sorted(os.listdir(root) if os.path.isdir(root) else []):
            if not f.startswith(".tmp-"):
                with contextlib.suppress(FileNotFoundError), open(os.path.join(root, f)) as h:
                    out.append(json.load(h))
        return sorted(out, key=lambda x: x["path"].encode())

    def lock(self, path: str) -> dict:
        try:
            with open(self._lock(path)) as f:
                return json.load(f)
        except FileNotFoundError as e:
            raise LockNotFound(path) from e

    def acquire(self, path: str, owner: str, now: dt.datetime, reason: str = "") -> None:
        """Fails if anyone has the lock, the caller too."""
        with _exclusive(self._at("lockfiles", f"lock-{quote(path, safe='')}")):
            if os.path.exists(self._lock(path)):
                raise LockHeld(path)
            _atomic(self._lock(path), json.dumps({"path": path, "owner": owner, "since": now.isoformat(), "reason": reason or None}))

    def transfer(self, path: str, owner: str, now: dt.datetime, reason: str = "") -> None:
        """Takes a lock over, and remembers from whom; the reason stays unless a new one is given."""
        with _exclusive(self._at("lockfiles", f"lock-{quote(path, safe='')}")):
            old = self.lock(path)
            _atomic(self._lock(path), json.dumps({"path": path, "owner": owner, "since": now.isoformat(), "reason": reason or old.get("reason"), "broken_from": old["owner"], "broken_at": now.isoformat()}))

    def release(self, path: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(self._lock(path))

    def settings(self) -> dict:
        try:
            with open(self._at("settings")) as f:
                x = json.load(f)
        except FileNotFoundError:
            x = {}
        return {"locking": bool(x.get("locking", False)), "lock_expiry_seconds": effective_expiry(x.get("lock_expiry_seconds"))}

    def set_settings(self, locking: bool, lock_expiry_seconds: int | None = None) -> None:
        _atomic(self._at("settings"), json.dumps({"locking": locking, "lock_expiry_seconds": effective_expiry(lock_expiry_seconds)}))


def key_path(kind: str, digest: str) -> str:
    """A10: an object's place in a fanned-out folder."""
    return f"objects/{kind}/{digest[:2]}/{digest[2:4]}/{digest[4:]}"


def key_of_path(path: str) -> tuple[str, str] | None:
    """The inverse; null for a foreign file."""
    m = re.fullmatch(r"objects/(chunk|file|manifest|version|graph|signature)/([0-9a-f]{2})/([0-9a-f]{2})/([0-9a-f]{60})", path)
    return (m[1], m[2] + m[3] + m[4]) if m else None
