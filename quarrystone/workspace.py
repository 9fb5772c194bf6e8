"""The engine's verbs over a working tree and a store (J1-J14): each a composition of the operators.

Writes go in the order chunks, files, manifest, version, ref, so that a loser of the last step
leaves only objects that nothing refers to, which the collector's grace protects.  No verb
reads the clock: the time is a parameter.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone import schemas
from quarrystone.errors import Dirty, EngineError, LockHeld, LockingDisabled, NotASpace, RefNotFound, SpaceBehind, Usage
from quarrystone.functions import ignore, paths
from quarrystone.functions.ids import DEFAULT, ContentHasher, Format, content_id, content_ids
from quarrystone.functions.text import format_time
from quarrystone.operators import chunking, codec, history, locks, manifest, storage
from quarrystone.sources import worktree
from quarrystone.sources.store import Store, _atomic

SNAPSHOT_EXPIRY = dt.timedelta(days=182)
GRACE_HOURS = 1.0
IGNORE_FILE = ".ignore"
_PARTS = "path string, file_id string, size long, seq int, chunk_id string, length long, data binary"


def ingest(files: DataFrame, root: str, params: chunking.Params, form: Format) -> DataFrame:
    """Rows of (path) read by executors as streams, split and hashed in one pass: a row for each chunk, and one for the file, which
    alone has its id and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _PARTS.split(", ")]
        rows: list[tuple] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = iter(content_ids("chunk", parts, form=form))
            out = [r if r[-1] is None else (*r[:4], next(ids), *r[5:]) for r in rows]
            rows.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                whole = ContentHasher("file", form=form)
                with open(os.path.join(root, *path.split("/")), "rb") as f:
                    for seq, piece in enumerate(chunking.pieces(f.read, params, form)):
                        whole.update(piece)
                        rows.append((path, None, None, seq, None, len(piece), piece))
                        parts.append(piece)
                        size += len(piece)
                        if size > chunking.HASHED:
                            yield flush()
                            size = 0
                rows.append((path, whole.id(), whole.size, None, None, None, None))
        if rows:
            yield flush()

    return files.select("path").mapInArrow(run, _PARTS)


def identified(files: DataFrame, root: str, form: Format) -> DataFrame:
    """(path, file_id, size) of rows of (path), read by executors as streams; nothing is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path in b.column(0).to_pylist():
                whole = ContentHasher("file", form=form)
                with open(os.path.join(root, *path.split("/")), "rb") as f:
                    while part := f.read(chunking.HASHED):
                        whole.update(part)
                out.append((path, whole.id(), whole.size))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["path", "file_id", "size"])

    return files.select("path").mapInArrow(run, schemas.MANIFEST)


@dataclass
class Recorded:
    version: str
    ref: str
    files: int
    hashed: int
    new_objects: int


@dataclass
class Synced:
    written: int = 0
    removed: int = 0
    conflicts: list[tuple[str, str]] = field(default_factory=list)


class Space:
    """A working tree bound to a store."""

    def __init__(self, spark: SparkSession, root: str, params: chunking.Params = chunking.ASSETS, form: Format = DEFAULT):
        self.spark, self.root, self.params, self.form = spark, os.path.abspath(root), params, form
        config = self._load("config", None)
        if config is None:
            raise NotASpace(root)
        self.store, self.author, self.budget = Store(spark, config["store"], form), config["author"], config["budget"]

    # J1

    @classmethod
    def init(cls, spark: SparkSession, root: str, store: str, author: str = "user", budget: int = 0, ref: str = "main", **kw) -> Space:
        Store.create(spark, store)
        os.makedirs(os.path.join(root, worktree.STATE), exist_ok=True)
        at = os.path.join(root, worktree.STATE)
        _atomic(os.path.join(at, "config.json"), json.dumps({"store": os.path.abspath(store), "author": author, "budget": budget}))
        _atomic(os.path.join(at, "head.json"), json.dumps({"ref": ref, "version": None, "base": None}))
        return cls(spark, root, **kw)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **kw) -> Space:
        """The space that holds a folder: the nearest one upwards."""
        at = os.path.abspath(path)
        while not os.path.isfile(os.path.join(at, worktree.STATE, "config.json")):
            if os.path.dirname(at) == at:
                raise NotASpace(path)
            at = os.path.dirname(at)
        return cls(spark, at, **kw)

    # Local state; what can't be read is empty

    def _load(self, name: str, default):
        try:
            with open(os.path.join(self.root, worktree.STATE, f"{name}.json")) as f:
                return json.load(f)
        except (FileNotFoundError, ValueError):
            return default

    def _save(self, name: str, value) -> None:
        _atomic(os.path.join(self.root, worktree.STATE, f"{name}.json"), json.dumps(value))

    @property
    def head(self) -> dict:
        return self._load("head", {"ref": "main", "version": None, "base": None})

    def _cache(self) -> DataFrame:
        rows = self._load("cache", [])
        return self.spark.createDataFrame([tuple(r) for r in rows], schemas.CACHE)

    def rules(self) -> str:
        try:
            with open(os.path.join(self.root, IGNORE_FILE)) as f:
                return f.read()
        except FileNotFoundError:
            return ""

    def scan(self) -> DataFrame:
        return worktree.scan(self.spark, self.root, self.rules())

    # relations of the store

    def _decoded_files(self, kind: str) -> DataFrame:
        """(digest, seq, chunk_id, length) of file or manifest objects."""
        form = self.form

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, i, c, n) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (c, n) in enumerate(codec.decode("file", x, form).chunks)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.string(), pa.int64()], strict=True)], names=["file_id", "seq", "chunk_id", "length"])

        return self.store.objects(data=True).where(F.col("kind") == kind).select("digest", "data").mapInArrow(run, "file_id string, seq int, chunk_id string, length long")

    def versions(self) -> DataFrame:
        form = self.form

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.schema([("version_id", pa.string()), ("manifest_id", pa.string()), ("parents", pa.list_(pa.string())), ("author", pa.string()), ("time", pa.timestamp("us", "UTC")), ("expiry", pa.timestamp("us", "UTC")), ("graph_id", pa.string()), ("message", pa.string())])
            utc = lambda t: t and t.replace(tzinfo=dt.UTC)
            for b in batches:
                rows = []
                for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    v = codec.decode("version", x, form)
                    rows.append({"version_id": d, "manifest_id": v.manifest, "parents": list(v.parents), "author": v.author, "time": utc(v.time), "expiry": utc(v.expiry), "graph_id": v.graph, "message": v.message or None})
                yield pa.RecordBatch.from_pylist(rows, kind)

        return self.store.objects(data=True).where("kind = 'version'").select("digest", "data").mapInArrow(run, schemas.VERSIONS)

    def entries(self, manifests: DataFrame | None = None) -> DataFrame:
        """(manifest_id, path, file_id, size) of manifests, put together from their chunks by executors."""
        form = self.form
        parts = self._decoded_files("manifest")
        if manifests is not None:
            parts = parts.join(manifests.select(F.col("manifest_id").alias("file_id")), "file_id", "left_semi")
        whole = storage.reassembled(parts, self.store.objects(data=True).where("kind = 'chunk'").select(F.col("digest").alias("chunk_id"), "data"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for m, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if content_id("manifest", x, form=form) != m:
                        raise EngineError(f"manifest {m} is corrupt")
                    rows = [(m, *e) for e in codec.decode("manifest", x, form).entries]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["manifest_id", "path", "file_id", "size"])

        return whole.mapInArrow(run, schemas.MANIFEST_ENTRIES)

    def manifest_of(self, version: str | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], schemas.MANIFEST)
        v = codec.decode("version", self.store.get("version", version), self.form)
        return self.entries(self.spark.createDataFrame([(v.manifest,)], "manifest_id string")).select("path", "file_id", "size")

    def resolve(self, name: str) -> str:
        return history.resolve(name, self.versions(), self.store.refs())

    # J2-J4

    def _record_tree(self, now: dt.datetime) -> tuple[str, DataFrame, int, int, list]:
        """Scans, ingests what the cache doesn't vouch for, puts objects: manifest id, its entries, counters, the new cache."""
        state = manifest.status(self.scan(), self._cache()).where("status <> 'missing'")
        stat = self.scan().collect()
        fresh = {r["path"] for r in state.where("status <> 'clean'").select("path").collect()}
        parts = ingest(self.spark.createDataFrame([(p,) for p in sorted(fresh)], "path string").repartition(max(1, min(len(fresh), 4 * self.spark.sparkContext.defaultParallelism))), self.root, self.params, self.form).persist()
        try:
            n = self.store.put(parts.where("chunk_id IS NOT NULL").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("digest"), "data"), now)
            whole = parts.groupBy("path").agg(F.max("file_id").alias("file_id"), F.max("size").alias("size"), F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", "chunk_id", "length")))).alias("c"))
            n += self.store.put(self._file_objects(whole), now)
            files = whole.select("path", "file_id", "size").collect()
        finally:
            parts.unpersist()
        known = {r[0]: tuple(r) for r in self._load("cache", [])}
        cache, by_path = [], {r["path"]: r for r in files}
        for s in stat:
            p = s["path"]
            file_id = by_path[p]["file_id"] if p in by_path else known[p][3]
            cache.append((p, s["mtime_ns"], by_path[p]["size"] if p in by_path else s["size"], file_id))
        rows = manifest.build(self.spark.createDataFrame([(p, f, z) for p, _, z, f in cache], schemas.MANIFEST))
        m = codec.Manifest(tuple(sorted(((r["path"], r["file_id"], r["size"]) for r in rows.collect()), key=lambda e: e[0].encode())))
        text = codec.encode(m, self.form)
        ends = chunking.cuts(text, chunking.MANIFESTS, self.form)
        pieces = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        ids = content_ids("chunk", pieces, form=self.form)
        index = codec.encode(codec.File(len(text), tuple(zip(ids, map(len, pieces), strict=True))), self.form)
        manifest_id = content_id("manifest", text, form=self.form)
        n += self.store.put(self.spark.createDataFrame([*(("chunk", c, bytearray(x)) for c, x in zip(ids, pieces, strict=True)), ("manifest", manifest_id, bytearray(index))], "kind string, digest string, data binary"), now)
        return manifest_id, rows, len(fresh), n, cache

    def _file_objects(self, files: DataFrame) -> DataFrame:
        """The objects of files (file_id, size, chunks in order), encoded by executors."""
        form = self.form

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                texts = [codec.encode(codec.File(z, tuple((x["chunk_id"], x["length"]) for x in c)), form) for z, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(["file"] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["kind", "digest", "data"])

        return files.select("file_id", "size", "c").mapInArrow(run, "kind string, digest string, data binary")

    def _put_version(self, v: codec.Version, now: dt.datetime) -> str:
        data = codec.encode(v, self.form)
        vid = content_id("version", data, form=self.form)
        self.store.put(self.spark.createDataFrame([("version", vid, bytearray(data))], "kind string, digest string, data binary"), now)
        return vid

    def snapshot(self, now: dt.datetime, scope: str = "local") -> Recorded:
        m, _, hashed, n, cache = self._record_tree(now)
        vid = self._put_version(codec.Version(m, self.author, now, expiry=now + SNAPSHOT_EXPIRY), now)
        name = f"snapshots/{now:%Y%m%dT%H%M%SZ}-{vid[:8]}"
        with contextlib.suppress(RefNotFound):
            if self.store.ref(scope, name) == vid:
                return Recorded(vid, name, len(cache), hashed, n)
        self.store.swap_ref(scope, name, None, vid)
        self._save("head", {**self.head, "version": vid})
        self._save("cache", cache)
        return Recorded(vid, name, len(cache), hashed, n)

    def _ref_now(self, ref: str) -> str | None:
        try:
            return self.store.ref("local", ref)
        except RefNotFound:
            return None

    def commit(self, message: str, now: dt.datetime) -> Recorded:
        if not message.strip():
            raise Usage("a commit needs a message")
        head = self.head
        current = self._ref_now(head["ref"])
        if current != head["base"]:
            raise SpaceBehind(f"{head['ref']} has moved")  # M7
        m, rows, hashed, n, cache = self._record_tree(now)
        blocked = self.blocked(manifest.diff(self.manifest_of(head["base"]), rows), now)
        if blocked:
            raise LockHeld(", ".join(f"{p} by {o}" for p, o in blocked))
        vid = self._put_version(codec.Version(m, self.author, now, parents=(current,) if current else (), message=message), now)
        self.store.swap_ref("local", head["ref"], current, vid)
        self._save("head", {**head, "version": vid, "base": vid})
        self._save("cache", cache)
        return Recorded(vid, head["ref"], len(cache), hashed, n)

    def blocked(self, changes: DataFrame, now: dt.datetime) -> list[tuple[str, str]]:
        s = self.store.settings()
        foreign = locks.foreign_live(self.store.locks(), self.author, f"{now:%Y-%m-%d %H:%M:%S}", s["lock_expiry_seconds"], s["locking"])
        return [tuple(r) for r in locks.blocked(manifest.touched(changes), foreign).orderBy("path").collect()]

    # reports

    def status(self) -> DataFrame:
        return manifest.status(self.scan(), self._cache()).orderBy("path")

    def budget_state(self) -> DataFrame:
        return storage.budget(self.scan(), self.budget)

    def log(self, ref: str | None = None, limit: int = 0) -> DataFrame:
        return history.log(self.versions(), self.resolve(ref or self.head["ref"]), limit)

    def timeline(self) -> DataFrame:
        return history.timeline(self.store.refs(), self.versions())

    def diff(self, a: str, b: str) -> DataFrame:
        return manifest.diff(self.manifest_of(self.resolve(a)), self.manifest_of(self.resolve(b)))

    def promote(self, name: str, message: str, now: dt.datetime) -> str:
        """A deliberate version with a snapshot's manifest, no parent and a ref of its own."""
        if not message.strip():
            raise Usage("a promotion needs a message")
        v = codec.decode("version", self.store.get("version", self.resolve(name)), self.form)
        if v.message:
            raise Usage(f"{name} is deliberate already")
        vid = self._put_version(codec.Version(v.manifest, self.author, now, message=message), now)
        self.store.swap_ref("local", f"versions/{vid[:8]}", None, vid)
        return vid

    # J6-J8

    def _write(self, rows: list) -> int:
        """Writes (path, file_id, size) after all paths were looked at; size and content are verified.  A task writes a file
        chunk by chunk and names it when its content is found right, so files may be larger than memory."""
        for r in rows:
            worktree.safe_join(self.root, r["path"])
        if not rows:
            return 0
        want = self.spark.createDataFrame([(r["file_id"],) for r in rows], "file_id string").distinct()
        chunks = self._decoded_files("file").join(want, "file_id", "left_semi")
        stored = self.store.objects(data=True).where("kind = 'chunk'").select(F.col("digest").alias("chunk_id"), "data")
        asked = self.spark.createDataFrame([(r["path"], r["file_id"], r["size"]) for r in rows], schemas.MANIFEST)
        root, form = self.root, self.form

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (path, file_id, size), parts in storage.contents(batches, 3):
                worktree.write_file(root, path, checked(path, file_id, size, parts))
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

        def checked(path: str, file_id: str, size: int, parts: Iterator[tuple[int | None, bytes | None]]) -> Iterator[bytes]:
            whole = ContentHasher("file", form=form)
            for _, data in parts:
                whole.update(data or b"")
                yield data or b""
            if whole.size != size or whole.id() != file_id:
                raise EngineError(f"{path}: the store doesn't have its content")

        done = storage.in_order(asked.join(chunks, "file_id", "left"), stored, ["path", "file_id", "size"]).mapInArrow(run, "n long")
        return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _present(self) -> DataFrame:
        """(path, file_id, bytes), hashed anew, the cache ignored."""
        return identified(self.scan(), self.root, self.form).withColumnRenamed("size", "bytes")

    def check(self, scopes: tuple[str, ...] = ("local",)) -> DataFrame:
        """What may be removed: (path, file_id, verdict, missing_chunks)."""
        if self.head["version"]:
            self.store.get("version", self.head["version"])
        live = storage.reachable_versions(self.versions(), self.store.refs(), scopes)
        files = self.entries(self.versions().join(live, "version_id", "left_semi").select("manifest_id").distinct()).select("file_id")
        stored = self.store.objects().where("kind = 'chunk'").select(F.col("digest").alias("chunk_id"))
        return storage.clear_check(self._present(), files, self._decoded_files("file"), stored)

    def clear(self, now: dt.datetime, include_ignored: bool = False) -> int:
        """Records what isn't versioned, checks again, removes what is safe; any problem removes nothing."""
        rows = self.check().collect()
        if any(r["verdict"] == "unversioned" for r in rows):
            self.snapshot(now)
            rows = self.check().collect()
        if any(r["verdict"] != "safe" for r in rows):
            raise Dirty(", ".join(r["path"] for r in rows if r["verdict"] != "safe"))
        gone = [r["path"] for r in rows]
        if include_ignored:
            every = worktree.scan(self.spark, self.root, "")
            gone += [r["path"] for r in every.join(self.scan().select("path"), "path", "left_anti").collect() if r["path"] != IGNORE_FILE]
        worktree.remove_files(self.root, gone)
        self._save("cache", [])
        return len(gone)

    def restore(self) -> int:
        """Writes the files of the version that is checked out."""
        return self._write(self.manifest_of(self.head["version"]).collect())

    def checkout(self, name: str, now: dt.datetime) -> tuple[int, int]:
        """After the dirty check; the ref stays unless a ref was named, the base moves (Q14)."""
        vid = self.resolve(name)
        rows = self.check().collect()
        if any(r["verdict"] == "problem" for r in rows):
            raise Dirty(", ".join(r["path"] for r in rows if r["verdict"] == "problem"))
        if any(r["verdict"] == "unversioned" for r in rows):
            self.snapshot(now)
        wanted = self.manifest_of(vid)
        plan = manifest.checkout_plan(self._present().select("path", "file_id"), wanted)
        write = wanted.join(plan.where("action = 'write'").select("path"), "path", "left_semi").collect()
        gone = [r["path"] for r in plan.where("action = 'remove'").collect()]
        written = self._write(write)
        worktree.remove_files(self.root, gone)
        is_ref = self._ref_now(name) == vid if "/" not in name or not name.startswith("snapshots/") else False
        self._save("head", {"ref": name if is_ref else self.head["ref"], "version": vid, "base": vid})
        self._save("cache", [])
        return written, len(gone)

    # J9-J10

    def expire(self, now: dt.datetime, schedule: tuple[int, int, int] = history.SCHEDULE) -> list[str]:
        rows = history.retention(self.timeline(), f"{now:%Y-%m-%d %H:%M:%S}", schedule).where("NOT kept").select("ref_name").orderBy("ref_name").collect()
        for r in rows:
            for scope in ("local", "remote"):
                self.store.delete_ref(scope, r[0])
        return [r[0] for r in rows]

    def gc(self, now: dt.datetime, grace_hours: float = GRACE_HOURS, dry_run: bool = False) -> dict:
        """Marks from all refs, sweeps what is old enough; refs that moved meanwhile stop it."""
        refs = sorted(map(tuple, self.store.refs().collect()))
        reach = storage.reachable_objects(self.versions(), self.store.refs(), self.entries(), self._decoded_files("file"), self._decoded_files("manifest").withColumnRenamed("file_id", "manifest_id"))
        ages = self.store.objects().withColumn("age_hours", F.timestamp_diff("MICROSECOND", F.col("modified"), F.lit(now).cast("timestamp")) / 3.6e9)
        fates = storage.sweep(ages, reach, "age_hours", grace_hours).persist()
        try:
            result = storage.sweep_summary(fates).first().asDict()
            if sorted(map(tuple, self.store.refs().collect())) != refs:
                raise EngineError("refs moved during the mark")
            if not dry_run:
                self.store.delete(fates.where("fate = 'deleted'").select("kind", "digest"))
        finally:
            fates.unpersist()
        return result

    # J11

    def sync(self, now: dt.datetime) -> Synced:
        """Merges the tree onto the ref: writes what came in, keeps ours where both changed, and leaves their file as a copy."""
        head = self.head
        theirs_id = self._ref_now(head["ref"])
        if theirs_id is None or theirs_id == head["base"]:
            return Synced()
        _, ours, _, _, cache = self._record_tree(now)
        merged = manifest.merge(self.manifest_of(head["base"]), ours, self.manifest_of(theirs_id)).persist()
        rows = manifest.merged(merged)
        paths.check_collisions(rows)  # Q8
        plan = manifest.incoming(manifest.diff(ours, rows)).collect()
        clash = manifest.conflicts(merged).orderBy("path").collect()
        out = Synced(conflicts=[(r["path"], r["kind"]) for r in clash])
        writes = [r for r in plan if r["action"] == "write"]
        out.written = self._write(writes)
        gone = [r["path"] for r in plan if r["action"] == "remove" and r["path"] not in {w["path"] for w in writes}]
        worktree.remove_files(self.root, gone)
        out.removed = len(gone)
        at = f"{worktree.STATE}/conflicts"
        import shutil

        shutil.rmtree(os.path.join(self.root, at), ignore_errors=True)
        copies = [{"path": f"{at}/{r['path']}", "file_id": r["theirs_file"], "size": r["theirs_size"]} for r in clash if r["theirs_file"]]
        self._write(copies)
        merged.unpersist()
        self._save("head", {**head, "version": theirs_id, "base": theirs_id})
        self._save("cache", [c for c in cache if c[0] not in {r["path"] for r in plan}])
        return out

    def pending_conflicts(self) -> list[str]:
        at = os.path.join(self.root, worktree.STATE, "conflicts")
        return sorted(os.path.relpath(os.path.join(d, f), at).replace(os.sep, "/") for d, _, names in os.walk(at) for f in names)

    # J12

    def locking(self, on: bool, expiry_seconds: int | None = None) -> None:
        self.store.set_settings(on, expiry_seconds)

    def _matching(self, pattern: str) -> list[str]:
        known = self.scan().select("path").union(self.manifest_of(self.head["version"]).select("path")).distinct()
        got = [r["path"] for r in ignore.match_paths(known, pattern).orderBy("path").collect()]
        if not got:
            raise Usage(f"no file matches {pattern!r}")
        return got

    def lock(self, pattern: str, now: dt.datetime, reason: str = "", force: bool = False) -> list[str]:
        s = self.store.settings()
        if not s["locking"]:
            raise LockingDisabled(pattern)
        got = []
        for p in self._matching(pattern):
            try:
                self.store.acquire(p, self.author, now, reason)
            except LockHeld:
                old = self.store.lock(p)
                since = dt.datetime.fromisoformat(old["since"])
                if not force and (now - since).total_seconds() < s["lock_expiry_seconds"]:
                    raise
                self.store.transfer(p, self.author, now, reason)
            got.append(p)
        self._save("held", sorted({*self._load("held", []), *got}))
        return got

    def unlock(self, pattern: str, force: bool = False) -> list[str]:
        if not self.store.settings()["locking"]:
            raise LockingDisabled(pattern)
        regex = ignore.glob_regex(pattern)
        import re

        got = [x for x in self.store.lock_list() if x["path"] == pattern or regex and re.fullmatch(regex, x["path"])]
        if any(x["owner"] != self.author for x in got) and not force:
            raise LockHeld(", ".join(x["path"] for x in got if x["owner"] != self.author))
        for x in got:
            self.store.release(x["path"])
        self._save("held", sorted({*self._load("held", [])} - {x["path"] for x in got}))
        return [x["path"] for x in got]

    def locks(self) -> DataFrame:
        return self.store.locks().orderBy("path")

    def lost_locks(self) -> DataFrame:
        held = self.spark.createDataFrame([(p,) for p in self._load("held", [])], "path string")
        return locks.lost(held, self.store.locks(), self.author).orderBy("path")

    def apply_lock_attributes(self, now: dt.datetime) -> int:
        """Files that others have locked can't be written; the rest can."""
        s = self.store.settings()
        foreign = locks.foreign_live(self.store.locks(), self.author, f"{now:%Y-%m-%d %H:%M:%S}", s["lock_expiry_seconds"], s["locking"])
        rows = locks.read_only(self.scan(), foreign).collect()
        for r in rows:
            os.chmod(worktree.safe_join(self.root, r["path"]), 0o444 if r["read_only"] else 0o644)
        return sum(r["read_only"] for r in rows)


__all__ = ["Recorded", "Space", "Synced", "format_time", "identified", "ingest"]
