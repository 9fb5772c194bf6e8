import datetime as dt
import os
import random
import threading

import pytest

from quarrystone.errors import CorruptObject, Dirty, EngineError, InvalidStore, LockHeld, LockingDisabled, MalformedId, NotASpace, RefConflict, RefNotFound, SpaceBehind, UnsafePath, Usage
from quarrystone.operators.chunking import Params
from quarrystone.sources import worktree
from quarrystone.sources.store import Store, key_of_path, key_path
from quarrystone.workspace import IGNORE_FILE, Space

T0 = dt.datetime(2026, 8, 2, 14, 20, 31)
SMALL = Params(512, 9, 2048)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def write(root, files):
    for p, data in files.items():
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(data)


def read(root):
    out = {}
    for d, dirs, names in os.walk(root):
        dirs[:] = [x for x in dirs if x != worktree.STATE]
        for n in names:
            with open(os.path.join(d, n), "rb") as f:
                out[os.path.relpath(os.path.join(d, n), root)] = f.read()
    return out


def kinds(df):
    return {(r.kind, r.path_before, r.path_after) for r in df.collect()}


def test_scan_and_sinks(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"a.txt": b"x", ".dot": b"y", "_under/z": b"", "skip/deep/q": b"1", "d/keep": b"12"})
    os.symlink(os.path.join(root, "a.txt"), os.path.join(root, "link"))
    os.makedirs(os.path.join(root, worktree.STATE))
    got = {r.path: r.size for r in worktree.scan(spark, root, "skip/\n").collect()}
    assert got == {"a.txt": 1, ".dot": 1, "_under/z": 0, "d/keep": 2}
    for bad in ("../x", "/x", "a.txt/y", "link/x", "link", ""):
        with pytest.raises(UnsafePath):
            worktree.safe_join(root, bad)
    with pytest.raises(UnsafePath):
        worktree.safe_join(root, "con.txt", windows=True)
    worktree.remove_files(root, ["skip/deep/q", "d/keep"])
    assert not os.path.exists(os.path.join(root, "skip")) and not os.path.exists(os.path.join(root, "d"))
    assert worktree.relative(root, os.path.join(root, "d", "x")) == "d/x"
    assert key_of_path(key_path("chunk", "ab" * 32)) == ("chunk", "ab" * 32) and key_of_path("objects/chunk/x") is None


def test_refs_and_locks(spark, tmp_path):
    with pytest.raises(InvalidStore):
        Store(spark, str(tmp_path))
    s = Store.create(spark, str(tmp_path / "s"))
    won = []

    def race(i):
        try:
            s.swap_ref("local", "main", None, f"{i + 1:064x}")
            won.append(i)
        except RefConflict:
            pass

    threads = [threading.Thread(target=race, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and s.ref("local", "main") == f"{won[0] + 1:064x}"
    with pytest.raises(RefConflict):
        s.swap_ref("local", "main", None, "a" * 64)
    s.swap_ref("remote", "a/ref-x", None, "b" * 64)
    assert [tuple(r) for r in s.refs().collect()][1] == ("remote", "a/ref-x", "b" * 64)
    s.delete_ref("local", "main")
    with pytest.raises(RefNotFound):
        s.ref("local", "main")
    s.acquire("p/q", "ann", T0, "why")
    with pytest.raises(LockHeld):
        s.acquire("p/q", "ann", T0)
    s.transfer("p/q", "bob", at(1))
    r = s.locks().first()
    assert (r.owner, r.reason, r.broken_from) == ("bob", "why", "ann")
    s.release("p/q")
    s.release("p/q")
    assert s.locks().count() == 0 and s.settings() == {"locking": False, "lock_expiry_seconds": 14 * 86400}


def test_life_of_a_space(spark, tmp_path):
    root, rng = str(tmp_path / "w"), random.Random(4)
    big = rng.randbytes(30_000)
    files = {"a/big.bin": big, "a/copy.bin": big, "grün.txt": b"text " * 300, "empty": b"", ".dot": b"d", "tmp/x.tmp": b"no", IGNORE_FILE: b"*.tmp\n"}
    write(root, files)
    with pytest.raises(NotASpace):
        Space.open(spark, root)
    s = Space.init(spark, root, str(tmp_path / "store"), author="ann", params=SMALL)
    assert Space.open(spark, os.path.join(root, "a"), params=SMALL).root == s.root
    assert {r.status for r in s.status().collect()} == {"new"}
    with pytest.raises(Usage):
        s.commit(" ", at(0))
    one = s.commit("first", at(0))
    assert one.files == 6 and one.hashed == 6 and {r.status for r in s.status().collect()} == {"clean"}
    write(root, {"a/big.bin": big[:100] + b"!" + big[100:], "new": b"n"})
    os.rename(os.path.join(root, "grün.txt"), os.path.join(root, "moved.txt"))
    two = s.commit("second", at(1))
    assert two.hashed == 3 and two.new_objects < 14  # most chunks of the edited file were there
    assert kinds(s.diff(one.version, "main")) == {("changed", "a/big.bin", "a/big.bin"), ("renamed", "grün.txt", "moved.txt"), ("added", None, "new")}
    assert [r.version_id for r in s.log().collect()] == [two.version, one.version] and s.log(limit=1).count() == 1
    write(root, {"scratch": b"s" * 5000})
    snap = s.snapshot(at(2))
    assert snap.ref.startswith("snapshots/20260802T162031Z-") and [r.ref_name for r in s.timeline().collect()] == [snap.ref]
    promoted = s.promote(snap.ref, "keep", at(2))
    with pytest.raises(Usage):
        s.promote(promoted, "again", at(2))
    assert {r.verdict for r in s.check().collect()} == {"safe"}
    n = s.clear(at(3))
    assert n == 8 and set(read(root)) == {"tmp/x.tmp"}
    assert s.restore() == 8
    now = read(root)
    assert now["scratch"] == b"s" * 5000 and now["a/big.bin"][100:101] == b"!" and now["empty"] == b""
    written, gone = s.checkout(one.version[:12], at(4))
    back = read(root)
    assert {k: v for k, v in back.items() if k != "tmp/x.tmp"} == {k: v for k, v in files.items() if k != "tmp/x.tmp"} and gone == 3 and written == 2
    with pytest.raises(SpaceBehind):  # the base isn't the ref's version
        s.commit("third", at(5))
    s.checkout("main", at(5))
    s.commit("third", at(6))
    assert s.expire(at(24 * 400)) == [snap.ref]
    s.store.delete_ref("local", f"versions/{promoted[:8]}")
    dry = s.gc(at(24 * 400), dry_run=True)
    assert dry["deleted"] > 0 and s.gc(at(24 * 400)) == dry
    assert s.gc(at(24 * 400))["deleted"] == 0 and {r.verdict for r in s.check().collect()} == {"safe"}
    assert s.diff(one.version, "main").count() == 3


def test_lost_chunk_blocks_clear(spark, tmp_path):
    root = str(tmp_path / "w")
    write(root, {"a": random.Random(1).randbytes(5000), "b": b"b"})
    s = Space.init(spark, root, str(tmp_path / "store"), params=SMALL)
    s.commit("x", at(0))
    a = s.entries().where("path = 'a'").first().file_id
    chunk = s._decoded_files("file").where(f"file_id = '{a}'").first().chunk_id
    s.store.delete(spark.createDataFrame([("chunk", chunk)], "kind string, digest string"))
    assert {(r.path, r.verdict) for r in s.check().collect()} == {("a", "problem"), ("b", "safe")}
    with pytest.raises(Dirty):
        s.clear(at(1))
    assert set(read(root)) == {"a", "b"}
    os.unlink(os.path.join(root, "a"))
    with pytest.raises(Exception, match="content"):
        s.restore()


def test_two_spaces(spark, tmp_path):
    store = str(tmp_path / "store")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write(a, {"x": b"1", "y": b"1", "z": b"1"})
    ann = Space.init(spark, a, store, author="ann", params=SMALL)
    ann.commit("base", at(0))
    os.makedirs(b)
    bob = Space.init(spark, b, store, author="bob", params=SMALL)
    bob.checkout("main", at(1))
    write(a, {"x": b"ann", "y": b"ann"})
    os.unlink(os.path.join(a, "z"))
    ann.commit("ann's", at(2))
    write(b, {"x": b"bob", "w": b"bob"})
    with pytest.raises(SpaceBehind):
        bob.commit("bob's", at(3))
    got = bob.sync(at(3))
    assert got.conflicts == [("x", "both_changed")] and (got.written, got.removed) == (1, 1)
    assert read(b) == {"x": b"bob", "y": b"ann", "w": b"bob"} and bob.pending_conflicts() == ["x"]
    assert bob.sync(at(3)).written == 0
    with pytest.raises(LockingDisabled):
        ann.lock("x", at(4))
    ann.locking(True)
    assert ann.lock("x", at(4), "mine") == ["x"]
    with pytest.raises(LockHeld):
        bob.commit("bob's", at(5))
    with pytest.raises(LockHeld):
        bob.lock("x", at(5))
    with pytest.raises(LockHeld):
        bob.unlock("x")
    assert bob.apply_lock_attributes(at(5)) == 1 and ann.apply_lock_attributes(at(5)) == 0
    assert bob.lock("x", at(24 * 20)) == ["x"]  # expired
    assert [(r.path, r.now_owner) for r in ann.lost_locks().collect()] == [("x", "bob")]
    os.chmod(os.path.join(b, "x"), 0o644)
    bob.commit("bob's", at(24 * 20))
    assert bob.unlock("*") == ["x"] and bob.locks().count() == 0
    with pytest.raises(EngineError):
        bob.lock("nothing*", at(6))


def test_files_are_read_and_written_as_streams(spark, tmp_path):
    rng, root = random.Random(9), str(tmp_path / "w")
    files = {"big": rng.randbytes(3_000_000), "d/same": b"", "empty": b"", "small": b"x"}
    files["d/copy"] = files["big"]
    write(root, files)
    s = Space.init(spark, root, str(tmp_path / "s"), params=Params(16 << 10, 14, 64 << 10))
    assert {(r.path, r.bytes) for r in s._present().collect()} == {(p, len(x)) for p, x in files.items()}
    s.snapshot(T0)
    # a crash in a delete may leave a chunk twice; it is written once
    s.store.objects(data=True).where("kind = 'chunk'").limit(9).write.mode("append").partitionBy("kind", "prefix").parquet(os.path.join(s.store.path, "objects"))
    before = read(root)
    for p in files:
        os.unlink(os.path.join(root, p))
    assert s.restore() == 5 and read(root) == before
    assert not [n for _, _, names in os.walk(root) for n in names if n.startswith(".tmp-")]


def test_reads_and_checks_of_a_store(spark, tmp_path):
    """A clean store passes, all kinds in it; a changed object doesn't, whether it is read or checked."""
    from quarrystone.operators import storage

    root = str(tmp_path / "w")
    write(root, {f"f{i}": random.Random(i).randbytes(3000) for i in range(12)})
    s = Space.init(spark, root, str(tmp_path / "store"), params=SMALL)
    v = s.commit("x", at(0)).version
    assert {r.kind for r in s.store.objects().select("kind").distinct().collect()} == {"chunk", "file", "manifest", "version"}
    assert storage.verify(s.store.objects(data=True)).collect() == []
    chunk = s.store.objects().where("kind = 'chunk'").first().digest
    assert len(s.store.get("chunk", chunk)) > 0 and s.store.get("version", v).startswith(b"quarrystone-version")
    for kind, digest in (("version", "ab" * 32), ("chunk", "ac" * 32), ("file", "ad" * 32), ("manifest", "ae" * 32)):
        s.store.put(spark.createDataFrame([(kind, digest, bytearray(b"tampered"))], "kind string, digest string, data binary"), at(0))
        with pytest.raises(CorruptObject):
            s.store.get(kind, digest)
    assert {r.kind for r in storage.verify(s.store.objects(data=True)).collect()} == {"version", "chunk", "file", "manifest"}
    for zero in ("0" * 64, ""):
        with pytest.raises(MalformedId):
            s.store.swap_ref("local", "odd", None, zero)


def test_a_put_during_a_delete_stays(spark, tmp_path, monkeypatch):
    store = Store.create(spark, str(tmp_path / "s"))
    rows = [("chunk", f"{i % 2:02x}" + f"{i:062x}", bytearray(b"%d" % i)) for i in range(20)]
    frame = lambda some: spark.createDataFrame(some, "kind string, digest string, data binary")
    store.put(frame(rows[:10]), at(0))
    real = os.unlink
    late = []

    def unlink(path, *a, **k):  # between the read and the removal
        if not late and "objects" in str(path):
            late.append(store.put(frame(rows[10:]), at(1)))
        return real(path, *a, **k)

    monkeypatch.setattr(os, "unlink", unlink)
    store.delete(frame(rows[:4]).select("kind", "digest"))
    assert late == [10] and sorted(r.digest for r in store.objects().collect()) == sorted(d for _, d, _ in rows[4:])
    store.delete(frame(rows[:4]).select("kind", "digest"))
    assert store.objects().count() == 16 and {bytes(r.data) for r in store.objects(data=True).collect()} == {bytes(x) for _, _, x in rows[4:]}
