import datetime as dt
import itertools
import os
import random

import pytest

from quarrystone import schemas
from quarrystone.errors import CaseCollision, InvalidIgnore, InvalidPath, InvalidRefName, RefNotFound
from quarrystone.functions import ignore, paths, text
from quarrystone.operators import codec, history, locks, manifest, ranking, storage


def table(spark, rows, schema=schemas.MANIFEST):
    return spark.createDataFrame(rows, schema)


def entries(spark, d):
    return table(spark, [(p, f, 1) for p, f in d.items()])


@pytest.mark.parametrize("p", ["a", "a/b.txt", "grün/ß", ".hidden"])
def test_good_paths(p):
    assert paths.normalize(p) == p
    assert paths.normalize("grün") == "grün"


@pytest.mark.parametrize("p", ["", "/a", "a/", "a//b", ".", "a/./b", "../a", "a/..", "a\\b", "a\tb", "a\nb", "a\x7f", "\x00", "a/\ud800"])
def test_bad_paths(p, spark):
    with pytest.raises(InvalidPath):
        paths.normalize(p)
    if "\ud800" not in p:
        assert table(spark, [(p,)], "path string").select(paths.problem(paths.F.col("path"))).first()[0] is not None


def test_collisions_and_reserved(spark):
    df = table(spark, [(p,) for p in ("STRASSE", "straße", "grün", "grun", "a", "A", "a")], "path string")
    assert {r.fold for r in paths.collisions(df).collect()} == {"strasse", "a"}
    with pytest.raises(CaseCollision):
        paths.check_collisions(df)
    names = {"con": True, "x/NUL.txt": True, "x/com9": True, "com10": False, "a.": True, "b /c": True, "icon": False}
    got = table(spark, [(p,) for p in names], "path string").withColumn("r", paths.is_reserved(paths.F.col("path"))).collect()
    assert {r.path: r.r for r in got} == names == {p: paths.is_reserved_name(p) for p in names}


def test_ref_names(spark):
    good, bad = ["main", "a/b", "a.b-c_d", "x" * 200, "ref-x"], ["", "x" * 201, "a//b", "/a", "a/", ".", "a/..", "a.lock", "a b", "ä"]
    got = table(spark, [(n,) for n in good + bad], "n string").select("n", text.ref_name_ok(text.F.col("n")).alias("ok")).collect()
    assert {r.n: r.ok for r in got} == {n: n in good for n in good + bad}
    for n in bad:
        with pytest.raises(InvalidRefName):
            text.check_ref_name(n)


IGNORE = "﻿# comment\n*.tmp\n!keep.tmp\nbuild/\n/top.txt\ndocs/**/draft\nexports/**\n!exports/final/\n[bad\nx[0-9]y?\n"
CASES = {
    "a.tmp": True, "d/a.tmp": True, "d/keep.tmp": False, "build/x": True, "d/build/x": True, "build": False, "top.txt": True, "d/top.txt": False,
    "docs/draft": True, "docs/a/b/draft": True, "docs/a/draft/x": True, "exports/x": True, "exports/final/x": True, "[bad": False, "x5yz": True, "x5y/z": False, "xay1": False,
}


def test_ignore(spark):
    rules = ignore.parse(IGNORE)
    assert {p: ignore.ignored(rules, p) for p in CASES} == CASES
    df = table(spark, [(p, 1) for p in CASES], "path string, size long")
    got = {r.path: r.top for r in df.withColumn("top", ignore.top_ignored(df.path, rules)).collect()}
    assert {p: t is not None for p, t in got.items()} == CASES and got["exports/final/x"] == "exports" and got["d/build/x"] == "d/build"
    flat = {r.path: r.m for r in df.withColumn("m", ignore.match_column(df.path, False, rules)).collect()}
    assert flat == {p: ignore.matches(rules, p) for p in CASES}
    assert {r.ignored: r.files for r in ignore.ignored_bytes(df, rules).collect()}["exports"] == 2
    assert ignore.match_column(df.path, False, []) is not None and ignore.glob_regex("[]a]") is None and ignore.glob_regex("a\\") is None
    with pytest.raises(InvalidIgnore):
        ignore.parse("/\n")


def plain_diff(before, after):
    out, rem, add = set(), {}, {}
    for p in before.keys() & after.keys():
        if before[p] != after[p]:
            out.add(("changed", p, p))
    for p in sorted(before.keys() - after.keys()):
        rem.setdefault(before[p], []).append(p)
    for p in sorted(after.keys() - before.keys()):
        add.setdefault(after[p], []).append(p)
    for f in rem.keys() | add.keys():
        for r, a in itertools.zip_longest(rem.get(f, []), add.get(f, [])):
            out.add(("renamed" if r and a else "removed" if r else "added", r, a))
    return out


def test_diff(spark):
    rng = random.Random(1)
    for _ in range(3):
        side = lambda: {f"p{rng.randrange(60)}": f"f{rng.randrange(12)}" for _ in range(40)}  # noqa: B023, E731
        b, a = side(), side()
        for hot in (10**6, 2):
            got = {(r.kind, r.path_before, r.path_after) for r in manifest.diff(entries(spark, b), entries(spark, a), hot).collect()}
            assert got == plain_diff(b, a)
    same = entries(spark, {"a": "x"})
    assert manifest.diff(same, same).count() == 0
    copy = manifest.diff(same, entries(spark, {"a": "x", "b": "x"})).collect()
    assert [(r.kind, r.path_after) for r in copy] == [("added", "b")]


def test_ranks_of_hot_keys(spark):
    rows = [("hot", f"{i * 7919 % 1000:04d}") for i in range(1000)] + [("cold", "x"), ("cold", "a"), (None, "q")]
    got = ranking.ranked(table(spark, rows, "k string, o string"), "k", "o", "n", hot=100, piece=90).collect()
    assert sorted((r.o, r.n) for r in got if r.k == "hot") == [(f"{i:04d}", i + 1) for i in range(1000)]
    assert {(r.k, r.o, r.n) for r in got if r.k != "hot"} == {("cold", "a", 1), ("cold", "x", 2), (None, "q", 1)}


MERGES = [
    (None, None, None, None, None), ("X", None, None, None, None), (None, "Y", None, "Y", None), (None, None, "Z", "Z", None), (None, "Y", "Y", "Y", None), (None, "Y", "Z", "Y", "both_added"),
    ("X", "Y", "Y", "Y", None), ("X", "X", "X", "X", None), ("X", "X", "Z", "Z", None), ("X", "Y", "X", "Y", None), ("X", "Y", "Z", "Y", "both_changed"), ("X", "X", None, None, None),
    ("X", "Y", None, "Y", "changed_here_deleted_there"), ("X", None, "X", None, None), ("X", None, "Z", "Z", "deleted_here_changed_there"),
]


def test_merge(spark):
    side = lambda k: entries(spark, {f"p{i:02d}": m[k] for i, m in enumerate(MERGES) if m[k]})
    rows = manifest.merge(side(0), side(1), side(2))
    got = {r.path: (r.file_id, r.conflict) for r in rows.collect()}
    assert got == {f"p{i:02d}": m[3:] for i, m in enumerate(MERGES) if any(m[:3])}
    assert manifest.merged(rows).count() == sum(m[3] is not None for m in MERGES) and manifest.conflicts(rows).count() == 4


def test_build(spark):
    assert manifest.build(entries(spark, {"grün": "f"})).first().path == "grün"
    for bad, error in (({"a": "f", "A": "g"}, CaseCollision), ({"/a": "f"}, InvalidPath)):
        with pytest.raises(error):
            manifest.build(entries(spark, bad))
    with pytest.raises(CaseCollision):
        manifest.build(table(spark, [("a", "f", 1), ("a", "g", 1)]))


def test_retention(spark):
    now = dt.datetime(2026, 8, 2, 12)
    ago = lambda **k: now - dt.timedelta(**k)
    times = [ago(minutes=10), ago(minutes=20), ago(minutes=30), ago(hours=30), ago(hours=34), ago(days=40), ago(days=41), ago(days=200)]
    df = table(spark, [(f"s{i}", t) for i, t in enumerate(times)], "ref_name string, time timestamp_ntz")
    got = {r.ref_name: (r.bucket, r.kept) for r in history.retention(df, "2026-08-02 12:00:00").collect()}
    assert sorted(n for n, (_, k) in got.items() if k) == ["s0", "s3", "s5"] and got["s7"] == (None, False)
    edge = table(spark, [("f1", ago(minutes=-5)), ("f2", ago(minutes=-5)), ("h", ago(hours=24)), ("d", ago(hours=24, seconds=1)), ("w", ago(days=182)), ("x", ago(days=182, seconds=1)), ("n", dt.datetime(2027, 1, 1))], "ref_name string, time timestamp_ntz")
    got = {r.ref_name: (r.bucket, r.kept) for r in history.retention(edge, "2026-08-02 12:00:00").collect()}
    assert got["f2"] == ("future/2026-08-02T12:05:00Z", True) and not got["f1"][1] and got["h"][0] == "hour/2026-08-01T12" and got["d"][0] == "day/2026-08-01" and got["w"][0].startswith("week/") and got["x"][0] is None


def test_closures(spark):
    rng = random.Random(3)
    edges = {(i, rng.randrange(i)) for i in range(1, 60)} | {(i, rng.randrange(i)) for i in range(1, 60)}
    depth, todo = {59: 0}, [59]
    for n in todo:
        for s, t in sorted(edges):
            if s == n and t not in depth:
                depth[t] = depth[n] + 1
                todo.append(t)
    got = history.closure(table(spark, [(59,)], "node int"), table(spark, sorted(edges), "source int, target int"))
    assert {r.node: r.depth for r in got.collect()} == depth
    chain = table(spark, [(i, i - 1 if i else None) for i in range(20)], "node int, parent int")
    walked = history.chain_closure(chain, table(spark, [(19,), (4,)], "node int"))
    assert {(r.root, r.node, r.depth) for r in walked.collect()} == {(r, n, r - n) for r in (19, 4) for n in range(r + 1)}


def test_log_and_resolve(spark):
    h = lambda c: c * 64
    parents = {h("d"): [h("c"), h("b")], h("c"): [h("a")], h("b"): [h("a")], h("a"): [], "d" * 10 + "e" * 54: []}
    t = dt.datetime(2026, 1, 1)
    v = table(spark, [(k, h("9"), p, "x", t, None, None, "m") for k, p in parents.items()], schemas.VERSIONS)
    assert [r.version_id[0] for r in history.log(v, h("d")).collect()] == ["d", "c", "b", "a"]
    assert [r.version_id[0] for r in history.log(v, h("d"), 2).collect()] == ["d", "c"]
    refs = table(spark, [("local", "main", h("d")), ("remote", "old", "d" * 10 + "e" * 54)], schemas.REFS)
    ok = {"main": h("d"), h("b"): h("b"), "a" * 8: h("a"), "d" * 12: h("d")}
    assert {n: history.resolve(n, v, refs) for n in ok} == ok
    for bad in ("a" * 7, "A" * 8, "d" * 9, "nothing", "f" * 64):
        with pytest.raises(RefNotFound):
            history.resolve(bad, v, refs)


def test_locks(spark):
    now, t = "2026-08-15 12:00:00", dt.datetime(2026, 8, 1, 12)
    df = table(spark, [("a", "me", t), ("b", "you", t), ("c", "you", t + dt.timedelta(seconds=1))], "path string, owner string, since timestamp_ntz")
    names = lambda d: sorted(r.path for r in d.collect())
    assert names(locks.foreign_live(df, "me", now)) == ["c"] and names(locks.foreign_live(df, "me", now, 10**7)) == ["b", "c"] and names(locks.foreign_live(df, "me", now, enabled=False)) == []
    held = table(spark, [("a",), ("b",), ("z",)], "path string")
    assert {(r.path, r.now_owner) for r in locks.lost(held, df, "me").collect()} == {("b", "you"), ("z", None)}
    assert names(locks.forget(held, held.limit(0))) == ["a", "b", "z"] and names(locks.remember(held, df)) == ["a", "b", "c", "z"]
    assert locks.effective_expiry(None) == locks.effective_expiry(-5) == 14 * 86400


def test_store_reports(spark):
    fc = table(spark, [("f", 1, "a", 10), ("f", 2, "b", 5), ("g", 1, "a", 10), ("h", 1, "c", 0)], "file_id string, seq int, chunk_id string, length long")
    assert {(r.file_id, r.seq, r.offset) for r in storage.offsets(fc).collect()} == {("f", 1, 0), ("f", 2, 10), ("g", 1, 0), ("h", 1, 0)}
    files = table(spark, [("f", 15), ("g", 9), ("h", 0), ("e", 0)], "file_id string, size long")
    assert {r.file_id for r in storage.file_faults(files, fc).collect()} == {"g", "h"}
    r = storage.dedup_report(fc).first()
    assert (r.chunks, r.distinct_chunks, r.total_bytes, r.unique_bytes, r.shared_chunks) == (4, 3, 25, 15, 1)
    r = storage.new_bytes(fc.where("file_id = 'f'"), fc.where("file_id <> 'f'")).first()
    assert (r.shared_chunks, r.new_chunks, r.new_bytes, r.gone_chunks) == (1, 1, 0, 1)
    present = table(spark, [("1", "f"), ("2", "f"), ("3", "g"), ("4", "u")], "path string, file_id string")
    got = storage.clear_check(present, files, fc, table(spark, [("a",)], "chunk_id string")).collect()
    assert {(r.path, r.verdict, r.missing_chunks) for r in got} == {("1", "problem", 1), ("2", "problem", 1), ("3", "safe", 0), ("4", "unversioned", 0)}
    keys = table(spark, [(0, "a"), (1, "x"), (2, "a")], "pos int, chunk_id string")
    assert [r.present for r in storage.exists(keys, fc, ["chunk_id"]).orderBy("pos").collect()] == [True, False, True]


def test_catalogue_has_sql():
    import __spark_entry__

    from quarrystone.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"cdc_chunks", "cdc_dedup", "blake3_ids"}


def test_catalogue_equals_duckdb(spark):
    import duckdb

    from quarrystone.plans import catalogue

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{sf}/{f}'")
    key = lambda t: tuple((x is None, str(x)) for x in t)
    wrong = []
    more = [n for n, q in catalogue.queries().items() if q.__module__.endswith("workflows")]
    assert len(more) >= 25 and all(n in catalogue.oracle_sql() for n in more)
    for name in (*more, "manifest_build", "gc_sweep", "log_walk", "version_closure", "manifest_diff", "merge3", "sync_plan", "status", "retention_keep", "resolve_prefix", "dirty_check", "ignored_bytes", "path_validate", "human_bytes", "manifest_encode"):
        want = con.sql(catalogue.oracle_sql()[name])
        got = [tuple(r[c] for c in want.columns) for r in catalogue.queries()[name](spark, sf).collect()]
        if sorted(got, key=key) != sorted(want.fetchall(), key=key):
            wrong.append(name)
    assert not wrong


def test_verify_and_scrub(spark):
    from quarrystone.functions.ids import content_id

    parts = {"p": b"hello ", "q": b"world"}
    chunks = table(spark, [(k, len(v), bytearray(v)) for k, v in parts.items()], schemas.CHUNKS)
    whole, other = content_id("file", b"hello world"), content_id("file", b"other")
    fc = table(spark, [(whole, 0, "p", 0, 6), (whole, 1, "q", 6, 5), (other, 0, "q", 0, 5), ("x", 0, "gone", 0, 3), ("y", 0, "p", 0, 9)], schemas.FILE_CHUNKS)
    assert {r.file_id: bytes(r.data) for r in storage.reassembled(fc, chunks).collect()}[whole] == b"hello world"
    assert {r.file_id: r.reason for r in storage.scrub(fc, chunks).collect()} == {other: "content", "x": "missing chunk", "y": "size"}
    objects = table(spark, [("chunk", content_id("chunk", b"a"), bytearray(b"a")), ("version", content_id("chunk", b"a"), bytearray(b"a")), ("file", other, bytearray(b"text"))], "kind string, digest string, data binary")
    listed = bytearray(codec.encode(codec.File(11, (("a" * 64, 6), ("b" * 64, 5)))))
    good = table(spark, [("file", whole, listed), ("manifest", whole, listed), ("chunk", content_id("chunk", b""), bytearray())], "kind string, digest string, data binary")
    assert {(r.kind, r.digest) for r in storage.verify(objects.union(good)).collect()} == {("version", content_id("chunk", b"a")), ("file", other)}


def test_reach_of_any_graph(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 100)]
    rings = [(200, 201), (201, 202), (202, 200), (202, 210)]
    bush = [(300 + i, 300 + rng.randrange(i + 1, i + 40)) for i in range(60) for _ in range(2)]
    edges = chain + rings + bush
    df = spark.createDataFrame([*edges, (900, None)], "node long, parent long")
    for roots in ([0], [50, 201], [300, 7, 900], [12345], []):
        seen, todo = set(roots), list(roots)
        while todo:
            n = todo.pop()
            for a, b in edges:
                if a == n and b not in seen:
                    seen.add(b)
                    todo.append(b)
        got = [r.node for r in history.reach(spark.createDataFrame([(r,) for r in roots], "node long"), df, source="node", target="parent").collect()]
        assert sorted(got) == sorted(seen)
