"""Manifests (path, file_id, size): build, diff with renames, three-way merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.errors import CaseCollision, InvalidPath
from quarrystone.functions import paths
from quarrystone.scratch import written

from .ranking import HOT, ranked


def build(entries: DataFrame, check: bool = True) -> DataFrame:
    """Entries normalised to NFC; with ``check``, invalid, repeated and colliding paths are errors.

    ASCII paths are checked by one aggregate over their folded forms, without Python; where some
    path isn't ASCII, each check is an aggregate of its own.  One row at most reaches the driver."""
    entries = entries.select("path", "file_id", "size")
    if check:
        path = F.col("path")
        odd = F.coalesce(~path.rlike(r"^[\x00-\x7f]*$"), F.lit(False))
        group = entries.groupBy(paths.fold(path, ascii_only=True).alias("fold")).agg(F.count("*").alias("n"), F.min("path").alias("a"), F.max("path").alias("b"), F.max(odd).alias("odd"), F.min(F.when(paths.problem(path).isNotNull(), F.struct(F.coalesce("path", F.lit("")).alias("path"), paths.problem(path).alias("why")))).alias("bad"))
        seen = group.agg(F.max("odd").alias("odd"), F.min("bad").alias("bad"), F.min(F.when((F.col("n") > 1) & (F.col("a") == F.col("b")), F.col("a"))).alias("twice"), F.min(F.when(F.col("a") != F.col("b"), F.struct("a", "b"))).alias("clash")).first()
        if not seen["odd"]:
            if seen["bad"]:
                raise InvalidPath(f"{seen['bad']['path']!r}: {seen['bad']['why']}")
            if seen["twice"] is not None:
                raise CaseCollision(f"{seen['twice']!r} is there twice")
            if seen["clash"]:
                raise CaseCollision(f"{seen['clash']['a']!r} and {seen['clash']['b']!r}")
            return entries
    out = entries.select(paths.nfc("path").alias("path"), "file_id", "size")
    if check:
        bad = out.withColumn("why", paths.problem(F.col("path"))).where("why IS NOT NULL").limit(1).collect()
        if bad:
            raise InvalidPath(f"{bad[0]['path']!r}: {bad[0]['why']}")
        twice = out.groupBy("path").count().where("count > 1").limit(1).collect()
        if twice:
            raise CaseCollision(f"{twice[0]['path']!r} is there twice")
        paths.check_collisions(out)
    return out


def sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row for each path of either side, with both files and sizes; one full outer join on path."""
    b = before.select("path", F.col("file_id").alias("file_before"), F.col("size").alias("size_before"))
    a = after.select("path", F.col("file_id").alias("file_after"), F.col("size").alias("size_after"))
    return b.join(a, "path", "full_outer")


def rename_pairs(removed: DataFrame, added: DataFrame, hot: int = HOT) -> DataFrame:
    """The k-th removed and the k-th added path of each file, both in path order."""
    r = ranked(removed.select(F.col("path").alias("path_before"), "file_id", F.col("size").alias("size_before")), "file_id", "path_before", "k", hot)
    a = ranked(added.select(F.col("path").alias("path_after"), "file_id", F.col("size").alias("size_after")), "file_id", "path_after", "k", hot)
    return r.join(a, ["file_id", "k"])


_CHANGE = ("kind", "path_before", "path_after", "file_before", "file_after", "size_before", "size_after")


def diff(before: DataFrame, after: DataFrame, hot: int = HOT) -> DataFrame:
    """Changes from one manifest to another: added, removed, changed (by file, size ignored), renamed.

    A file that is still at its old path and new at another is added there.  Where the sides differ is
    written once, for the count of hot files and the three kinds of rows."""
    both = written(sides(before, after).where("file_before IS DISTINCT FROM file_after"), "differences")
    count = both.where("file_before IS NULL OR file_after IS NULL").groupBy(F.coalesce("file_before", "file_after").alias("file_id"), F.col("file_after").isNull().alias("removed")).count()
    heavy = {(r["removed"], r["file_id"]): r["count"] for r in count.where(F.col("count") > hot).collect()}
    of = lambda side: {k: n for (s, k), n in heavy.items() if s == side}
    changed = both.where("file_before IS NOT NULL AND file_after IS NOT NULL").select(F.lit("changed").alias("kind"), F.col("path").alias("path_before"), F.col("path").alias("path_after"), *_CHANGE[3:])
    removed = both.where("file_after IS NULL").select("path", F.col("file_before").alias("file_id"), F.col("size_before").alias("size"))
    added = both.where("file_before IS NULL").select("path", F.col("file_after").alias("file_id"), F.col("size_after").alias("size"))
    r = ranked(removed.withColumnsRenamed({"path": "path_before", "size": "size_before"}), "file_id", "path_before", "k", hot, heavy=of(True))
    a = ranked(added.withColumnsRenamed({"path": "path_after", "size": "size_after"}), "file_id", "path_after", "k", hot, heavy=of(False))
    moved = r.join(a, ["file_id", "k"], "full_outer").select(
        F.when(F.col("path_before").isNull(), "added").when(F.col("path_after").isNull(), "removed").otherwise("renamed").alias("kind"),
        "path_before", "path_after",
        F.when(F.col("path_before").isNotNull(), F.col("file_id")).alias("file_before"),
        F.when(F.col("path_after").isNotNull(), F.col("file_id")).alias("file_after"), "size_before", "size_after",
    )
    return changed.unionByName(moved)


def summary(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows of each kind."""
    return rows.groupBy(kind).agg(F.count("*").alias("n"))


def touched(changes: DataFrame) -> DataFrame:
    """Every path that a change touches, both ends of a rename among them."""
    return changes.select(F.explode(F.array_compact(F.array_distinct(F.array("path_before", "path_after")))).alias("path")).distinct()


def incoming(changes: DataFrame) -> DataFrame:
    """What a sync writes (added, changed and renamed-to paths) and removes (removed and renamed-from paths)."""
    write = changes.where("path_after IS NOT NULL").select(F.lit("write").alias("action"), F.col("path_after").alias("path"), F.col("file_after").alias("file_id"), F.col("size_after").alias("size"))
    gone = changes.where("kind IN ('removed', 'renamed')").select(F.lit("remove").alias("action"), F.col("path_before").alias("path"), F.col("file_before").alias("file_id"), F.col("size_before").alias("size"))
    return write.unionByName(gone)


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row for each path of any side with the merged file (null: gone) and the conflict, if any.

    Files are compared, sizes ignored.  Two full outer joins on path; both keep its partitioning."""
    side = lambda df, s: df.select("path", F.col("file_id").alias(f"{s}_file"), F.col("size").alias(f"{s}_size"))
    m = side(base, "base").join(side(ours, "ours"), "path", "full_outer").join(side(theirs, "theirs"), "path", "full_outer")
    b, o, t = F.col("base_file"), F.col("ours_file"), F.col("theirs_file")
    same = o.eqNullSafe(t)
    conflict = (
        F.when(same | o.eqNullSafe(b) | t.eqNullSafe(b), None)
        .when(b.isNull(), "both_added")
        .when(t.isNull(), "changed_here_deleted_there")
        .when(o.isNull(), "deleted_here_changed_there")
        .otherwise("both_changed")
    )
    # ours stays unless only they changed it, or we deleted what they changed
    take_theirs = ~same & (o.eqNullSafe(b) | (o.isNull() & ~t.eqNullSafe(b)))
    return m.select(
        "path", F.when(take_theirs, t).otherwise(o).alias("file_id"), F.when(take_theirs, F.col("theirs_size")).otherwise(F.col("ours_size")).alias("size"),
        conflict.alias("conflict"), "ours_file", "ours_size", "theirs_file", "theirs_size",
    )


def merged(rows: DataFrame) -> DataFrame:
    return rows.where("file_id IS NOT NULL").select("path", "file_id", "size")


def conflicts(rows: DataFrame) -> DataFrame:
    return rows.where("conflict IS NOT NULL").select("path", F.col("conflict").alias("kind"), "ours_file", "ours_size", "theirs_file", "theirs_size")


def status(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """New, missing, modified or clean by size and time, without reading content."""
    s = scan.select("path", F.col("size").alias("scan_size"), F.col("mtime_ns").alias("scan_mtime"))
    c = cache.select("path", F.col("size").alias("cache_size"), F.col("mtime_ns").alias("cache_mtime"))
    kind = (
        F.when(F.col("cache_size").isNull(), "new").when(F.col("scan_size").isNull(), "missing")
        .when((F.col("scan_size") == F.col("cache_size")) & (F.col("scan_mtime") == F.col("cache_mtime")), "clean").otherwise("modified")
    )
    return s.join(c, "path", "full_outer").select("path", kind.alias("status"), "scan_size", "cache_size")


def fresh(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """Scanned files that the cache doesn't vouch for, which have to be read."""
    c = cache.select("path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"))
    met = scan.join(c, "path", "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime"))
    return met.where(~F.coalesce(same, F.lit(False))).drop("_size", "_mtime")


def recorded(scan: DataFrame, cache: DataFrame, hashed: DataFrame) -> DataFrame:
    """The entries of a tree: files as they were hashed (path, file_id), the others' from the cache."""
    known = cache.select("path", F.col("file_id").alias("_cached")).join(hashed.select("path"), "path", "left_anti")
    met = scan.select("path", "size").join(hashed.select("path", "file_id"), "path", "left").join(known, "path", "left")
    return met.select("path", F.coalesce("file_id", "_cached").alias("file_id"), "size")


def sync_result(rows: DataFrame) -> DataFrame:
    """Of merge(): files written and removed here, conflicts, and bytes written."""
    write = F.col("file_id").isNotNull() & ~F.col("file_id").eqNullSafe(F.col("ours_file"))
    return rows.agg(
        F.count_if(write).alias("written"), F.count_if(F.col("file_id").isNull() & F.col("ours_file").isNotNull()).alias("removed"), F.count_if(F.col("conflict").isNotNull()).alias("conflicts"),
        F.coalesce(F.sum(F.when(write, F.col("size"))), F.lit(0)).cast("long").alias("bytes_written"),
    )


def restore_plan(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Files of a manifest that aren't in the tree or have another size there."""
    met = wanted.join(present.select("path", F.col("size").alias("_size")), "path", "left")
    return met.where("_size IS NULL OR _size <> size").select("path", "file_id", "size", F.col("_size").isNull().alias("missing"))


def extra(present: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files that a checkout removes."""
    return present.join(wanted.select("path"), "path", "left_anti")


def checkout_plan(present: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a checkout writes, keeps and removes, by path and file."""
    p = present.select("path", F.col("file_id").alias("have"))
    w = wanted.select("path", F.col("file_id").alias("want"), "size")
    action = F.when(F.col("want").isNull(), "remove").when(F.col("have").eqNullSafe(F.col("want")), "keep").otherwise("write")
    return p.join(w, "path", "full_outer").select("path", action.alias("action"), F.coalesce("want", "have").alias("file_id"))


def unsorted(entries: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Groups whose values aren't strictly ascending by position, with the first offence."""
    from pyspark.sql import Window

    prev = F.lag(value).over(Window.partitionBy(group).orderBy(position))
    return entries.withColumn("_prev", prev).where(F.col("_prev") >= F.col(value)).groupBy(group).agg(F.min(position).alias("first_offence"), F.count("*").alias("offences"))
