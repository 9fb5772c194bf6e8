"""History: closures over parents, log, prefix resolution, timeline and retention."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.errors import RefNotFound
from quarrystone.scratch import counted, written

#: Levels of a walk that are planned as one query before its result is written; parts that are read apart before they are written as one.
LEVELS, PARTS = 4, 8


def closure(roots: DataFrame, edges: DataFrame, node: str = "node", source: str = "source", target: str = "target", limit: int | None = None) -> DataFrame:
    """Every node reachable from ``roots`` with its least depth (0: a root).

    A round joins LEVELS levels of edges to the frontier, drops what was seen and is written, so
    that plans stay short and a lost executor costs one round."""
    e = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_t IS NOT NULL").distinct()
    seen = written(roots.select(F.col(node)).distinct().withColumn("depth", F.lit(0)), "reach")
    parts, frontier, depth = [seen], seen.select(node), 0
    while limit is None or depth < limit:
        steps, level = [], frontier
        for _ in range(LEVELS if limit is None else min(LEVELS, limit - depth)):
            depth += 1
            level = level.join(e, F.col(node) == F.col("_s")).select(F.col("_t").alias(node)).distinct()
            steps.append(level.withColumn("depth", F.lit(depth)))
        known = reduce(DataFrame.union, parts).select(node)
        new = reduce(DataFrame.union, steps).groupBy(node).agg(F.min("depth").alias("depth")).join(known, node, "left_anti")
        new = written(new, "reach")
        parts.append(new)
        if len(parts) > PARTS:
            parts = [written(reduce(DataFrame.union, parts), "reach")]
        frontier = new.where(F.col("depth") == depth).select(node)
        if frontier.isEmpty():
            break
    return reduce(DataFrame.union, parts)


def reach(roots: DataFrame, edges: DataFrame, node: str = "node", source: str = "source", target: str = "target") -> DataFrame:
    """Every node reachable from ``roots``, for graphs of any shape, by doubling over distinct nodes: log4(depth) rounds.

    After each round the nodes within four times the distance are known; when none is new, or no path is that long, all are.
    What is kept is a row for each node, however many roots lead to it."""
    edges = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_t IS NOT NULL").distinct()
    (jump, left), (seen, n) = counted({"edges": edges, "reach": roots.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct()})
    before = -1
    while left and n != before:
        before = n
        for _ in range(2):
            seen = seen.union(seen.join(jump, F.col("node") == F.col("_s")).select(F.col("_t").alias("node"))).distinct()
            jump = jump.join(jump.select(F.col("_s").alias("_m"), F.col("_t").alias("_e")), F.col("_t") == F.col("_m")).select("_s", F.col("_e").alias("_t")).distinct()
        (seen, n), (jump, left) = counted({"reach": seen, "jump": jump})
    return seen.withColumnRenamed("node", node)


def chain_closure(edges: DataFrame, roots: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(root, node, depth) for histories of at most one parent, by pointer doubling: log4(length) rounds instead of one a level.

    ``edges``: (node, parent), one row for each node, parent null at the beginning."""
    jump = written(edges.select(F.col(node).alias("_n"), F.col(parent).alias("_p")).where("_p IS NOT NULL"), "edges")
    got, step = roots.select(F.col(node).alias("root"), F.col(node).alias("node")).distinct().withColumn("depth", F.lit(0).cast("long")), 1
    while True:
        for _ in range(2):
            got = got.union(got.join(jump, F.col("node") == F.col("_n")).select("root", F.col("_p").alias("node"), (F.col("depth") + step).alias("depth")))
            jump = jump.select(F.col("_n").alias("_a"), F.col("_p").alias("_m")).join(jump, F.col("_m") == F.col("_n")).select(F.col("_a").alias("_n"), "_p")
            step *= 2
        (got, _), (jump, left) = counted({"chain": got, "jump": jump})
        if not left:
            return got


def parent_edges(versions: DataFrame) -> DataFrame:
    return versions.select(F.col("version_id").alias("source"), F.posexplode("parents").alias("pos", "target"))


def log(versions: DataFrame, head: str, limit: int = 0) -> DataFrame:
    """Versions from a head by breadth first, then the place among the parents; 0 shows all."""
    spark = versions.sparkSession
    edges = parent_edges(versions)
    walk = closure(spark.createDataFrame([(head,)], "node string"), edges, limit=limit - 1 if limit else None)
    place = edges.join(walk.withColumnsRenamed({"node": "source", "depth": "_d"}), "source").join(walk.withColumnRenamed("node", "target"), "target").where("depth = _d + 1").groupBy("target").agg(F.min(F.struct("pos", "source")).alias("_at"))
    out = walk.join(place, walk["node"] == place["target"], "left").join(versions, walk["node"] == versions["version_id"]).orderBy("depth", "_at", "version_id")
    out = out.drop("node", "target", "_at")
    return out.limit(limit) if limit else out


def known(versions: DataFrame, refs: DataFrame, scopes: tuple[str, ...] = ("local", "remote")) -> DataFrame:
    """H2: every version that a ref of the scopes leads to."""
    roots = refs.where(F.col("scope").isin(*scopes)).select(F.col("version_id").alias("node"))
    return reach(roots, parent_edges(versions)).select(F.col("node").alias("version_id"))


SHORTEST = 8


def resolve(name: str, versions: DataFrame, refs: DataFrame) -> str:
    """H6: a ref, a full id of a known version, or a prefix of at least 8 hex digits of exactly one."""
    hit = refs.where(F.col("name") == name).orderBy("scope").limit(1).collect()
    if hit:
        return hit[0]["version_id"]
    if re.fullmatch(r"[0-9a-f]{64}", name):
        if not versions.where(F.col("version_id") == name).isEmpty():
            return name
    elif re.fullmatch(r"[0-9a-f]{8,63}", name):
        found = known(versions, refs).where(F.col("version_id").startswith(name)).limit(2).collect()
        if len(found) == 1:
            return found[0]["version_id"]
        if found:
            raise RefNotFound(f"{name!r} is ambiguous")
    raise RefNotFound(repr(name))


def prefix_matches(names: DataFrame, ids: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """H6 for a table of prefixes: how many ids each has, and the id if it is one.

    An equi-join on the shortest prefix, then a comparison; prefixes that are too short or not hex match none."""
    p = names.select("prefix", F.substring("prefix", 1, shortest).alias("_k")).distinct()
    ok = F.col("prefix").rlike(f"^[0-9a-f]{{{shortest},64}}$")
    hits = p.where(ok).join(ids.select("id", F.substring("id", 1, shortest).alias("_k")).distinct(), "_k").where(F.startswith(F.col("id"), F.col("prefix")))
    n = hits.groupBy("prefix").agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    return p.select("prefix").join(n, "prefix", "left").select("prefix", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"), F.when(F.col("matches") == 1, F.col("id")).alias("id"))


#: Hours, days and weeks that snapshots are kept by; seconds.
SCHEDULE = (24 * 3600, 30 * 86400, 182 * 86400)
#: Up to this many buckets their newest snapshots are broadcast, beyond they are joined by shuffle.
FEW_BUCKETS = 100_000


def bucket(time: str, now: str, schedule: tuple[int, int, int] = SCHEDULE):
    """The bucket of a time, by its age; null is past the schedule.  Bounds are inclusive, buckets are of the calendar in UTC."""
    t = F.col(time)
    age = F.expr(f"timestampdiff(MICROSECOND, CAST({time} AS TIMESTAMP_NTZ), TIMESTAMP_NTZ '{now.replace('T', ' ').removesuffix('Z')}')")
    hour, day, week = (s * 1_000_000 for s in schedule)
    iso = F.concat(F.lit("week/"), F.lpad(F.expr(f"extract(YEAROFWEEK FROM {time})").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    return (
        F.when(age < 0, F.concat(F.lit("future/"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .when(age <= hour, F.concat(F.lit("hour/"), F.date_format(t, "yyyy-MM-dd'T'HH")))
        .when(age <= day, F.concat(F.lit("day/"), F.date_format(t, "yyyy-MM-dd")))
        .when(age <= week, iso)
    )


def retention(timeline: DataFrame, now: str, schedule: tuple[int, int, int] = SCHEDULE) -> DataFrame:
    """The bucket of each snapshot and whether it is kept: the newest of its bucket, the greatest name on ties.

    The newest is found by an aggregate that combines before the shuffle, so a full bucket is no hot task."""
    rows = timeline.withColumn("bucket", bucket("time", now, schedule))
    best = rows.where("bucket IS NOT NULL").groupBy("bucket").agg(F.max(F.struct("time", "ref_name")).alias("_best"))
    best = written(best, "buckets")
    # past buckets are bounded by the schedule, future ones (a second each) are not
    out = rows.join(F.broadcast(best) if best.count() <= FEW_BUCKETS else best, "bucket", "left")
    return out.withColumn("kept", F.coalesce((F.col("time") == F.col("_best.time")) & (F.col("ref_name") == F.col("_best.ref_name")), F.lit(False))).drop("_best")


def timeline(refs: DataFrame, versions: DataFrame) -> DataFrame:
    """snapshots, oldest first."""
    s = refs.where("name LIKE 'snapshots/%'").select(F.col("name").alias("ref_name"), "version_id")
    return s.join(versions.select("version_id", "time", "expiry"), "version_id").select("ref_name", "version_id", "time", "expiry").orderBy("time", "ref_name")


def impact(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """H7: everything that depends on the roots, directly or not, with the least number of steps."""
    return closure(roots, edges, source="target", target="source")

