"""The registered queries: each a Spark plan and, where SQL can say it, the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import ids, ignore, paths, text
from quarrystone.operators import chunking, codec, history, locks, manifest, storage

from . import relations as rel
from .relations import NOW, sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    from . import workflows  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import workflows  # noqa: F401

    return dict(_SQL)


# manifests: I7, C1-C4, C13, C16, D6, F1, G1-G2


@_query(sql("before", of="SELECT path, file_id, size FROM before"))
def manifest_build(spark, d):
    return manifest.build(rel.before(spark, d), check=True)


@_query(sql("changes", of="SELECT * FROM changes"))
def manifest_diff(spark, d):
    return manifest.diff(rel.before(spark, d), rel.after(spark, d))


@_query(sql("changes", of="SELECT kind, count(*) AS n FROM changes GROUP BY kind"))
def diff_summary(spark, d):
    return manifest.summary(manifest_diff(spark, d))


@_query(sql("changes", of="SELECT file_before AS file_id, path_before, path_after FROM changes WHERE kind = 'renamed'"))
def rename_pairs(spark, d):
    b, a = rel.before(spark, d), rel.after(spark, d)
    removed, added = b.join(a.select("path"), "path", "left_anti"), a.join(b.select("path"), "path", "left_anti")
    return manifest.rename_pairs(removed, added).select("file_id", "path_before", "path_after")


@_query(sql("changes", of="SELECT CASE kind WHEN 'added' THEN '+ ' || path_after WHEN 'removed' THEN '- ' || path_before WHEN 'changed' THEN 'M ' || path_after ELSE 'R ' || path_before || ' -> ' || path_after END AS line FROM changes"))
def diff_lines(spark, d):
    return manifest_diff(spark, d).select(text.change_line(F.col("kind"), F.col("path_before"), F.col("path_after")).alias("line"))


@_query(sql("m", of="SELECT path, file_id, size FROM m WHERE file_id IS NOT NULL"))
def merge3(spark, d):
    return manifest.merged(manifest.merge(rel.base(spark, d), rel.ours(spark, d), rel.theirs(spark, d)))


@_query(sql("m", of="SELECT path, conflict AS kind, ours_file, ours_size, theirs_file, theirs_size FROM m WHERE conflict IS NOT NULL"))
def merge_conflicts(spark, d):
    return manifest.conflicts(manifest.merge(rel.base(spark, d), rel.ours(spark, d), rel.theirs(spark, d)))


@_query(sql("m", of="SELECT COALESCE(conflict, CASE WHEN file_id IS NULL THEN 'gone' ELSE 'merged' END) AS kind, count(*) AS n FROM m GROUP BY 1"))
def merge_summary(spark, d):
    rows = manifest.merge(rel.base(spark, d), rel.ours(spark, d), rel.theirs(spark, d))
    return manifest.summary(rows.select(F.coalesce("conflict", F.when(F.col("file_id").isNull(), "gone").otherwise("merged")).alias("kind")))


@_query(
    sql("m", of="""SELECT 'write' AS action, m.path, m.file_id, m.size FROM m LEFT JOIN ours o USING (path) WHERE m.file_id IS NOT NULL AND m.file_id IS DISTINCT FROM o.file_id
    UNION ALL SELECT 'remove', o.path, o.file_id, o.size FROM ours o JOIN m USING (path) WHERE m.file_id IS NULL""")
)
def sync_plan(spark, d):
    ours = rel.ours(spark, d)
    rows = manifest.merged(manifest.merge(rel.base(spark, d), ours, rel.theirs(spark, d)))
    return manifest.incoming(manifest.diff(ours, rows))


@_query(sql("before", "after", of="SELECT path, CASE WHEN a.file_id IS NULL THEN 'remove' WHEN a.file_id = b.file_id THEN 'keep' ELSE 'write' END AS action, COALESCE(a.file_id, b.file_id) AS file_id FROM before b FULL OUTER JOIN after a USING (path)"))
def checkout_plan(spark, d):
    return manifest.checkout_plan(rel.before(spark, d), rel.after(spark, d))


@_query(sql("scan", "before", of="SELECT s.path, s.size FROM scan s WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.path = s.path)"))
def checkout_extra(spark, d):
    return manifest.extra(rel.scan(spark, d), rel.before(spark, d)).select("path", "size")


@_query(
    sql("scan", "cache", of="""SELECT path, CASE WHEN c.size IS NULL THEN 'new' WHEN s.size IS NULL THEN 'missing' WHEN s.size = c.size AND s.mtime_ns = c.mtime_ns THEN 'clean' ELSE 'modified' END AS status,
    s.size AS scan_size, c.size AS cache_size FROM scan s FULL OUTER JOIN cache c USING (path)""")
)
def status(spark, d):
    return manifest.status(rel.scan(spark, d), rel.cache(spark, d))


@_query(
    sql("scan", "cache", of="""SELECT count(*) AS files, count(*) FILTER (c.size IS NULL OR NOT (s.size = c.size AND s.mtime_ns = c.mtime_ns)) AS hashed,
    CAST(sum(CASE WHEN c.size IS NULL OR NOT (s.size = c.size AND s.mtime_ns = c.mtime_ns) THEN s.size ELSE 0 END) AS BIGINT) AS hashed_bytes FROM scan s LEFT JOIN cache c USING (path)""")
)
def snapshot_counters(spark, d):
    return storage.snapshot_counters(status(spark, d))


@_query(sql("after", of="SELECT CAST(sum(size) AS BIGINT) AS used, sum(size) >= 1000000 AS reached FROM after"))
def budget(spark, d):
    return storage.budget(rel.after(spark, d), 1_000_000)


@_query(sql("after", of="SELECT file_id, count(*) AS copies, min(path) AS first_path, CAST(max(size) * (count(*) - 1) AS BIGINT) AS bytes_saved FROM after GROUP BY file_id HAVING count(*) > 1"))
def dup_content_groups(spark, d):
    return storage.duplicate_groups(rel.after(spark, d))


@_query(sql("before", of="SELECT 'manifest' AS kind, sha256('quarrystone-manifest v1' || chr(10) || string_agg(path || chr(9) || file_id || chr(9) || size || chr(10), '' ORDER BY encode(path))) AS digest, count(*) AS entries FROM before"))
def manifest_encode(spark, d):
    return codec.manifest_digest(rel.before(spark, d))


# locks: C9-C11, C14-C15, B16-B17

_LIVE = f"TIMESTAMP '{NOW}' - since < INTERVAL 14 DAY"


@_query(sql("event_locks", of=f"SELECT path, owner, since FROM event_locks WHERE owner <> 'u1' AND {_LIVE}"))
def locks_foreign_live(spark, d):
    return locks.foreign_live(rel.event_locks(spark, d), "u1", NOW)


@_query(sql("held", "event_locks", of="SELECT h.path, l.owner AS now_owner FROM held h LEFT JOIN event_locks l ON l.path = h.path WHERE l.owner IS NULL OR l.owner <> 'u0'"))
def locks_lost(spark, d):
    return locks.lost(rel.held_locks(spark, d), rel.event_locks(spark, d), "u0")


@_query(
    sql("changes", "doc_locks", of=f"""SELECT l.path, l.owner FROM doc_locks l WHERE l.owner <> 'src0' AND {_LIVE.replace("since", "l.since")}
    AND l.path IN (SELECT path_before FROM changes WHERE path_before IS NOT NULL UNION SELECT path_after FROM changes WHERE path_after IS NOT NULL)""")
)
def touched_paths_blocked(spark, d):
    return locks.blocked(manifest.touched(manifest_diff(spark, d)), locks.foreign_live(rel.doc_locks(spark, d), "src0", NOW))


@_query(sql("scan", "doc_locks", of=f"SELECT s.path, EXISTS (SELECT 1 FROM doc_locks l WHERE l.path = s.path AND l.owner <> 'src0' AND {_LIVE.replace('since', 'l.since')}) AS read_only FROM scan s"))
def lock_attributes(spark, d):
    return locks.read_only(rel.scan(spark, d).select("path"), locks.foreign_live(rel.doc_locks(spark, d), "src0", NOW))


@_query(sql("after", of="SELECT path FROM after WHERE regexp_matches(path, '^docs/en/[^/]*/[^/]*2\\.txt$')"))
def lock_pattern_paths(spark, d):
    return ignore.match_paths(rel.after(spark, d), "docs/en/*/*2.txt").select("path")


# retention and history: E1-E2, F3-F5, H1-H2, H6-H7

_TIERS = (24 * 3600, 7 * 86400, 21 * 86400)


@_query(sql("ret", of="SELECT ref_name, bucket FROM ret WHERE kept"))
def retention_keep(spark, d):
    return history.retention(rel.timeline(spark, d), NOW, _TIERS).where("kept").select("ref_name", "bucket")


@_query(sql("ret", of="SELECT ref_name, bucket FROM ret WHERE NOT kept"))
def retention_drop(spark, d):
    return history.retention(rel.timeline(spark, d), NOW, _TIERS).where("NOT kept").select("ref_name", "bucket")


@_query(sql("ret", of="SELECT COALESCE(split_part(bucket, '/', 1), 'past') AS tier, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM ret GROUP BY 1"))
def retention_summary(spark, d):
    rows = history.retention(rel.timeline(spark, d), NOW, _TIERS)
    return rows.groupBy(F.coalesce(F.substring_index("bucket", "/", 1), F.lit("past")).alias("tier")).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@_query(sql("walk", of="SELECT root, node, depth FROM walk"))
def log_walk(spark, d):
    return history.chain_closure(rel.versions(spark, d), rel.roots(spark, d))


@_query(sql("walk", of="SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node"))
def version_closure(spark, d):
    return history.closure(rel.roots(spark, d), rel.versions(spark, d), source="node", target="parent")


@_query(
    """WITH v AS (SELECT DISTINCT sha256(CAST(o_orderkey AS VARCHAR)) AS id FROM orders),
    p AS (SELECT DISTINCT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, CAST(6 + o_orderkey % 8 AS INTEGER)) AS prefix FROM orders UNION SELECT DISTINCT substr(sha256('x' || o_orderkey), 1, 10) FROM orders),
    h AS (SELECT prefix, count(*) AS n, min(id) AS id FROM p JOIN v ON substr(v.id, 1, 8) = substr(p.prefix, 1, 8) AND starts_with(v.id, p.prefix) WHERE length(prefix) >= 8 GROUP BY prefix)
    SELECT prefix, COALESCE(n, 0) AS matches, CASE WHEN n = 1 THEN h.id END AS id FROM p LEFT JOIN h USING (prefix)"""
)
def resolve_prefix(spark, d):
    o = rel.table(spark, d, "orders")
    hexed = F.sha2(F.col("o_orderkey").cast("string"), 256)
    known = o.select(F.substring(hexed, F.lit(1), (F.lit(6) + F.col("o_orderkey") % 8).cast("int")).alias("prefix"))
    odd = o.select(F.substring(F.sha2(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")), 256), 1, 10).alias("prefix"))
    return history.prefix_matches(known.union(odd), o.select(hexed.alias("id")))


@_query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_partkey <> l_suppkey),
    w AS (SELECT 1 AS node UNION SELECT e.source FROM w JOIN e ON e.target = w.node) SELECT CAST(node AS BIGINT) AS node FROM w"""
)
def impact_closure(spark, d):
    e = rel.table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).where("source <> target").distinct()
    return history.impact(e, spark.range(1, 2).select(F.col("id").alias("node"))).select("node")


# store: A5-A8, A11, C6-C8, C17-C18, D3, D5, D8-D9, E5, G4-G5, H3, I8


def _reach(spark, d):
    live = history.reach(rel.roots(spark, d), rel.versions(spark, d), source="node", target="parent").select(F.col("node").alias("file_id"))
    return live, rel.file_chunks(spark, d).join(live, "file_id", "left_semi").select("chunk_id").distinct()


@_query(sql("reach", of="SELECT chunk_id FROM reach"))
def gc_reachable(spark, d):
    return _reach(spark, d)[1]


@_query(sql("fates", of="SELECT chunk_id, age_hours, size, fate FROM fates"))
def gc_sweep(spark, d):
    return storage.sweep(rel.objects(spark, d), _reach(spark, d)[1], "age_hours", 10, on=("chunk_id",))


@_query(sql("fates", of="SELECT count(*) AS scanned, count(*) FILTER (fate = 'live') AS reachable, count(*) FILTER (fate = 'deleted') AS deleted, count(*) FILTER (fate = 'spared') AS spared, CAST(COALESCE(sum(size) FILTER (fate = 'deleted'), 0) AS BIGINT) AS bytes_deleted FROM fates"))
def gc_summary(spark, d):
    return storage.sweep_summary(gc_sweep(spark, d))


@_query(
    sql("walk", "file_chunks", of="""SELECT 'o/' || o_orderkey AS path, o_orderkey AS file_id, CASE WHEN w.node IS NULL THEN 'unversioned' WHEN l.n > 0 THEN 'problem' ELSE 'safe' END AS verdict, CASE WHEN w.node IS NULL THEN 0 ELSE COALESCE(l.n, 0) END AS missing_chunks
    FROM orders LEFT JOIN (SELECT DISTINCT node FROM walk) w ON w.node = o_orderkey LEFT JOIN (SELECT file_id, count(DISTINCT chunk_id) AS n FROM file_chunks WHERE chunk_id % 50 = 0 GROUP BY file_id) l ON l.file_id = o_orderkey WHERE o_orderkey % 4 = 0 OR w.node IS NOT NULL""")
)
def dirty_check(spark, d):
    live, _ = _reach(spark, d)
    o = rel.table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"))
    present = o.where("file_id % 4 = 0").union(o.join(live, "file_id", "left_semi").where("file_id % 4 <> 0"))
    stored = rel.objects(spark, d).where("chunk_id % 50 <> 0")
    return storage.clear_check(present.select(F.concat(F.lit("o/"), F.col("file_id").cast("string")).alias("path"), "file_id"), live, rel.file_chunks(spark, d), stored)


@_query(sql("file_chunks", of="SELECT chunk_id, count(DISTINCT file_id) AS owners, min(file_id) AS first_owner FROM file_chunks WHERE chunk_id % 50 = 0 GROUP BY chunk_id"))
def missing_chunk_owners(spark, d):
    return storage.missing_owners(rel.file_chunks(spark, d), rel.objects(spark, d).where("chunk_id % 50 <> 0"))


@_query("SELECT l_linenumber AS pos, l_orderkey, l_partkey * 2 AS chunk_id, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey * 2) AS present FROM lineitem")
def exists_batch(spark, d):
    keys = rel.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("pos"), "l_orderkey", (F.col("l_partkey") * 2).alias("chunk_id"))
    return storage.exists(keys, rel.objects(spark, d), ["chunk_id"])


@_query("SELECT DISTINCT l_partkey * 2 AS chunk_id FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part)")
def put_missing(spark, d):
    new = rel.table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("chunk_id"))
    return storage.missing(new, rel.objects(spark, d), ("chunk_id",))


@_query(sql("file_chunks", of="SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(sum(m) AS BIGINT) AS unique_bytes, count(*) FILTER (n > 1) AS shared_chunks FROM (SELECT chunk_id, count(*) AS n, sum(length) AS b, max(length) AS m FROM file_chunks GROUP BY chunk_id)"))
def dedup_report(spark, d):
    return storage.dedup_report(rel.file_chunks(spark, d))


@_query(sql("file_chunks", of="SELECT file_id, seq, chunk_id, length, CAST(COALESCE(sum(length) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM file_chunks"))
def chunk_offsets(spark, d):
    return storage.offsets(rel.file_chunks(spark, d))


@_query(
    sql("file_chunks", of="""SELECT o_orderkey AS file_id, s.size, COALESCE(c.total, 0) AS total, COALESCE(c.bad, 0) AS bad_chunks FROM (SELECT o_orderkey, CAST(o_orderkey % 300 AS BIGINT) AS size FROM orders) s
    LEFT JOIN (SELECT file_id, CAST(sum(length) AS BIGINT) AS total, count(*) FILTER (length <= 0) AS bad FROM file_chunks GROUP BY file_id) c ON c.file_id = o_orderkey WHERE s.size <> COALESCE(c.total, 0) OR COALESCE(c.bad, 0) > 0""")
)
def file_invariants(spark, d):
    files = rel.table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % 300).cast("long").alias("size"))
    return storage.file_faults(files, rel.file_chunks(spark, d))


@_query(
    sql("file_chunks", of="""SELECT CAST(sum(least(b, a)) AS BIGINT) AS shared_chunks, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS new_chunks, CAST(sum(greatest(a - b, 0) * al) AS BIGINT) AS new_bytes, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS gone_chunks
    FROM (SELECT chunk_id, count(*) FILTER (file_id % 2 = 0) AS b, count(*) FILTER (file_id % 2 = 1) AS a, COALESCE(max(length) FILTER (file_id % 2 = 1), 0) AS al FROM file_chunks GROUP BY chunk_id)""")
)
def chunk_new_bytes(spark, d):
    c = rel.file_chunks(spark, d)
    return storage.new_bytes(c.where("file_id % 2 = 0"), c.where("file_id % 2 = 1"))


@_query(sql("file_chunks", of="SELECT count(*) AS chunks, avg(length) AS mean_length, avg(CASE WHEN length = 50 THEN 1.0::DOUBLE ELSE 0 END) AS share_at_largest FROM file_chunks"))
def chunk_size_distribution(spark, d):
    return storage.chunk_sizes(rel.file_chunks(spark, d), 50)


@_query("SELECT 'chunk' AS kind, CASE WHEN doc_id % 11 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS digest, sha256(text) AS found FROM documents WHERE doc_id % 11 = 0")
def object_verify(spark, d):
    docs = rel.table(spark, d, "documents")
    wrong = F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return storage.verify(docs.select(F.lit("chunk").alias("kind"), wrong.alias("digest"), F.encode("text", "utf-8").alias("data")), "sha256")


# paths, names and scalars: B4-B5, B7, B10, B12-B14, B18-B20, D2, D4

_ODD = "CASE k % 9 WHEN 0 THEN '/' || p WHEN 1 THEN replace(p, '/', '\\') WHEN 2 THEN p || '/' WHEN 3 THEN './' || p WHEN 4 THEN replace(p, '/', '//') WHEN 5 THEN p || chr(9) WHEN 6 THEN '' WHEN 7 THEN 'a/../' || p ELSE p END"


@_query(
    f"""WITH u AS (SELECT page_id, page_id AS k, substr(url, position('://' IN url) + 3) AS p FROM pages), q AS (SELECT page_id, {_ODD} AS path FROM u)
    SELECT page_id, path, CASE WHEN path = '' THEN 'empty' WHEN starts_with(path, '/') THEN 'absolute' WHEN contains(path, '\\') THEN 'backslash' WHEN regexp_matches(path, '[\\x00-\\x1f\\x7f]') THEN 'control character'
    WHEN list_contains(string_split(path, '/'), '') THEN 'empty segment' WHEN list_contains(string_split(path, '/'), '.') OR list_contains(string_split(path, '/'), '..') THEN 'dot segment' END AS problem FROM q"""
)
def path_validate(spark, d):
    p = F.expr("substring(url, position('://' IN url) + 3)")
    k = F.col("page_id") % 9
    odd = [F.concat(F.lit("/"), p), F.replace(p, F.lit("/"), F.lit("\\")), F.concat(p, F.lit("/")), F.concat(F.lit("./"), p), F.replace(p, F.lit("/"), F.lit("//")), F.concat(p, F.lit("\t")), F.lit(""), F.concat(F.lit("a/../"), p)]
    path = p
    for i, v in enumerate(odd):
        path = F.when(k == i, v).otherwise(path)
    return rel.table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("problem", paths.problem(F.col("path")))


@_query(
    """WITH p AS (SELECT DISTINCT CASE WHEN doc_id % 6 = 0 THEN upper(source) || '/A.txt' ELSE source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'a' ELSE 'A' END || '.txt' END AS path FROM documents)
    SELECT lower(path) AS fold, min(path) AS first_path, max(path) AS last_path, count(*) AS n_paths FROM p GROUP BY 1 HAVING count(*) > 1"""
)
def path_collisions(spark, d):
    i = F.col("doc_id")
    path = F.when(i % 6 == 0, F.concat(F.upper("source"), F.lit("/A.txt"))).otherwise(F.concat("source", F.lit("/"), F.when(i % 5 == 0, "a").otherwise("A"), F.lit(".txt")))
    return paths.collisions(rel.table(spark, d, "documents").select(path.alias("path")), ascii_only=True)


@_query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'com1.' || p_name WHEN p_partkey % 3 = 1 THEN p_name || '/nul' ELSE 'x/' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '' END END AS path, p_partkey % 3 < 2 OR p_partkey % 2 = 0 AS reserved FROM part")
def reserved_names(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("com1."), "p_name")).when(k % 3 == 1, F.concat("p_name", F.lit("/nul"))).otherwise(F.concat(F.lit("x/"), "p_name", F.when(k % 2 == 0, ".").otherwise("")))
    return rel.table(spark, d, "part").select("p_partkey", path.alias("path")).withColumn("reserved", paths.is_reserved(F.col("path")))


RULES = ignore.parse("# rules\n*.txt\n!docs/en/**\nsrc1?/\n/docs/de/src[2-4]/*7.txt\n!*00.txt\ndocs/**/src5\n")
_IGN = """CASE WHEN regexp_matches(path, '^(?:[^/]+/)*[^/]*00\\.txt$') THEN false WHEN regexp_matches(path, '^docs/de/src[2-4]/[^/]*7\\.txt$') THEN true
    WHEN regexp_matches(path, '^docs/en(/.*)?$') THEN false WHEN regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.txt$') THEN true ELSE false END"""


@_query(sql("after", of=f"SELECT path, {_IGN} AS ignored FROM after"))
def ignore_match(spark, d):
    return rel.after(spark, d).select("path", ignore.match_column(F.col("path"), False, RULES).alias("ignored"))


@_query(
    sql("after", of=f"""SELECT ignored, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT size, CASE WHEN regexp_matches(path, '(^|/)src(1[^/]|5)/') AND (regexp_matches(path, '(^|/)src1[^/]/') OR regexp_matches(path, '^docs/'))
    THEN regexp_extract(path, '^(.*/src(1[^/]|5))/', 1) WHEN {_IGN} THEN path END AS ignored FROM after) WHERE ignored IS NOT NULL GROUP BY ignored""")
)
def ignored_bytes(spark, d):
    return ignore.ignored_bytes(rel.after(spark, d), RULES)


@_query(
    """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'local/' || event_type WHEN 1 THEN event_type || '.lock' WHEN 2 THEN event_type || '//x' WHEN 3 THEN '../' || event_type WHEN 4 THEN event_type || ' x' ELSE repeat('a', CAST(150 + event_id % 100 AS INTEGER)) END AS name FROM events)
    SELECT event_id, name, length(name) BETWEEN 1 AND 200 AND regexp_full_match(name, '[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*') AND NOT regexp_matches(name, '(^|/)(\\.\\.?|[^/]*\\.lock)(/|$)') AS valid FROM r"""
)
def ref_name_validate(spark, d):
    k, t = F.col("event_id"), F.col("event_type")
    name = F.when(k % 6 == 0, F.concat(F.lit("local/"), t)).when(k % 6 == 1, F.concat(t, F.lit(".lock"))).when(k % 6 == 2, F.concat(t, F.lit("//x"))).when(k % 6 == 3, F.concat(F.lit("../"), t)).when(k % 6 == 4, F.concat(t, F.lit(" x"))).otherwise(F.repeat(F.lit("a"), (150 + k % 100).cast("int")))
    return rel.table(spark, d, "events").select("event_id", name.alias("name")).withColumn("valid", text.ref_name_ok(F.col("name")))


@_query(
    """WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN substr(sha256(text), 2) WHEN 3 THEN sha256(text) || 'a' ELSE 'g' || substr(sha256(text), 2) END AS id, CASE WHEN doc_id % 4 = 0 THEN 'blob' ELSE 'chunk' END AS kind FROM documents)
    SELECT doc_id, regexp_full_match(id, '[0-9a-f]{64}') AS valid_id, regexp_full_match(id, '[0-9a-f]{64}') AND kind = 'chunk' AS valid_key, substr(id, 1, 12) AS short FROM r"""
)
def id_validate(spark, d):
    k, h = F.col("doc_id"), F.sha2("text", 256)
    i = F.when(k % 5 == 0, h).when(k % 5 == 1, F.upper(h)).when(k % 5 == 2, F.substring(h, 2, 99)).when(k % 5 == 3, F.concat(h, F.lit("a"))).otherwise(F.concat(F.lit("g"), F.substring(h, 2, 99)))
    docs = rel.table(spark, d, "documents").select("doc_id", i.alias("id"), F.when(k % 4 == 0, "blob").otherwise("chunk").alias("kind"))
    return docs.select("doc_id", ids.is_id(F.col("id")).alias("valid_id"), ids.is_key(F.col("kind"), F.col("id")).alias("valid_key"), ids.short_id(F.col("id")).alias("short"))


@_query(
    """WITH b AS (SELECT o_orderkey, o_orderkey * o_orderkey * (1 + o_orderkey % 1000) AS n FROM orders) SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE)
    WHEN n < 1099511627776 THEN printf('%.1f GiB', n / 1073741824.0::DOUBLE) WHEN n < 1125899906842624 THEN printf('%.1f TiB', n / 1099511627776.0::DOUBLE) ELSE printf('%.1f PiB', n / 1125899906842624.0::DOUBLE) END AS size_text FROM b"""
)
def human_bytes(spark, d):
    k = F.col("o_orderkey")
    return rel.table(spark, d, "orders").select("o_orderkey", text.human_bytes(k * k * (1 + k % 1000)).alias("size_text"))


@_query("SELECT event_id, 'snapshots/' || strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS ref_name FROM events")
def snapshot_ref_names(spark, d):
    return rel.table(spark, d, "events").select("event_id", ids.snapshot_ref_name(F.col("ts"), F.sha2(F.col("event_id").cast("string"), 256)).alias("ref_name"))


@_query(
    """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '0' || o_orderkey WHEN 1 THEN '+' || o_orderkey WHEN 2 THEN o_orderkey || ' ' WHEN 3 THEN o_orderkey || '99999999999999999999' ELSE CAST(o_orderkey AS VARCHAR) END AS spelling, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 3 = 0 THEN 'Z' WHEN o_orderkey % 3 = 1 THEN 'z' ELSE '+00:00' END AS stamp FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_full_match(spelling, '0|[1-9][0-9]*') THEN TRY_CAST(spelling AS BIGINT) END AS number, CASE WHEN ends_with(stamp, 'Z') THEN stamp END AS instant FROM s"""
)
def strict_scalars(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    spelling = F.when(k % 5 == 0, F.concat(F.lit("0"), s)).when(k % 5 == 1, F.concat(F.lit("+"), s)).when(k % 5 == 2, F.concat(s, F.lit(" "))).when(k % 5 == 3, F.concat(s, F.lit("9" * 20))).otherwise(s)
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 3 == 0, "Z").when(k % 3 == 1, "z").otherwise("+00:00"))
    rows = rel.table(spark, d, "orders").select("o_orderkey", spelling.alias("spelling"), stamp.alias("stamp"))
    return rows.select("o_orderkey", text.strict_int(F.col("spelling")).alias("number"), F.date_format(text.strict_time(F.col("stamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("instant"))


@_query("SELECT l_orderkey AS group_id, min(l_linenumber) AS first_offence, count(*) AS offences FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem) WHERE p >= l_partkey GROUP BY 1")
def sorted_unique_check(spark, d):
    li = rel.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber"), F.col("l_partkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return manifest.unsorted(li, "group_id", "at", "l_partkey").select("group_id", F.col("first_offence.l_linenumber").alias("first_offence"), "offences")


# content: I1-I5, B1-B3 (no SQL can say these; the tests hold them against plain restatements)


@_query()
def cdc_chunks(spark, d):
    docs = rel.table(spark, d, "documents").select(F.sha2("text", 256).alias("file_id"), F.encode("text", "utf-8").alias("data")).dropDuplicates(["file_id"])
    return chunking.split(docs, chunking.Params(512, 9, 2048), keep=False)


@_query()
def cdc_dedup(spark, d):
    return storage.dedup_report(cdc_chunks(spark, d))


@_query()
def blake3_ids(spark, d):
    docs = rel.table(spark, d, "documents")
    data = F.encode("text", "utf-8")
    return docs.select("doc_id", ids.content_id_column("chunk", data).alias("chunk_id"), ids.content_id_column("file", data).alias("file_id"))
