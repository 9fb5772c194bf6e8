"""Queries of the workflows and of operators that the catalogue's other queries don't go through: log, timeline,
known versions, marks over all kinds of objects, scrubbing, canonical objects, held locks, full folding, planned states of the verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import ids, paths, text
from quarrystone.operators import codec, history, locks, manifest, storage

from . import relations as rel
from .catalogue import _LIVE, _query
from .relations import NOW, sql

# history over versions with two parents: an order's parents are the customer's order before it and the one three before


def dag(spark, d) -> DataFrame:
    o = rel.table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    of = lambda n: F.lag(F.col("o_orderkey").cast("string"), n).over(w)
    return o.select(
        F.col("o_orderkey").cast("string").alias("version_id"), F.concat(F.lit("m"), (F.col("o_orderkey") % 5000).cast("string")).alias("manifest_id"),
        F.array_compact(F.array(of(1), of(3))).alias("parents"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"),
        F.col("o_orderdate").alias("time"), F.lit(None).cast("timestamp_ntz").alias("expiry"), F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("g"), F.col("o_orderkey").cast("string"))).alias("graph_id"), F.col("o_custkey").alias("customer"),
    )


def refs(spark, d) -> DataFrame:
    """A ref for each customer's latest order: local, remote, or of a scope that nothing asks for."""
    o = rel.table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    scope = F.when(F.col("o_custkey") % 3 == 0, "local").when(F.col("o_custkey") % 3 == 1, "remote").otherwise("other")
    name = F.concat(F.when(F.col("o_custkey") % 2 == 0, "snapshots/").otherwise("heads/"), F.col("o_custkey").cast("string"))
    return o.select(scope.alias("scope"), name.alias("name"), F.col("m.o_orderkey").cast("string").alias("version_id"))


_DAG = """o AS (SELECT *, lag(o_orderkey) OVER w AS p1, lag(o_orderkey, 3) OVER w AS p3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    e AS (SELECT o_orderkey AS s, p1 AS t FROM o WHERE p1 IS NOT NULL UNION SELECT o_orderkey, p3 FROM o WHERE p3 IS NOT NULL),
    r AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' ELSE 'other' END AS scope, CASE WHEN o_custkey % 2 = 0 THEN 'snapshots/' ELSE 'heads/' END || o_custkey AS name, o_orderkey AS v, o_orderdate AS time
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1)"""
_LIVE_DAG = f"{_DAG}, live AS (SELECT v FROM r WHERE scope IN ('local', 'remote') UNION SELECT e.t FROM live JOIN e ON e.s = live.v)"


@_query(f"WITH RECURSIVE {_LIVE_DAG} SELECT CAST(v AS VARCHAR) AS version_id FROM live")
def known_versions(spark, d):
    return history.known(dag(spark, d), refs(spark, d))


@_query(
    f"""WITH RECURSIVE {_DAG}, h AS (SELECT o_orderkey AS head FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1),
    w AS (SELECT head AS v, 0 AS depth FROM h UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON e.s = w.v) SELECT CAST(v AS VARCHAR) AS version_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY v"""
)
def log_of_head(spark, d):
    v = dag(spark, d)
    head = v.agg(F.max(F.struct("time", F.col("version_id").cast("long").alias("k"))).alias("m")).first()["m"]["k"]
    return history.log(v, str(head)).select("version_id", "depth")


@_query(
    f"""WITH RECURSIVE {_DAG}, w AS (SELECT v AS root, v AS node, CAST(0 AS BIGINT) AS depth FROM r UNION ALL SELECT w.root, o.p1, w.depth + 1 FROM w JOIN o ON o.o_orderkey = w.node WHERE o.p1 IS NOT NULL)
    SELECT root, node, depth FROM w"""
)
def log_of_all_heads(spark, d):
    return history.chain_closure(rel.versions(spark, d), refs(spark, d).select(F.col("version_id").cast("long").alias("node")))


@_query(f"WITH {_DAG} SELECT name AS ref_name, CAST(v AS VARCHAR) AS version_id, time FROM r WHERE starts_with(name, 'snapshots/')")
def snapshot_timeline(spark, d):
    return history.timeline(refs(spark, d), dag(spark, d)).select("ref_name", "version_id", "time")


@_query(f"WITH {_DAG}, n AS (SELECT min(name) AS name FROM r) SELECT n.name, CAST(r.v AS VARCHAR) AS version_id FROM n JOIN r USING (name)")
def resolve_ref(spark, d):
    """The version that a name stands for."""
    r = refs(spark, d)
    name = r.agg(F.min("name")).first()[0]
    return spark.createDataFrame([(name, history.resolve(name, dag(spark, d), r))], "name string, version_id string")


# retention by the default schedule


@_query(
    f"""WITH t AS (SELECT 'snapshots/e' || event_id AS ref_name, ts AS time FROM events),
    b AS (SELECT *, CASE WHEN time > TIMESTAMP '{NOW}' THEN 'future/' || strftime(time, '%Y-%m-%dT%H:%M:%SZ') WHEN TIMESTAMP '{NOW}' - time <= INTERVAL 24 HOUR THEN 'hour/' || strftime(time, '%Y-%m-%dT%H')
      WHEN TIMESTAMP '{NOW}' - time <= INTERVAL 30 DAY THEN 'day/' || strftime(time, '%Y-%m-%d') WHEN TIMESTAMP '{NOW}' - time <= INTERVAL 182 DAY THEN 'week/' || lpad(CAST(isoyear(time) AS VARCHAR), 4, '0') || '-' || lpad(CAST(week(time) AS VARCHAR), 2, '0') END AS bucket FROM t)
    SELECT ref_name, bucket, bucket IS NOT NULL AND row_number() OVER (PARTITION BY bucket ORDER BY time DESC, ref_name DESC) = 1 AS kept FROM b"""
)
def expire_plan(spark, d):
    """What an expiry keeps and drops by the default schedule."""
    return history.retention(rel.timeline(spark, d), NOW).select("ref_name", "bucket", "kept")


# marks and sweeps over all kinds of objects


def _store(spark, d):
    """Entries of manifests, chunks of files and of manifests, signatures."""
    li = rel.table(spark, d, "lineitem")
    s = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    entries = li.select(F.concat(F.lit("m"), (F.col("l_orderkey") % 5000).cast("string")).alias("manifest_id"), s("f", "l_partkey").alias("file_id"))
    chunks = li.select(s("f", "l_partkey").alias("file_id"), s("k", "l_suppkey").alias("chunk_id"))
    listed = li.select(F.concat(F.lit("m"), (F.col("l_orderkey") % 5000).cast("string")).alias("manifest_id"), F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("chunk_id"))
    o = rel.table(spark, d, "orders").where("o_orderkey % 11 = 0")
    return entries, chunks, listed, o.select(s("s", "o_orderkey").alias("signature_id"), F.col("o_orderkey").cast("string").alias("version_id"))


_MARK = f"""{_LIVE_DAG}, lv AS (SELECT DISTINCT v FROM live), lm AS (SELECT DISTINCT v % 5000 AS m FROM lv), lf AS (SELECT DISTINCT l_partkey AS f FROM lineitem JOIN lm ON l_orderkey % 5000 = m),
    mark AS (SELECT 'version' AS kind, CAST(v AS VARCHAR) AS digest FROM lv UNION SELECT 'manifest', 'm' || m FROM lm UNION SELECT 'file', 'f' || f FROM lf UNION SELECT 'chunk', 'k' || l_suppkey FROM lineitem JOIN lf ON l_partkey = f
      UNION SELECT 'graph', 'g' || v FROM lv WHERE v % 7 = 0 UNION SELECT 'chunk', 'q' || l_linenumber FROM lineitem JOIN lm ON l_orderkey % 5000 = m UNION SELECT 'signature', 's' || v FROM lv WHERE v % 11 = 0)"""


def _mark(spark, d):
    entries, chunks, listed, signatures = _store(spark, d)
    return storage.reachable_objects(dag(spark, d), refs(spark, d), entries, chunks, listed, signatures)


@_query(f"WITH RECURSIVE {_MARK} SELECT kind, digest FROM mark")
def gc_mark(spark, d):
    return _mark(spark, d)


_OBJECTS = "objs AS (SELECT 'version' AS kind, CAST(o_orderkey AS VARCHAR) AS digest, o_orderkey % 30 AS age_hours, CAST(100 AS BIGINT) AS size FROM orders UNION ALL SELECT 'file', 'f' || p_partkey, p_partkey % 30, CAST(p_size AS BIGINT) FROM part UNION ALL SELECT 'graph', 'g' || o_orderkey, o_orderkey % 30, CAST(10 AS BIGINT) FROM orders)"


def _objects(spark, d):
    o, p = rel.table(spark, d, "orders"), rel.table(spark, d, "part")
    key, part = F.col("o_orderkey"), F.col("p_partkey")
    rows = [
        o.select(F.lit("version").alias("kind"), key.cast("string").alias("digest"), (key % 30).alias("age_hours"), F.lit(100).cast("long").alias("size")),
        p.select(F.lit("file"), F.concat(F.lit("f"), part.cast("string")), part % 30, F.col("p_size").cast("long")),
        o.select(F.lit("graph"), F.concat(F.lit("g"), key.cast("string")), key % 30, F.lit(10).cast("long")),
    ]
    return rows[0].union(rows[1]).union(rows[2])


@_query(f"WITH RECURSIVE {_MARK}, {_OBJECTS} SELECT objs.*, CASE WHEN m.digest IS NOT NULL THEN 'live' WHEN age_hours >= 1 THEN 'deleted' ELSE 'spared' END AS fate FROM objs LEFT JOIN mark m ON m.kind = objs.kind AND m.digest = objs.digest")
def gc_fates(spark, d):
    """The fate of every object of a store, with the default grace."""
    return storage.sweep(_objects(spark, d), _mark(spark, d), "age_hours")


@_query(f"WITH RECURSIVE {_MARK}, {_OBJECTS} SELECT kind, digest FROM objs LEFT JOIN mark m USING (kind, digest) WHERE m.digest IS NOT NULL OR age_hours < 1")
def gc_remaining(spark, d):
    """What the store lists after the sweep."""
    fates = gc_fates(spark, d)
    return _objects(spark, d).select("kind", "digest").join(fates.where("fate = 'deleted'").select("kind", "digest"), ["kind", "digest"], "left_anti")


# contents: files of chunks of 200 characters


def _contents(spark, d):
    """(file_id, seq, chunk_id, length) and (chunk_id, data) of the documents' texts; a file is a text."""
    docs = rel.table(spark, d, "documents").select(F.sha2("text", 256).alias("file_id"), "text").dropDuplicates(["file_id"])
    piece = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / 200).cast("int") - 1)), lambda i: F.encode(F.substring(F.col("text"), i * 200 + 1, F.lit(200)), "utf-8"))
    rows = docs.where("text <> ''").select("file_id", F.posexplode(piece).alias("seq", "data"))
    rows = rows.select("file_id", "seq", F.sha2("data", 256).alias("chunk_id"), F.octet_length("data").cast("long").alias("length"), "data")
    return rows.drop("data"), rows.select("chunk_id", "data").dropDuplicates(["chunk_id"])


@_query("SELECT DISTINCT sha256(text) AS file_id, sha256(text) AS found, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text <> ''")
def restored_contents(spark, d):
    """Every file put together from its chunks."""
    got = storage.reassembled(*_contents(spark, d))
    return got.select("file_id", F.sha2("data", 256).alias("found"), F.octet_length("data").cast("long").alias("size"))


_BROKEN = """p AS (SELECT DISTINCT sha256(text) AS file_id, text, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i FROM documents WHERE text <> ''),
    c AS (SELECT file_id, i, sha256(substr(text, i * 200 + 1, 200)) AS chunk_id FROM p)"""


@_query(
    f"""WITH {_BROKEN}, s AS (SELECT file_id, bool_or(starts_with(chunk_id, '00')) AS gone, bool_or(starts_with(chunk_id, '01')) AS longer, bool_or(starts_with(chunk_id, '02')) AS changed FROM c GROUP BY file_id)
    SELECT file_id, CASE WHEN gone THEN 'missing chunk' WHEN longer THEN 'size' ELSE 'content' END AS reason FROM s WHERE gone OR longer OR changed"""
)
def scrub_report(spark, d):
    """Chunks are missing, longer or changed in the store; the files that show it."""
    listed, chunks = _contents(spark, d)
    first = F.col("chunk_id").substr(1, 2)
    data = F.when(first == "01", F.concat("data", F.lit(b"+"))).when(first == "02", F.concat(F.lit(b"\x01"), F.expr("substring(data, 2)"))).otherwise(F.col("data"))
    return storage.scrub(listed, chunks.where(first != "00").select("chunk_id", data.alias("data")), "sha256")


@_query(f"WITH {_BROKEN} SELECT 'file' AS kind, f.file_id AS content, sha256('quarrystone-file v1' || chr(10) || 'size' || chr(9) || any_value(f.size) || chr(10) || string_agg(c.chunk_id || chr(9) || c.n || chr(10), '' ORDER BY c.i)) AS digest FROM (SELECT file_id, i, sha256(substr(text, i * 200 + 1, 200)) AS chunk_id, strlen(substr(text, i * 200 + 1, 200)) AS n FROM p) c JOIN (SELECT DISTINCT sha256(text) AS file_id, strlen(text) AS size FROM documents) f USING (file_id) GROUP BY f.file_id")
def encode_files(spark, d):
    """The canonical bytes of file objects, by their digest."""
    listed, _ = _contents(spark, d)
    files = listed.groupBy("file_id").agg(F.sum("length").alias("size"), F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "length"))).alias("chunks"))
    return codec.digested(files, "file", lambda r: codec.File(r["size"], tuple((c["chunk_id"], c["length"]) for c in r["chunks"])), "file_id").select("kind", F.col("key").alias("content"), "digest")


_H = "sha256(CAST(o_orderkey AS VARCHAR))"


@_query(
    f"""WITH o AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
    SELECT 'version' AS kind, CAST(o_orderkey AS VARCHAR) AS content, sha256('quarrystone-version v1' || chr(10) || 'manifest' || chr(9) || sha256('m' || o_orderkey) || chr(10) || CASE WHEN p IS NULL THEN '' ELSE 'parent' || chr(9) || sha256(CAST(p AS VARCHAR)) || chr(10) END
      || 'author' || chr(9) || 'c' || o_custkey || chr(10) || 'time' || chr(9) || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN 'expiry' || chr(9) || strftime(o_orderdate + INTERVAL 182 DAY, '%Y-%m-%dT%H:%M:%SZ') || chr(10) ELSE '' END
      || CASE WHEN o_orderkey % 5 = 0 THEN 'graph' || chr(9) || sha256('g' || o_orderkey) || chr(10) ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'message' || chr(10) || 'order of ' || o_orderpriority || chr(10) ELSE '' END) AS digest FROM o"""
)
def encode_versions(spark, d):
    o = rel.table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.select(
        k.alias("k"), F.sha2(F.concat(F.lit("m"), k), 256).alias("m"), F.sha2(F.lag(k).over(w), 256).alias("p"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"), F.col("o_orderdate").alias("time"),
        F.when(F.col("o_orderkey") % 3 == 0, F.expr("o_orderdate + INTERVAL 182 DAY")).alias("expiry"), F.when(F.col("o_orderkey") % 5 == 0, F.sha2(F.concat(F.lit("g"), k), 256)).alias("g"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("order of "), "o_orderpriority")).otherwise("").alias("message"),
    )
    return codec.digested(rows, "version", lambda r: codec.Version(r["m"], r["author"], r["time"], (r["p"],) if r["p"] else (), r["expiry"], r["g"], r["message"]), "k").select("kind", F.col("key").alias("content"), "digest")


@_query(
    """WITH e AS (SELECT DISTINCT l_orderkey, 's/' || l_suppkey AS s, 'p/' || l_partkey AS t, lower(l_returnflag) AS k FROM lineitem),
    x AS (SELECT l_orderkey, string_agg('edge' || chr(9) || s || chr(9) || t || chr(9) || k || chr(10), '' ORDER BY s, t, k) AS edges FROM e GROUP BY 1)
    SELECT 'graph' AS kind, CAST(l_orderkey AS VARCHAR) AS content, sha256('quarrystone-graph v1' || chr(10) || 'extractor' || chr(9) || 'orders' || chr(9) || 'v' || (l_orderkey % 3) || chr(9) || '*' || chr(10) || edges) AS digest FROM x"""
)
def encode_graphs(spark, d):
    li = rel.table(spark, d, "lineitem")
    edge = F.struct(F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("t"), F.lower("l_returnflag").alias("k"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(edge)).alias("edges")).withColumn("k", F.col("l_orderkey").cast("string"))
    return codec.digested(rows, "graph", lambda r: codec.Graph((("orders", f"v{r['l_orderkey'] % 3}", "*"),), tuple((e["s"], e["t"], e["k"]) for e in r["edges"])), "k").select("kind", F.col("key").alias("content"), "digest")


@_query(f"SELECT 'signature' AS kind, CAST(o_orderkey AS VARCHAR) AS content, sha256('quarrystone-signature v1' || chr(10) || 'version' || chr(9) || {_H} || chr(10) || 'key' || chr(9) || 'k' || o_custkey || chr(10) || 'signature' || chr(9) || substr(sha256('s' || o_orderkey), 1, 32) || chr(10)) AS digest FROM orders")
def encode_signatures(spark, d):
    k = F.col("o_orderkey").cast("string")
    rows = rel.table(spark, d, "orders").select(k.alias("k"), F.sha2(k, 256).alias("v"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key_name"), F.unhex(F.substring(F.sha2(F.concat(F.lit("s"), k), 256), 1, 32)).alias("raw"))
    return codec.digested(rows, "signature", lambda r: codec.Signature(r["v"], r["key_name"], bytes(r["raw"])), "k").select("kind", F.col("key").alias("content"), "digest")


# paths: normal form and full folding, places of objects


@_query("SELECT doc_id, nfc_normalize(source || '/Cafe' || chr(769) || CASE WHEN doc_id % 2 = 0 THEN 'u' || chr(776) ELSE 'ü' END || lang) AS path, nfc_normalize(source || '/Cafe' || chr(769) || CASE WHEN doc_id % 2 = 0 THEN 'u' || chr(776) ELSE 'ü' END || lang) <> source || '/Café' || CASE WHEN doc_id % 2 = 0 THEN 'u' || chr(776) ELSE 'ü' END || lang AS changed FROM documents")
def paths_to_nfc(spark, d):
    tail = F.when(F.col("doc_id") % 2 == 0, "ü").otherwise("ü")
    spelled = F.concat("source", F.lit("/Café"), tail, "lang")
    return rel.table(spark, d, "documents").select("doc_id", paths.nfc(spelled).alias("path"), (paths.nfc(spelled) != F.concat("source", F.lit("/Café"), tail, "lang")).alias("changed"))


@_query(
    """WITH p AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'É' WHEN 1 THEN 'é' WHEN 2 THEN 'ΑΩ' ELSE 'αω' END || '/' || lang || '/' || (doc_id % 25) AS path FROM documents)
    SELECT lower(path) AS fold, min(path) AS first_path, max(path) AS last_path, count(*) AS n_paths FROM p GROUP BY 1 HAVING count(*) > 1"""
)
def path_collisions_by_full_folding(spark, d):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "É").when(k == 1, "é").when(k == 2, "ΑΩ").otherwise("αω")
    return paths.collisions(rel.table(spark, d, "documents").select(F.concat(head, F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 25).cast("string")).alias("path")))


@_query("SELECT DISTINCT 'objects/chunk/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || substr(sha256(text), 5) AS path, 'chunk' AS kind, sha256(text) AS digest FROM documents")
def object_places(spark, d):
    """A10: objects' places and their keys read back from them."""
    place = ids.object_place(F.lit("chunk"), F.sha2("text", 256))
    return rel.table(spark, d, "documents").select(place.alias("path")).distinct().select("path", *ids.key_of_place(F.col("path")))


# locks


@_query(sql("held", "event_locks", of="SELECT path FROM held WHERE path NOT IN (SELECT path FROM event_locks WHERE owner = 'u1') UNION SELECT path FROM event_locks WHERE owner = 'u3'"))
def held_after(spark, d):
    """The paths held after some locks were given back and others taken."""
    now = rel.event_locks(spark, d)
    return locks.remember(locks.forget(rel.held_locks(spark, d), now.where("owner = 'u1'")), now.where("owner = 'u3'"))


@_query(sql("event_locks", of=f"SELECT path, owner, {_LIVE} AS live, CASE WHEN owner = 'u1' THEN 'held' WHEN {_LIVE} THEN 'refused' ELSE 'taken over' END AS outcome FROM event_locks"))
def lock_attempts(spark, d):
    """What becomes of u1's attempt to lock every locked path."""
    live = ~locks.expired(F.col("since"), NOW)
    return rel.event_locks(spark, d).select("path", "owner", live.alias("live"), F.when(F.col("owner") == "u1", "held").when(live, "refused").otherwise("taken over").alias("outcome"))


# planned states of the verbs


@_query(sql("scan", "cache", of="""SELECT s.path, CASE WHEN c.size = s.size AND c.mtime_ns = s.mtime_ns THEN c.file_id ELSE sha256(s.path || '@' || s.mtime_ns) END AS file_id, s.size FROM scan s LEFT JOIN cache c USING (path)"""))
def commit_manifest(spark, d):
    """The manifest that a commit records: files of the cache where it vouches for them, else of a new hash."""
    seen = rel.scan(spark, d)
    fresh = manifest.fresh(seen, rel.cache(spark, d)).select("path", F.sha2(F.concat("path", F.lit("@"), F.col("mtime_ns").cast("string")), 256).alias("file_id"))
    return manifest.build(manifest.recorded(seen, rel.cache(spark, d), fresh))


@_query(
    sql("m", of="""SELECT count(*) FILTER (m.file_id IS NOT NULL AND m.file_id IS DISTINCT FROM o.file_id) AS written, count(*) FILTER (m.file_id IS NULL AND o.file_id IS NOT NULL) AS removed, count(*) FILTER (conflict IS NOT NULL) AS conflicts,
    CAST(COALESCE(sum(m.size) FILTER (m.file_id IS NOT NULL AND m.file_id IS DISTINCT FROM o.file_id), 0) AS BIGINT) AS bytes_written FROM m LEFT JOIN ours o USING (path)""")
)
def sync_result(spark, d):
    """The counts that a sync reports."""
    rows = manifest.merge(rel.base(spark, d), rel.ours(spark, d), rel.theirs(spark, d))
    return manifest.sync_result(rows)


@_query(sql("before", "scan", of="SELECT path, b.file_id, b.size, s.path IS NULL AS missing FROM before b LEFT JOIN scan s USING (path) WHERE s.path IS NULL OR s.size <> b.size"))
def restore_plan(spark, d):
    """What a restore writes into a tree: files that aren't there or have another size."""
    return manifest.restore_plan(rel.before(spark, d), rel.scan(spark, d))


@_query(sql("changes", of="SELECT path_before AS path FROM changes WHERE path_before IS NOT NULL UNION SELECT path_after FROM changes WHERE path_after IS NOT NULL"))
def touched_paths(spark, d):
    return manifest.touched(manifest.diff(rel.before(spark, d), rel.after(spark, d)))


@_query(sql("after", of="SELECT path, text FROM (SELECT path, CASE WHEN size < 1024 THEN size || ' B' ELSE printf('%.1f KiB', size / 1024.0::DOUBLE) END AS text FROM after)"))
def listing_lines(spark, d):
    return rel.after(spark, d).select("path", text.human_bytes(F.col("size")).alias("text"))
