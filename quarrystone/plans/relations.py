"""Relations of the engine derived from the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "2024-01-29 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_path() -> Column:
    return F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _manifest(docs: DataFrame, path: Column, file_id: Column) -> DataFrame:
    return docs.select(path.alias("path"), file_id.alias("file_id"), F.col("n_chars").alias("size"))


def _mod(n: int, r: int = 0) -> Column:
    return F.col("doc_id") % n == r


def _id(tag: str = "") -> Column:
    return F.sha2(F.concat("text", F.lit(tag)) if tag else F.col("text"), 256)


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(table(spark, sf_dir, "documents").where(~_mod(10)), _doc_path(), _id())


def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(~_mod(10, 1))
    path = F.when(_mod(7), F.concat(F.lit("moved/"), _doc_path())).otherwise(_doc_path())
    return _manifest(docs, path, F.when(_mod(13), _id("#v2")).otherwise(_id()))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return before(spark, sf_dir)


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where((~_mod(10) | _mod(3)) & ~_mod(11))
    return _manifest(docs, _doc_path(), F.when(_mod(13), _id("#ours")).when(_mod(17), _id("#both")).otherwise(_id()))


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where((~_mod(10) | _mod(4)) & ~_mod(19))
    return _manifest(docs, _doc_path(), F.when(_mod(7) | (_mod(10) & _mod(12)), _id("#theirs")).when(_mod(17), _id("#both")).otherwise(_id()))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(~_mod(9))
    return d.select(_doc_path().alias("path"), (F.col("n_chars") + F.when(_mod(14), 1).otherwise(0)).cast("long").alias("size"), (F.col("doc_id") * 1000 + F.when(_mod(15), 7).otherwise(0)).alias("mtime_ns"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(~_mod(8))
    return d.select(_doc_path().alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns"), _id().alias("file_id"))


def doc_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(_mod(3))
    return d.select(_doc_path().alias("path"), F.col("source").alias("owner"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id % 40 AS INT))").alias("since"))


def event_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("since"))
    return e.select(F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("owner"), "since")


def held_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 2 = 0")
    more = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("gone/"), F.col("c_custkey").cast("string")).alias("path"))
    return e.select(F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path")).union(more)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("snapshots/e"), F.col("event_id").cast("string")).alias("ref_name"), F.col("ts").alias("time"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent): an order's parent is the customer's order before it."""
    o = table(spark, sf_dir, "orders")
    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_orderkey").alias("node"), prev.alias("parent"), "o_custkey", "o_orderdate")


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of every 50th customer."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 50 = 0")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select(F.col("m.o_orderkey").alias("node"))


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("file_id"), F.row_number().over(w).cast("long").alias("seq"), F.col("l_partkey").alias("chunk_id"), F.col("l_quantity").cast("long").alias("length"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_size").cast("long").alias("age_hours"), F.length("p_name").cast("long").alias("size"))


#: The same relations as DuckDB views, prefixed to each query's SQL.
_PATH = "'docs/' || lang || '/' || source || '/' || doc_id || '.txt'"
SQL = {
    "before": f"SELECT {_PATH} AS path, sha256(text) AS file_id, n_chars AS size FROM documents WHERE doc_id % 10 <> 0",
    "after": f"SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE '' END || {_PATH} AS path, CASE WHEN doc_id % 13 = 0 THEN sha256(text || '#v2') ELSE sha256(text) END AS file_id, n_chars AS size FROM documents WHERE doc_id % 10 <> 1",
    "base": f"SELECT {_PATH} AS path, sha256(text) AS file_id, n_chars AS size FROM documents WHERE doc_id % 10 <> 0",
    "ours": f"SELECT {_PATH} AS path, CASE WHEN doc_id % 13 = 0 THEN sha256(text || '#ours') WHEN doc_id % 17 = 0 THEN sha256(text || '#both') ELSE sha256(text) END AS file_id, n_chars AS size FROM documents WHERE (doc_id % 10 <> 0 OR doc_id % 3 = 0) AND doc_id % 11 <> 0",
    "theirs": f"SELECT {_PATH} AS path, CASE WHEN doc_id % 7 = 0 OR (doc_id % 10 = 0 AND doc_id % 12 = 0) THEN sha256(text || '#theirs') WHEN doc_id % 17 = 0 THEN sha256(text || '#both') ELSE sha256(text) END AS file_id, n_chars AS size FROM documents WHERE (doc_id % 10 <> 0 OR doc_id % 4 = 0) AND doc_id % 19 <> 0",
    "scan": f"SELECT {_PATH} AS path, CAST(n_chars + CASE WHEN doc_id % 14 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size, doc_id * 1000 + CASE WHEN doc_id % 15 = 0 THEN 7 ELSE 0 END AS mtime_ns FROM documents WHERE doc_id % 9 <> 0",
    "cache": f"SELECT {_PATH} AS path, n_chars AS size, doc_id * 1000 AS mtime_ns, sha256(text) AS file_id FROM documents WHERE doc_id % 8 <> 0",
    "doc_locks": f"SELECT {_PATH} AS path, source AS owner, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 40 AS INTEGER)) AS since FROM documents WHERE doc_id % 3 = 0",
    "event_locks": "SELECT 'users/' || user_id AS path, 'u' || (user_id % 5) AS owner, max(ts) AS since FROM events GROUP BY user_id",
    "held": "SELECT DISTINCT 'users/' || user_id AS path FROM events WHERE user_id % 2 = 0 UNION ALL SELECT 'gone/' || c_custkey FROM customer WHERE c_custkey % 10 = 0",
    "timeline": "SELECT 'snapshots/e' || event_id AS ref_name, ts AS time FROM events",
    "versions": "SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, o_custkey, o_orderdate FROM orders",
    "roots": "SELECT o_orderkey AS node FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_custkey % 50 = 0) WHERE k = 1",
    "file_chunks": "SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS seq, l_partkey AS chunk_id, CAST(l_quantity AS BIGINT) AS length FROM lineitem",
    "objects": "SELECT p_partkey AS chunk_id, CAST(p_size AS BIGINT) AS age_hours, CAST(length(p_name) AS BIGINT) AS size FROM part",
}
_NEEDS = {"walk": ("versions", "roots"), "changes": ("before", "after"), "m": ("base", "ours", "theirs"), "reach": ("walk", "file_chunks"), "fates": ("reach", "objects"), "ret": ("timeline",)}
SQL |= {
    "walk": "SELECT node, CAST(0 AS BIGINT) AS depth, node AS root FROM roots UNION ALL SELECT v.parent, w.depth + 1, w.root FROM walk w JOIN versions v ON v.node = w.node WHERE v.parent IS NOT NULL",
    "changes": """SELECT 'changed' AS kind, b.path AS path_before, a.path AS path_after, b.file_id AS file_before, a.file_id AS file_after, b.size AS size_before, a.size AS size_after
      FROM before b JOIN after a ON a.path = b.path WHERE a.file_id <> b.file_id
      UNION ALL SELECT CASE WHEN r.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'removed' ELSE 'renamed' END, r.path, d.path, r.file_id, d.file_id, r.size, d.size
      FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY path) AS k FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.path = b.path)) r
      FULL OUTER JOIN (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY path) AS k FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE a.path = b.path)) d ON r.file_id = d.file_id AND r.k = d.k""",
    "m": """SELECT path, CASE WHEN pick = 't' THEN tf ELSE fo END AS file_id, CASE WHEN pick = 't' THEN ts ELSE os END AS size, conflict, fo AS ours_file, os AS ours_size, tf AS theirs_file, ts AS theirs_size FROM (
      SELECT p.path, b.file_id AS bf, o.file_id AS fo, o.size AS os, t.file_id AS tf, t.size AS ts,
        CASE WHEN o.file_id IS NULL AND t.file_id IS NULL THEN 'o' WHEN b.file_id IS NULL AND o.file_id IS NULL THEN 't' WHEN o.file_id = t.file_id THEN 'o'
          WHEN b.file_id = o.file_id THEN 't' WHEN o.file_id IS NULL AND t.file_id = b.file_id THEN 'o' WHEN o.file_id IS NULL THEN 't' ELSE 'o' END AS pick,
        CASE WHEN o.file_id IS NULL AND t.file_id IS NULL THEN NULL WHEN o.file_id = t.file_id THEN NULL
          WHEN b.file_id IS NULL AND o.file_id IS NOT NULL AND t.file_id IS NOT NULL THEN 'both_added' WHEN b.file_id IS NULL THEN NULL
          WHEN o.file_id = b.file_id OR t.file_id = b.file_id THEN NULL
          WHEN t.file_id IS NULL THEN 'changed_here_deleted_there' WHEN o.file_id IS NULL THEN 'deleted_here_changed_there' ELSE 'both_changed' END AS conflict
      FROM (SELECT path FROM base UNION SELECT path FROM ours UNION SELECT path FROM theirs) p LEFT JOIN base b USING (path) LEFT JOIN ours o USING (path) LEFT JOIN theirs t USING (path))""",
    "reach": "SELECT DISTINCT c.chunk_id FROM file_chunks c JOIN walk w ON w.node = c.file_id",
    "fates": "SELECT o.*, CASE WHEN r.chunk_id IS NOT NULL THEN 'live' WHEN o.age_hours >= 10 THEN 'deleted' ELSE 'spared' END AS fate FROM objects o LEFT JOIN reach r USING (chunk_id)",
    "ret": f"""SELECT *, bucket IS NOT NULL AND row_number() OVER (PARTITION BY bucket ORDER BY time DESC, ref_name DESC) = 1 AS kept FROM (SELECT *, CASE
      WHEN time > TIMESTAMP '{NOW}' THEN 'future/' || strftime(time, '%Y-%m-%dT%H:%M:%SZ') WHEN TIMESTAMP '{NOW}' - time <= INTERVAL 24 HOUR THEN 'hour/' || strftime(time, '%Y-%m-%dT%H')
      WHEN TIMESTAMP '{NOW}' - time <= INTERVAL 7 DAY THEN 'day/' || strftime(time, '%Y-%m-%d')
      WHEN TIMESTAMP '{NOW}' - time <= INTERVAL 21 DAY THEN 'week/' || lpad(CAST(isoyear(time) AS VARCHAR), 4, '0') || '-' || lpad(CAST(week(time) AS VARCHAR), 2, '0') END AS bucket FROM timeline)""",
}


def sql(*views: str, of: str) -> str:
    """A query with the views that it needs, in order."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in _NEEDS.get(v, ()):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return ("WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL[v]})" for v in order) + " " if order else "") + of
