"""The object store's relations: existence, verification, reachability, sweep, dirty check, dedup reports
(A6-A8, A11, C6-C8, C17-C18, D1-D3, D5, D7-D9, E5, G4-G5, H3-H5, I8-I9)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.errors import EngineError
from quarrystone.functions.ids import DEFAULT, ContentHasher, Format, content_id_column

from .history import known


def exists(keys: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    """``keys`` with whether the store has them; ``pos`` columns and repeated keys are kept."""
    there = objects.select(*on).distinct().withColumn("_there", F.lit(True))
    return keys.join(there, on, "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def missing(new: DataFrame, objects: DataFrame, on: tuple[str, ...] = ("kind", "digest")) -> DataFrame:
    """The rows that a put has to write, one for each key."""
    return new.dropDuplicates(list(on)).join(objects.select(*on), list(on), "left_anti")


def verify(objects: DataFrame, algorithm: str = "blake3", form: Format = DEFAULT) -> DataFrame:
    """I8: objects whose bytes don't have their digest, in the domain of their kind; ``found`` is what they have.

    The identity of files and manifests is that of their content, while their objects list its
    chunks, so these are parsed (``found`` says what is wrong) and their contents left to scrub()."""
    from quarrystone.functions.ids import KINDS

    if algorithm == "sha256":
        found = F.sha2("data", 256)
    else:
        found = F.lit(None).cast("string")
        for k in KINDS:
            found = F.when(F.col("kind") == k, content_id_column(k, F.when(F.col("kind") == k, F.col("data")), algorithm, form)).otherwise(found)
    of_bytes = objects.where(~F.col("kind").isin("file", "manifest")).withColumn("found", found).where("found <> digest")
    return of_bytes.select("kind", "digest", "found").union(listing_faults(objects, form))


def listing_faults(objects: DataFrame, form: Format = DEFAULT) -> DataFrame:
    """File and manifest objects that aren't canonical lists of chunks; one pass, no shuffle."""
    from .codec import decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, digest, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    decode("file", data or b"", form)
                except EngineError as e:
                    out.append((kind, digest, f"{type(e).__name__}: {e}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["kind", "digest", "found"])

    return objects.where(F.col("kind").isin("file", "manifest")).select("kind", "digest", "data").mapInArrow(run, "kind string, digest string, found string")


def offsets(file_chunks: DataFrame) -> DataFrame:
    """E5: where each chunk begins in its file."""
    w = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return file_chunks.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))


def file_faults(files: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """D3: files whose chunks don't add up to their size, or that have an empty chunk or a null or zero id."""
    bad = (F.col("length") <= 0) | F.col("chunk_id").isNull() | (F.col("chunk_id").cast("string") == "0" * 64)
    total = file_chunks.groupBy("file_id").agg(F.sum("length").alias("total"), F.count_if(bad).alias("bad_chunks"))
    out = files.join(total, "file_id", "left").select("file_id", F.col("size"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("bad_chunks", F.lit(0)).cast("long").alias("bad_chunks"))
    return out.where("size <> total OR bad_chunks > 0")


def reachable_versions(versions: DataFrame, refs: DataFrame, scopes: tuple[str, ...] = ("local", "remote")) -> DataFrame:
    return known(versions, refs, scopes)


def reachable_objects(versions: DataFrame, refs: DataFrame, entries: DataFrame, file_chunks: DataFrame, manifest_chunks: DataFrame | None = None, signatures: DataFrame | None = None, scopes: tuple[str, ...] = ("local", "remote")) -> DataFrame:
    """H3: (kind, digest) of every object that a ref leads to: versions, graphs, manifests and their chunks, files and theirs, signatures.

    A ref to a version that isn't there, or a version without its manifest, is an error: nothing may be swept then."""
    live = reachable_versions(versions, refs, scopes)
    lost = live.join(versions.select("version_id"), "version_id", "left_anti").limit(1).collect()
    if lost:
        from quarrystone.errors import ObjectNotFound

        raise ObjectNotFound(f"version {lost[0][0]}")
    v = versions.join(live, "version_id", "left_semi")
    key = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).alias("digest"))
    manifests = v.select("manifest_id").distinct()
    files = entries.join(manifests, "manifest_id", "left_semi").select("file_id").distinct()
    parts = [key(v, "version", "version_id"), key(manifests, "manifest", "manifest_id"), key(files, "file", "file_id"), key(file_chunks.join(files, "file_id", "left_semi"), "chunk", "chunk_id")]
    if "graph_id" in v.columns:
        parts.append(key(v.where("graph_id IS NOT NULL"), "graph", "graph_id"))
    if manifest_chunks is not None:  # manifests are stored as files of chunks
        parts.append(key(manifest_chunks.join(manifests, "manifest_id", "left_semi"), "chunk", "chunk_id"))
    if signatures is not None:
        parts.append(key(signatures.join(live, "version_id", "left_semi"), "signature", "signature_id"))
    return reduce(DataFrame.unionByName, parts).distinct()


def sweep(objects: DataFrame, reachable: DataFrame, age_hours: str, grace_hours: float = 1.0, on: tuple[str, ...] = ("kind", "digest")) -> DataFrame:
    """The fate of each object: live, spared (younger than the grace) or deleted; a negative grace spares none."""
    live = reachable.select(*on).distinct().withColumn("_live", F.lit(True))
    old = F.lit(True) if grace_hours < 0 else F.col(age_hours) >= grace_hours
    return objects.join(live, list(on), "left").withColumn("fate", F.when(F.col("_live"), "live").when(old, "deleted").otherwise("spared")).drop("_live")


def sweep_summary(fates: DataFrame, size: str = "size") -> DataFrame:
    """D5."""
    return fates.agg(
        F.count("*").alias("scanned"), F.count_if(F.col("fate") == "live").alias("reachable"), F.count_if(F.col("fate") == "deleted").alias("deleted"),
        F.count_if(F.col("fate") == "spared").alias("spared"), F.coalesce(F.sum(F.when(F.col("fate") == "deleted", F.col(size))), F.lit(0)).cast("long").alias("bytes_deleted"),
    )


def clear_check(present: DataFrame, reachable_files: DataFrame, file_chunks: DataFrame, stored_chunks: DataFrame) -> DataFrame:
    """For each file of the working tree (path, file_id by content): safe, unversioned, or a problem with the number of missing chunks.

    Every path of a file with a missing chunk is a problem.  Missing chunks are counted for each
    file before paths join, so a file with many paths is looked at once."""
    files = reachable_files.select("file_id").distinct().withColumn("_versioned", F.lit(True))
    lost = file_chunks.select("file_id", "chunk_id").distinct().join(stored_chunks.select("chunk_id"), "chunk_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("missing_chunks"))
    met = present.join(files, "file_id", "left").join(lost, "file_id", "left")
    verdict = F.when(F.col("_versioned").isNull(), "unversioned").when(F.col("missing_chunks") > 0, "problem").otherwise("safe")
    return met.select("path", "file_id", verdict.alias("verdict"), F.when(F.col("_versioned"), F.coalesce("missing_chunks", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("missing_chunks"))


def missing_owners(file_chunks: DataFrame, stored_chunks: DataFrame) -> DataFrame:
    """Chunks that files need and the store lacks, each looked up once, with how many files own it and the first."""
    need = file_chunks.groupBy("chunk_id").agg(F.count_distinct("file_id").alias("owners"), F.min("file_id").alias("first_owner"))
    return need.join(stored_chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def dedup_report(file_chunks: DataFrame) -> DataFrame:
    """Bytes and chunks in all, and of distinct chunks."""
    each = file_chunks.groupBy("chunk_id").agg(F.max("length").alias("length"), F.count("*").alias("uses"), F.sum("length").alias("bytes"))
    return each.agg(
        F.sum("uses").cast("long").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum("bytes").cast("long").alias("total_bytes"),
        F.sum("length").cast("long").alias("unique_bytes"), F.count_if(F.col("uses") > 1).alias("shared_chunks"),
    )


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """Files that several paths have: how many, the first path, and the bytes that a single copy saves."""
    g = entries.groupBy("file_id").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.max("size").alias("size"))
    return g.where("copies > 1").select("file_id", "copies", "first_path", (F.col("size") * (F.col("copies") - 1)).cast("long").alias("bytes_saved"))


def new_bytes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset comparison of the chunks (chunk_id, length) of two states: shared and new chunks and bytes."""
    count = lambda df, n: df.groupBy("chunk_id").agg(F.count("*").alias(n), F.max("length").alias(f"{n}_length"))
    met = count(before, "b").join(count(after, "a"), "chunk_id", "full_outer")
    b, a = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    new = F.greatest(a - b, F.lit(0))
    return met.agg(
        F.sum(F.least(a, b)).cast("long").alias("shared_chunks"), F.sum(new).cast("long").alias("new_chunks"),
        F.coalesce(F.sum(new * F.col("a_length")), F.lit(0)).cast("long").alias("new_bytes"),
        F.sum(F.greatest(b - a, F.lit(0))).cast("long").alias("gone_chunks"),
    )


def chunk_sizes(file_chunks: DataFrame, largest: int) -> DataFrame:
    """Mean chunk size and the share of chunks at the largest size."""
    return file_chunks.agg(F.count("*").alias("chunks"), F.avg("length").alias("mean_length"), F.avg((F.col("length") == largest).cast("double")).alias("share_at_largest"))


def budget(files: DataFrame, limit: int) -> DataFrame:
    """Bytes used, and whether a positive budget is reached."""
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("used")).withColumn("reached", (F.lit(limit) > 0) & (F.col("used") >= limit))


def snapshot_counters(status: DataFrame) -> DataFrame:
    """Files, those that had to be hashed, and their bytes."""
    again = F.col("status").isin("new", "modified")
    return status.where("status <> 'missing'").agg(F.count("*").alias("files"), F.count_if(again).alias("hashed"), F.coalesce(F.sum(F.when(again, F.col("scan_size"))), F.lit(0)).cast("long").alias("hashed_bytes"))


def reassembled(file_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """C17: the content of each file, its chunks in order; for files that fit in a row; in_order() is for larger ones."""
    met = file_chunks.join(chunks.select("chunk_id", "data"), "chunk_id")
    return met.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts")).select("file_id", F.concat(F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"]))).alias("data"))


def scrub(file_chunks: DataFrame, chunks: DataFrame, algorithm: str = "blake3", form: Format = DEFAULT) -> DataFrame:
    """Files whose content, read back from the store, doesn't have their id, or lacks a chunk; one shuffle of the content,
    of which a task holds a batch at a time."""
    names = ["file_id", "reason"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file_id,), parts in contents(batches, 1):
            hasher, size, lost = ContentHasher("file", algorithm, form), 0, False
            for length, data in parts:
                size, lost = size + length, lost or data is None
                if not lost:
                    hasher.update(data)
            why = "missing chunk" if lost else "size" if hasher.size != size else "content" if hasher.id() != file_id else None
            if why:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (file_id, why)], names=names)

    return in_order(file_chunks, chunks, ["file_id"]).mapInArrow(run, "file_id string, reason string")


def in_order(file_chunks: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """C17: rows (keys, seq, length, data), those of a key together and in order, for contents() to read as a stream; data is null
    where a chunk isn't there.  The sort spills, so a file may be larger than memory."""
    met = file_chunks.join(chunks.select("chunk_id", "data"), "chunk_id", "left").select(*keys, "seq", "length", "data")
    return met.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "seq")


def contents(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple[int, bytes | None]]]]:
    """Each key of rows from in_order() with its (length, bytes) one after another; a chunk that the store has twice comes once."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                yield tuple(c[i].as_py() for c in b.columns)

    for key, group in itertools.groupby(rows(), lambda r: r[:keys]):
        yield key, (next(same)[keys + 1 :] for _, same in itertools.groupby(group, lambda r: r[keys]))
