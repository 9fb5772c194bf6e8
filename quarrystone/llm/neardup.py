"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification, components.

All signature coordinates come from two fixed permutations: a shingle is placed by the first,
and coordinate i is the least value of the second one over the places shifted circularly by i.
Texts with equal shingle sets form a class first, and only one text of a class goes on.
Texts that share a band meet in a bucket: every member is verified on full sets against the
bucket's least member and links are contracted to components; where a bucket's members are
still in different components, all its pairs are verified too, block by block, in tasks that
hold two blocks of bounded size.  So no link depends on a cap.

Edge cases: a null or blank text has the empty set, links with nothing and is kept; a text of
fewer words than a shingle has one shingle; rows that repeat an id count as one document, whose
texts are linked with each other, each row getting the id's component and its own text's number
of shingles; a row with a null id has a null component and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, overlap, shingle_sets, table
from .graph import components

#: At most so many ids (8 bytes each) are broadcast to pick documents; beyond, the ids are joined by shuffle.
BROADCAST_IDS = 500_000
#: The chance that a pair just at the threshold shares no band.
MISS = 1e-6
MOST_COORDINATES = 128


def banding(threshold: float, miss: float = MISS, most: int = MOST_COORDINATES) -> tuple[int, int]:
    """(bands, rows of a band): the most rows that keep the miss rate within ``most`` coordinates."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the threshold is too low for so few coordinates")
    return best


_BLOCK = 2048


def _second(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit words, in place; ``t`` is work space."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=t)
    np.bitwise_xor(x, t, out=x)
    return x


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit shingle hashes."""
    place = (mix64(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(place), _BLOCK):
        x = place[None, i : i + _BLOCK] + shift
        np.minimum(out, _second(x, np.empty_like(x)).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit bucket keys of each band; keys of different bands differ."""
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        h = mix64(h + sig[j::rows][:bands].astype(np.uint64))
    return h


def profiles(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set (d1, d2) and the band keys; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            size, d1, d2, keys = [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), words):
                n = len(s)
                d = (int(s.sum(dtype=np.uint64)), int(mix64(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)))
                k = known.get(d) if n else np.zeros(0, np.uint64)
                if k is None:
                    if len(known) >= 20_000:
                        known.clear()
                    k = known[d] = band_keys(signature(s, bands * rows), bands, rows)
                size.append(n)
                d1.append(d[0])
                d2.append(d[1])
                keys.append(k)
            off = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
            as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), as_long(d1), as_long(d2), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))], names=["doc_id", "n", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def picked(docs: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """The documents whose id is in ``ids`` (or isn't: left_anti); the ids are broadcast only if they are few enough."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with the exact Jaccard distance of their full sets, and whether they are linked."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = picked(docs.select("doc_id", "text"), ids)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), "a", "b")
    met = asked.join(texts, "doc_id").select("a", "b", "doc_id", "text").repartition("a", "b").sortWithinPartitions("a", "b", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, last_text, last_set = None, [], None, None
        out: list[tuple] = []

        def close() -> None:
            sets: dict[int, list[np.ndarray]] = {}
            for d, s in held:
                sets.setdefault(d, []).append(s)
            if len(sets) == 2:
                x, y = (list(v) for v in sets.values())
                best = (1.0, False)
                for s in x:
                    for t in y:
                        both = overlap(s, t)
                        union = len(s) + len(t) - both
                        if union:
                            best = min(best, (1 - both / union, 100 * both >= percent * union), key=lambda z: (not z[1], z[0]))
                out.append((*key, *best))

        def flush() -> pa.RecordBatch:
            a, b, d, k = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64()), pa.array(k, pa.bool_())], names=["a", "b", "distance", "linked"])

        for batch in batches:
            for a, b, d, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != (a, b):
                    if key:
                        close()
                    key, held = (a, b), []
                if t != last_text or last_set is None:
                    last_text, last_set = t, next(shingle_sets([t], words))
                held.append((d, last_set))
            if out:
                yield flush()
                out.clear()
        if key:
            close()
        if out:
            yield flush()

    return met.mapInArrow(run, "a long, b long, distance double, linked boolean")


#: Members of a bucket that are compared with each other, or with as many others, in one task.
BLOCK_MEMBERS = 512
#: Cells of the membership matrix that a block fills at a time.
CELLS = 1 << 22


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices over slices of the shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1  # a shingle of one set is in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, wide = np.zeros((len(sets), len(sets)), np.float32), max(1, CELLS // max(1, len(sets)))
    for lo in range(0, int(shared.sum()), wide):
        i, j = np.searchsorted(column, [lo, lo + wide])
        m = np.zeros((len(sets), min(wide, int(shared.sum()) - lo)), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def block_links(reps: list[int], parts: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different parts, as many as it takes to connect what the block's pairs connect."""
    size = np.array([len(s) for s in sets])
    both = intersections(sets)
    union = size[:, None] + size[None, :] - both
    part = np.array(parts)
    x, y = np.nonzero(np.triu((100 * both >= percent * union) & (union > 0) & (part[:, None] != part[None, :])))
    up = {p: p for p in parts}

    def find(p: int) -> int:
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    out = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = find(parts[i]), find(parts[j])
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return out


def blocks_verified(docs: DataFrame, left: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different parts of a bucket, from all pairs of its members' full sets.

    ``left``: (bucket, rep, part, members).  A large bucket is cut into blocks of BLOCK_MEMBERS;
    every two blocks meet in a task of their own, which holds two blocks and returns at most a link
    for each member.  A bucket of up to BLOCK_MEMBERS sends each text once; one of m members that
    are still apart sends each m / BLOCK_MEMBERS times, as any exact comparison of all pairs in
    bounded memory must."""
    n = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("rep", "bucket"), n).cast("int")
    met = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    asked = left.select("bucket", F.col("rep").alias("doc_id"), "part", F.explode(met).alias("k")).select("bucket", "k.i", "k.j", "doc_id", "part")
    texts = picked(docs.select("doc_id", "text"), left.select(F.col("rep").alias("doc_id")).distinct())
    dealt = asked.join(texts, "doc_id").select("bucket", "i", "j", "doc_id", "part", "text").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, parts, sets = None, [], [], []
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            out: list[tuple[int, int]] = []
            for b, i, j, d, p, t in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if key != (b, i, j):
                    if len(reps) > 1:
                        out += block_links(reps, parts, sets, percent)
                    key, reps, parts, sets = (b, i, j), [], [], []
                s = known.get(t)
                if s is None:
                    if len(known) >= 1000:
                        known.clear()
                    s = known[t] = next(shingle_sets([t], words))
                reps.append(d)
                parts.append(p)
                sets.append(s)
            if out:
                yield _links(out)
        if len(reps) > 1 and (out := block_links(reps, parts, sets, percent)):
            yield _links(out)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def shared_ids(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, rep) of the ids whose rows have several texts: the class of each, null for the empty set."""
    several = rows.groupBy("doc_id").agg(*(f(c).alias(n) for n, f, c in (("a", F.min, "d1"), ("b", F.max, "d1"), ("c", F.min, "d2"), ("d", F.max, "d2")))).where("doc_id IS NOT NULL AND (a <> b OR c <> d)")
    asked = rows.join(several.select("doc_id"), "doc_id").select("doc_id", "d1", "d2", "n").distinct()
    return asked.join(sets.select("d1", "d2", "rep"), ["d1", "d2"], "left").select("doc_id", F.when(F.col("n") > 0, F.col("rep")).alias("rep"))


def near_components(docs: DataFrame, words: int, percent: int, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    if not bands or not rows:
        bands, rows = banding(percent / 100)
    seen = cut(profiles(docs, words, bands, rows), "profiles")
    keyed = seen.where("n > 0 AND doc_id IS NOT NULL")
    # one text of each set goes on; links between ids that share a set come from the class itself
    sets = cut(keyed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "sets")
    # an id with several texts is a document of several classes: its least one is linked with the others
    several = cut(shared_ids(seen, sets), "several")
    repeated = several.where("rep IS NOT NULL")
    repeated = repeated.join(repeated.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    any_repeated = not several.isEmpty()
    slots = sets.select("rep", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("leader")).where("members > 1")
    met = cut(slots.join(shared, "bucket").select("bucket", "rep", "leader"), "buckets")
    pairs = cut(met.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    tried = cut(verified(docs, pairs, words, percent), "tried")
    links = tried.where("linked").select("a", "b")
    if any_repeated:
        links = links.union(repeated)
    parts = cut(components(links, "a", "b"), "parts")
    # buckets whose members are still apart: their rest is verified block by block
    placed = met.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    apart = placed.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("bucket", "members")
    left = cut(placed.join(apart, "bucket").select("bucket", "rep", "part", "members"), "left")
    more = cut(blocks_verified(docs, left, words, percent), "more")
    if not more.isEmpty():
        parts = cut(components(links.union(more), "a", "b"), "parts")
    classes = sets.join(parts.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 OR component IS NOT NULL").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    found = seen.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    if any_repeated:  # all rows of an id get its component, those without words too
        of = several.where("rep IS NOT NULL").join(parts.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("_least"))
        found = found.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_least", "component_id").alias("component_id"))
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """near_components() and ``kept``: whether the row's id is its component's."""
    return near_components(docs, words, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; rows with null ids stay."""
    gone = cut(near_duplicates(docs.select("doc_id", "text"), words, percent).where("NOT kept").select("doc_id").distinct(), "gone")
    return picked(docs, gone, how="left_anti")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)

