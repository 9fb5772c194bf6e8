"""Document fingerprints: a bottom-k sketch of word-shingle hashes.

The sketch keeps the k smallest of a text's distinct shingle hashes.  Sketches of parts
merge into the sketch of the whole, and estimate resemblance (Jaccard), containment and the
number of distinct shingles.  Up to k distinct shingles every estimate is exact.

Edge cases: a null text counts as empty; an empty text has an empty sketch, with likeness 1
to another empty one and 0 to any other; equal texts have equal sketches; a text of fewer
words than a shingle has its whole word sequence as its one shingle.  Ids are cast to long;
rows with one id follow each other by their texts, a null id comes first, the only
row follows itself, and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, encode, table

#: Hashes that a sketch keeps: the standard error of a resemblance is at most 0.5 / sqrt(K).
K = 256
WORDS = 5


def sketch_hashes(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of a bag of 64-bit hashes: the k smallest distinct ones, ascending."""
    if len(hashes) > 8 * k:  # all copies of the k smallest are below the cut, unless copies fill it
        part = np.unique(np.partition(hashes, 4 * k)[: 4 * k + 1])
        if len(part) > k:
            return part[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    return sketch_hashes(Words([encode(text)], lower=True).shingles(words)[0], k)


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of the sketched sets."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, np.uint64)


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**64 / (float(s[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness, from the k smallest hashes of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # a set of at most k hashes is whole; of a larger one only hashes up to its k-th are known
    limit = min(a[-1] if len(a) >= k else np.uint64(2**64 - 1), b[-1] if len(b) >= k else np.uint64(2**64 - 1))
    a, b = a[a <= limit], b[b <= limit]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    j, n, m = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return min(1.0, j / (1 + j) * (n + m) / n)


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Adds ``fingerprint`` (base64 text) to every row of ``docs``, in place of a column of that name; no shuffle."""
    @F.arrow_udf("string")
    def of(t: pa.Array) -> pa.Array:
        return pa.array([to_text(sketch(x, k, words)) for x in t.to_pylist()], pa.string())

    return docs.withColumn("fingerprint", of(F.col(text)))


def merged(df: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """The fingerprint of each key's union of parts; null fingerprints add nothing.

    Only the parts' hashes move: each is one long, distinct per key before and after the shuffle,
    and the k smallest are kept by salted rounds, so that a hot key never meets whole in one task.
    """
    @F.arrow_udf("string")
    def pack(v: pa.Array) -> pa.Array:
        return pa.array([to_text(merge(*[from_text(x) for x in xs], k=k)) for xs in v.to_pylist()], pa.string())

    part = df.select(key, F.col(fingerprint).alias("_f")).withColumn("_s", F.pmod(F.xxhash64("_f"), F.lit(1 << 16)).cast("int"))
    for bits in (8, 0):  # two rounds of at most about 256 sketches a task for up to 65,536 parts, and distinct ones only
        part = (
            part.select(key, F.col("_s").bitwiseAND((1 << bits) - 1).alias("_s"), "_f").distinct()
            .groupBy(key, "_s").agg(F.collect_list("_f").alias("_f")).withColumn("_f", pack("_f"))
        )
    return part.select(key, F.col("_f").alias(fingerprint))


#: Buckets of neighbouring rows for each shuffle partition; sampled places for each bucket, which the driver sorts; code points of a text in a place.
BUCKETS, SAMPLED, PREFIX = 2, 50, 64
#: Stands for a null key: the least one.
_LEAST = -(1 << 63)


def neighbour_cuts(docs: DataFrame, key: str, text: str, buckets: int) -> tuple[list[tuple[int, str]], bool]:
    """(least places of the buckets, whether equal keys are parted by the first code points of their texts).

    Places are those of sampled rows, so each cut is the place of a row, and the first cut is the
    least place of all.  Only SAMPLED places a bucket reach the driver.  Texts are read only where
    few keys have more than a bucket's rows.
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(_LEAST))
    n, least = docs.select(F.count("*"), F.min(k)).first()
    if not n:
        return [], False
    share = min(1.0, SAMPLED * buckets / n)

    def cuts(places: DataFrame, first: tuple[int, str]) -> list[tuple[int, str]]:
        got = sorted(tuple(r) for r in places.sample(share, 7).collect())
        return sorted({first, *(got[len(got) * i // buckets] for i in range(1, buckets) if got)})

    out = cuts(docs.select(k, F.lit("")), (least, ""))
    if n <= 2 * buckets or len(out) > 3 * buckets // 4:
        return out, False
    at = docs.select(k.alias("k"), _prefix(F.col(text)).alias("h"))
    return cuts(at, tuple(at.agg(F.min(F.struct("k", "h")).alias("m")).select("m.*").first())), True


def _prefix(text):
    return F.substring(F.coalesce(text.cast("string"), F.lit("")), 1, PREFIX)


def _literal(places: list, kind: str):
    """A constant array of places, as one literal."""
    return F.from_json(F.lit(json.dumps(places)), kind)


def with_next(docs: DataFrame, score, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Applies ``score`` to each row and its successor by ``key``; the last row's successor is the first row.

    One shuffle: rows go to buckets of neighbouring keys, found by a two-step search in a literal
    of cuts, and the rows at a bucket's cut go also to the bucket before it.  ``score(rows)`` gets
    an iterator of (key, text, next text).  Keys are cast to long; rows with equal keys follow
    each other by text; null keys come first.
    """
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, parted = neighbour_cuts(docs, key, text, buckets)
    cuts = cuts or [(_LEAST, "")]
    wide = max(1, math.isqrt(len(cuts)))
    fine = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    place = lambda c: {"k": c[0], "h": c[1]}
    one = "array<struct<k:bigint,h:string>>"
    coarse, lists = _literal([place(f[0]) for f in fine], one), _literal([[place(c) for c in f] for f in fine], f"array<{one}>")
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_t"))
    rows = rows.withColumn("_p", F.struct(F.coalesce("_k", F.lit(_LEAST)).alias("k"), (_prefix(F.col("_t")) if parted else F.lit("")).alias("h")))
    upto = lambda a: F.size(F.filter(a, lambda c: c <= F.col("_p")))
    rows = rows.withColumn("_g", F.greatest(upto(coarse), F.lit(1))).withColumn("_c", F.element_at(lists, F.col("_g"))).withColumn("_n", upto(F.col("_c")))
    home = ((F.col("_g") - 1) * wide + F.greatest(F.col("_n"), F.lit(1)) - 1).cast("int")
    # a row at its bucket's cut goes also to the end of the bucket before; the first bucket's to the last
    head = F.element_at("_c", F.greatest(F.col("_n"), F.lit(1))) == F.col("_p")
    own, tail = F.struct(home.alias("b"), F.lit(0).alias("tail")), F.struct(F.pmod(home - 1, F.lit(len(cuts))).cast("int").alias("b"), F.lit(1).alias("tail"))
    dealt = rows.select(F.explode(F.when(head, F.array(own, tail)).otherwise(F.array(own))).alias("_d"), "_k", "_t").select("_d.b", "_d.tail", "_k", "_t")
    dealt = dealt.repartitionById(len(cuts), "b").sortWithinPartitions("b", "tail", F.col("_k").asc_nulls_first(), F.col("_t").asc_nulls_first())

    def rows_of(batches):
        """(key, text, next text) of each row that is at home in its bucket."""
        held, done = None, False
        for batch in batches:
            for bk, tail, k, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None and held[0] == bk and not done:
                    yield held[1], held[2], t
                if tail:
                    done = True  # the tail's first row ends the bucket
                else:
                    held, done = (bk, k, t), False

    def run(batches):
        yield from score(rows_of(batches))

    return dealt.mapInArrow(run, schema)


def edited(text: str, after: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, in_edited double"


def _score(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    out: list[tuple] = []
    known: tuple[str | None, np.ndarray | None] = (None, None)  # the next text is soon the own text
    last: tuple | None = None  # own text, next text and their results: copies may follow each other

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for k, own, after in rows:
        own, after = own or "", after or ""
        if last is None or last[0] != own or last[1] != after:
            other = edited(own, after)
            a = known[1] if known[0] is not None and known[0] == own else sketch(own)
            n, e = (a if after == own else sketch(after)), sketch(other)
            known = after, n
            last = own, after, (len(own), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), to_text(a), to_text(e), resemblance(a, e), resemblance(a, n), distinct(a), containment(a, e))
        out.append((k, *last[2]))
        if len(out) >= 512:
            yield flush()
            out.clear()
    if out:
        yield flush()


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with the likeness to it and to the next document."""
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), _score, OUT)
