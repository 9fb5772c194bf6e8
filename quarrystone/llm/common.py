"""Shared pieces of the training-data operators: tables, scratch space, word and shingle hashing.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D in UTF-8, which are the
words ``[^\\x20\\x09-\\x0D]+`` of the decoded text.  A null text counts as the empty text.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are hashed in groups of about this many bytes, so that numpy's work arrays stay in cache.
GROUP_BYTES = 1 << 18


#: Rows and bytes that Spark hands to Python at a time: texts are long, so Spark's default of 10,000 rows would fill a worker.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset in a local run."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarrystone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_written: dict[str, SparkSession] = {}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = temporary(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/quarrystone/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def sweep() -> None:
    """Removes what was written to temporary(); called when the driver ends."""
    for path, spark in list(_written.items()):
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone by now
            pass
        _written.pop(path, None)


atexit.register(sweep)


def least_hashes(ids: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The ``most`` rows of ``ids`` with the least hashes of their keys, each key once.

    A hash bound goes before the order, so that its one task gets little more than the rows asked for."""
    n = ids.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    some = ids.where(place <= int((1 << 30) * min(1.0, (1.2 * most + 1000) / n))) if n > most else ids
    return some.orderBy(place, key).limit(most)


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def groups(items: Sequence[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``items`` with about ``limit`` bytes each; at least one item."""
    at = size = 0
    for i, x in enumerate(items):
        if i > at and size + len(x) > limit:
            yield at, i
            at, size = i, 0
        size += len(x) + 1
    if at < len(items):
        yield at, len(items)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 19)
        step = np.full(n, _BASE, np.uint64)
        back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        _powers, _inverse = np.cumprod(step), np.cumprod(back)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some texts.

    ``hashes``: 64-bit hash of each word; ``first``: index of each text's first word, with the
    total at the end; ``start``/``end``: byte places in ``data``, the texts joined by spaces;
    ``origin``: byte place of each text.
    """

    __slots__ = ("data", "end", "first", "hashes", "origin", "start")

    def __init__(self, texts: Sequence[bytes], lower: bool = False):
        self.data = data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.origin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        if lower:
            data = _LOWER[data]
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        _grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers[: len(data)], out=total[1:])
        self.hashes = mix64((total[self.end] - total[self.start]) * _inverse[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.append(np.searchsorted(self.start, self.origin), len(self.start))

    def shingles(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words, and where each text's begin (with the total at the end).

        With ``short``, a text of 1 to k-1 words has its whole sequence as its one shingle.
        """
        n = np.diff(self.first)
        count = np.maximum(n - k + 1, (n > 0) if short else 0)
        off = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.first[:-1] - off[:-1], count) + np.arange(off[-1])
        size = np.repeat(np.minimum(n, k), count)
        h = size.astype(np.uint64)
        padded = np.concatenate([self.hashes, np.zeros(k, np.uint64)])
        full = not (size < k).any()
        for j in range(k):
            w = padded[at + j]
            if not full:
                w[size <= j] = 0
            h = h * np.uint64(0xD6E8FEB86659FD93) + w
            h ^= h >> np.uint64(32)
        return mix64(h), off

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and where each text's begin (with the total at the end).

        Differences of one running sum, so that long runs cost as little as short ones."""
        n = np.diff(self.first)
        count = np.maximum(n - k + 1, 0)
        off = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.first[:-1] - off[:-1], count) + np.arange(off[-1])
        _grow(len(self.hashes) + 1)
        total = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * _powers[: len(self.hashes)], out=total[1:])
        return mix64((total[at + k] - total[at]) * _inverse[at]), off


def shingle_sets(texts: Sequence[str | None], k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    raw = [encode(t) for t in texts]
    for a, b in groups(raw):
        h, off = Words(raw[a:b], lower).shingles(k)
        for i in range(b - a):
            yield np.unique(h[off[i] : off[i + 1]])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names with dots, or that an operator uses itself, then do no harm."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def fields(df: DataFrame) -> str:
    """The schema of numbered()."""
    return ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))


def columns(batches: Iterable, *names: str) -> Iterator[tuple]:
    """Python lists of the named columns of Arrow batches."""
    for b in batches:
        yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)
