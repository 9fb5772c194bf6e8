"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

A document is its byte-level BPE ids and the end id; only documents longer than a sequence are
cut, into full sequences with the shorter piece first.  The other pieces are dealt to
partitions and packed there best-fit decreasing.  Dual feasible functions bound from below
how many sequences a partition needs: where the packing meets the bound it is certified and
only its emptiest sequence is opened again, else its emptiest sequences are.  What was opened
meets that of neighbouring partitions in the next round and is packed best-fit decreasing
again, until one partition is left.

Edge cases: null counts as empty; an empty text is the end id alone; repeated rows and rows
with null ids are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LENGTH, END = 1024, 2
#: The special token of byte_bpe_50k.json.
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces that a first partition holds, about; partitions that meet in a later round; sequences that one may open.
PARTITION, MEET, OPEN = 1024, 8, 128


class Encoder:
    """Ids of the byte-level BPE vocabulary, as little-endian unsigned 32-bit integers.

    With ``special``, the name of the special token in a text is that token, as for the library
    tokenizers with add_special_tokens=False; else it is ordinary text.  Texts are encoded whole: remembering words was slower, as most
    words of a corpus are rare.
    """

    def __init__(self, path: str | None = None, special: bool = True):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL if special else {})
        self.allowed = set(SPECIAL) if special else set()

    def __call__(self, text: str) -> bytes:
        ids = self.bpe.encode(text, allowed_special=self.allowed, disallowed_special=())
        return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[tuple[str | None, bool], Encoder] = {}


def encoder(path: str | None = None, special: bool = True) -> Encoder:
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]


def cuts(n: int, limit: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % limit or limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, limit: int = LENGTH, end: int = END, special: bool = True) -> DataFrame:
    """The pieces of every document; one pass, no shuffle."""
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, special)
        for b in batches:
            out: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = of(t or "") + stop
                out += ((d, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cuts(len(ids) // 4, limit)))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(c)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(sizes: Sequence[int], limit: int = LENGTH) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: the sequence and the offset of each size, and the fill of each sequence."""
    where, offset, fill = [0] * len(sizes), [0] * len(sizes), []
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0  # bit r: some sequence has exactly r left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            k = free[left].pop()
            if not free[left]:
                mask &= ~(1 << left)
        else:
            k, left = len(fill), limit
            fill.append(0)
        where[i], offset[i] = k, fill[k]
        fill[k] += n
        if left > n:
            free[left - n].append(k)
            mask |= 1 << (left - n)
    return where, offset, fill


def lower_bound(sizes: Sequence[int], limit: int = LENGTH) -> int:
    """Sequences that any packing needs: the largest of the bounds by dual feasible functions.

    For t up to half the limit: sizes over limit - t count as the limit, those under t as 0.
    For k: a size x with (k+1)x/limit whole counts as x, else as floor((k+1)x/limit) * limit/k.
    """
    x = np.asarray(sizes, np.int64)
    if not len(x):
        return 0
    count = np.bincount(x, minlength=limit + 1)
    size = np.arange(limit + 1)
    many, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(limit // 2 + 1)
    total = (mass[limit - t + 1] - mass[t]) + limit * (many[-1] - many[limit - t + 1])
    best = int((-(-total // limit)).max())
    for k in range(1, 65):
        up = (k + 1) * size
        exact = up % limit == 0
        units = np.where(exact, k * size, up // limit * limit)  # in limit * k
        best = max(best, -(-int((count * units).sum()) // (limit * k)))
    return best


ROUND = PIECES + ", part long, bin int, offset long, closed boolean"


def _round(items: DataFrame, last: bool, limit: int = LENGTH) -> DataFrame:
    """Packs each part; closed rows have their place, the others go on."""
    names = [x.split()[0] for x in ROUND.split(", ")]

    def pack(cols: list[list]) -> pa.RecordBatch:
        sizes = cols[3]
        where, offset, fill = best_fit(sizes, limit)
        gap = len(fill) - lower_bound(sizes, limit)
        opened: set[int] = set()
        if not last:
            opened.update(sorted(range(len(fill)), key=lambda k: (fill[k], k))[: min(OPEN, 1 if gap == 0 else 8 * (gap + 1))])
            opened.difference_update(k for k in set(opened) if fill[k] == limit)
        closed = [k not in opened for k in where]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols, where, offset, closed], kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            part = b.column(5).to_numpy()
            edge = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if held[5] and lo < hi and held[5][0] != cols[5][lo]:
                    yield pack(held)
                    held = [[] for _ in range(6)]
                for h, c in zip(held, cols, strict=True):
                    h += c[lo:hi]
        if held[5]:
            yield pack(held)

    return items.repartition("part").sortWithinPartitions("part", "length", "ids_crc32", "doc_id", "piece").mapInArrow(run, ROUND)


def packed(docs: DataFrame, path: str | None = None, limit: int = LENGTH, end: int = END, special: bool = True) -> DataFrame:
    """Every piece with its sequence and its place there."""
    all_ = cut(pieces(docs, path, limit, end, special), "pieces")
    cols = [x.split()[0] for x in PIECES.split(", ")]
    full = all_.where(F.col("length") == limit).select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = all_.where(F.col("length") < limit)
    parts = max(1, -(-rest.count() // PARTITION))
    # the row's place in the table spreads equal rows too; the table is written, so a lost task finds the same places
    items = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)))
    out, level = full, 0
    while True:
        done = cut(_round(items, parts == 1, limit), f"round{level}")
        out = out.union(done.where("closed").select(*cols, (F.lit(level << 56) + F.col("part") * (1 << 16) + F.col("bin")).alias("sequence_id"), "offset"))
        if parts == 1:
            return out
        level, parts = level + 1, -(-parts // MEET)
        items = done.where("NOT closed").select(*cols, F.floor(F.col("part") / MEET).alias("part"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
