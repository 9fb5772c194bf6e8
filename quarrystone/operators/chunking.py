"""Content-defined chunking of binary content.

A 64-bit rolling hash over 64 bytes is the exclusive or of table words, each turned left once
for every byte that follows it, so the hashes of all places are made by six doublings of the
window with numpy; only the choice of cuts between the least and the largest size is in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrystone.errors import InvalidParameters
from quarrystone.functions import blake3
from quarrystone.functions.ids import DEFAULT, Format, content_ids

WINDOW = 64


@dataclass(frozen=True)
class Params:
    """Least size, number of zero bits at a cut, largest size; the expected size is min + 2**bits."""

    min: int = 1 << 20
    bits: int = 20
    max: int = 4 << 20

    def __post_init__(self) -> None:
        if self.min <= 0 or self.max < self.min or not 1 <= self.bits <= 63:
            raise InvalidParameters(str(self))


ASSETS, MANIFESTS = Params(), Params(32 << 10, 15, 128 << 10)


@lru_cache
def word_table(context: str) -> np.ndarray:
    """256 words from the context's derived bytes, little-endian."""
    return np.frombuffer(blake3.derive_bytes(context, 2048), "<u8").astype(np.uint64)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def window_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hash after each byte, for a window that began as zeros and has rolled over the last 64 bytes."""
    zero = _residue(table)
    h = table[data]
    for k in (1, 2, 4, 8, 16, 32):
        more = h.copy()
        more[k:] ^= _turn(h[:-k], k) if len(h) > k else h[:0]
        h = more
    return h ^ zero


def _residue(table: np.ndarray) -> np.uint64:
    """What 64 turns of the leaving zero bytes' word leave: all ones if it has an odd number of ones."""
    return np.uint64(0xFFFFFFFFFFFFFFFF if int(table[0]).bit_count() % 2 else 0)


def rolled(data: bytes, table: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    """(place, hash) byte by byte from ``start`` of a chunk, as the definition says; for least sizes under the window."""
    words, window, total, at = table.tolist(), [0] * WINDOW, 0, 0
    for i in range(start, len(data)):
        out, window[at] = window[at], data[i]
        at = (at + 1) % WINDOW
        total = ((total << 1 | total >> 63) & 0xFFFFFFFFFFFFFFFF) ^ words[out] ^ words[data[i]]
        yield i, total


#: Hashes of a long content are made for about this many bytes at a time.
SPAN = 1 << 20


def cuts(data: bytes, p: Params, form: Format = DEFAULT) -> list[int]:
    """Where chunks end; none for empty content."""
    table, mask = word_table(form.table_context), (1 << p.bits) - 1
    n = len(data)
    out: list[int] = []
    if p.min < WINDOW:
        begin = 0
        while begin < n:
            part = data[begin : begin + p.max]
            out.append(begin + next((i + 1 for i, h in rolled(part, table, 0) if i + 1 >= p.min and not h & mask), len(part)))
            begin = out[-1]
        return out
    raw = np.frombuffer(data, np.uint8)
    found = [np.zeros(0, np.int64)]
    for a in range(0, n, SPAN):
        lo = max(0, a - WINDOW + 1)
        h = window_hashes(raw[lo : a + SPAN], table)[a - lo :]
        found.append(np.flatnonzero((h & np.uint64(mask)) == 0) + a + 1)
    ends = np.concatenate(found)
    begin = 0
    while begin < n:
        i = int(np.searchsorted(ends, begin + p.min))
        end = min(int(ends[i]) if i < len(ends) else n, begin + p.max, n)
        out.append(end)
        begin = end
    return out


#: A stream is read about this many times the largest chunk at once.
LOOK = 4


def pieces(read: Callable[[int], bytes], p: Params, form: Format = DEFAULT) -> Iterator[bytes]:
    """The chunks of a stream in order, as ``cuts`` has them for its whole content, in memory bounded by the largest chunk.

    ``read(n)`` gives n bytes, and fewer only at the end.  A chunk that ends where the bytes read
    so far do, below the largest size, waits for more."""
    held = b""
    while True:
        more = read(LOOK * p.max)
        data, begin = held + more, 0
        for end in cuts(data, p, form):
            if more and end == len(data) and end - begin < p.max:
                break
            yield data[begin:end]
            begin = end
        held = data[begin:]
        if not more:
            return


#: Chunks are hashed together up to about this many bytes, whatever contents they are of.
HASHED = 4 << 20


def split(contents: DataFrame, params: Params = ASSETS, algorithm: str = "blake3", form: Format = DEFAULT, keep: bool = True) -> DataFrame:
    """Chunks of each (file_id, data): seq, offset, length, id and, with ``keep``, the bytes; one pass, no shuffle.

    Null content counts as empty, which has no chunks."""
    schema = "file_id string, seq int, offset long, length long, chunk_id string" + ", data binary" * keep

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = [*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), pa.array(content_ids("chunk", parts, algorithm, form), pa.string())]
            out = pa.RecordBatch.from_arrays([*cols, *([pa.array(parts, pa.binary())] if keep else [])], names=names)
            rows.clear()
            parts.clear()
            return out

        for b in batches:
            for f, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = data.as_py() or b""
                begin = 0
                for seq, end in enumerate(cuts(data, params, form)):
                    rows.append((f, seq, begin, end - begin))
                    parts.append(data[begin:end])
                    size, begin = size + end - begin, end
                    if size > HASHED:
                        yield flush()
                        size = 0
        if rows:
            yield flush()

    return contents.select("file_id", "data").mapInArrow(run, schema)


def build_files(contents: DataFrame, params: Params = ASSETS, algorithm: str = "blake3", form: Format = DEFAULT) -> DataFrame:
    """(path, data) split and hashed in one pass: rows of a path's file id, size and chunks in order."""
    schema = "path string, file_id string, size long, chunks array<struct<chunk_id:string,length:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [x.as_py() or b"" for x in b.column(1)]
            ends = [cuts(x, params, form) for x in whole]
            parts = [x[i:j] for x, e in zip(whole, ends, strict=True) for i, j in zip([0, *e], e, strict=False)]
            chunk = iter(zip(content_ids("chunk", parts, algorithm, form), map(len, parts), strict=True))
            ids = content_ids("file", whole, algorithm, form)
            out = [{"path": p, "file_id": f, "size": len(x), "chunks": [{"chunk_id": c, "length": n} for c, n in (next(chunk) for _ in e)]} for p, f, x, e in zip(b.column(0).to_pylist(), ids, whole, ends, strict=True)]
            kind = pa.schema([("path", pa.string()), ("file_id", pa.string()), ("size", pa.int64()), ("chunks", pa.list_(pa.struct([("chunk_id", pa.string()), ("length", pa.int64())])))])
            yield pa.RecordBatch.from_pylist(out, kind)

    return contents.select("path", "data").mapInArrow(run, schema)
