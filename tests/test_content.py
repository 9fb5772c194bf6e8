import io
import random
import tracemalloc

import numpy as np
import pytest

from quarrystone.errors import InvalidParameters
from quarrystone.functions import blake3, ids
from quarrystone.operators import chunking

SMALL = chunking.Params(512, 9, 2048)


def test_blake3_vectors():
    assert blake3.digests([b""])[0].hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.derive_bytes("BLAKE3 2019-12-27 16:29:52 test vectors context", 32).hex() == "2cc39783c223154fea8dfb7c1b1660f2ac2dcbd1c1de8277b0b0dd39b7e50d7d"


def scalar(data: bytes) -> bytes:
    """The hash by recursion over halves, one message at a time."""
    def out(cv, block, counter, size, flags):
        return blake3._compress(np.array([cv], np.uint32), np.array([block], np.uint32), np.array([counter], np.uint64), np.array([size]), np.array([flags]))[0]

    def words(b):
        return np.frombuffer(b.ljust(64, b"\0"), "<u4").astype(np.uint32)

    def node(b, first, root):
        if len(b) <= 1024:
            cv, parts = blake3._IV, [b[i : i + 64] for i in range(0, len(b), 64)] or [b""]
            for i, x in enumerate(parts):
                last = i == len(parts) - 1
                cv = out(cv, words(x), first, len(x), (i == 0) * 1 | last * 2 | (last and root) * 8)[:8]
            return cv
        k = 1024
        while 2 * k < len(b):
            k *= 2
        return out(blake3._IV, np.concatenate([node(b[:k], first, False), node(b[k:], first + k // 1024, False)]), 0, 64, 4 | root * 8)[:8]

    return node(data, 0, True).astype("<u4").tobytes()


def test_blake3_tree():
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in (1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 4097, 7000, 16384, 31745)]
    got = blake3.digests(data)
    assert got == [scalar(x) for x in data] and got == [blake3.digests([x])[0] for x in data]
    assert blake3.digests([]) == [] and len(blake3.derive_bytes("x", 2048)) == 2048
    assert blake3.derive_bytes("x", 2048)[:40] == blake3.derive_bytes("x", 40)


def test_domains_differ(spark):
    assert len({ids.content_id(k, b"same") for k in ids.KINDS}) == len(ids.KINDS)
    df = spark.createDataFrame([(bytearray(b"same"),), (None,)], "d binary")
    got = [r[0] for r in df.select(ids.content_id_column("file", df.d)).collect()]
    assert got == [ids.content_id("file", b"same"), None]


def naive(data, p):
    """Byte by byte from each chunk's start, as the definition says."""
    table, out, begin = chunking.word_table(ids.DEFAULT.table_context), [], 0
    while begin < len(data):
        part = data[begin : begin + p.max]
        start = max(0, p.min - chunking.WINDOW)
        end = next((i + 1 for i, h in chunking.rolled(part, table, start) if i + 1 >= p.min and not h & ((1 << p.bits) - 1)), len(part))
        out.append(begin + end)
        begin += end
    return out


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 511, 512, 513, 2047, 2048, 2049, 30000])
def test_cuts_equal_the_definition(size):
    data = random.Random(size).randbytes(size)
    assert chunking.cuts(data, SMALL) == naive(data, SMALL)
    assert chunking.cuts(data, chunking.Params(64, 6, 300)) == naive(data, chunking.Params(64, 6, 300))


def test_cuts_over_spans(monkeypatch):
    data = random.Random(3).randbytes(20000)
    want = chunking.cuts(data, SMALL)
    monkeypatch.setattr(chunking, "SPAN", 700)
    assert chunking.cuts(data, SMALL) == want
    tiny = chunking.Params(16, 5, 100)
    assert chunking.cuts(data[:3000], tiny) == naive(data[:3000], tiny)


def test_hash_in_parts(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(blake3.Hasher, "SPAN", 4)
    for n in (0, 1, 64, 1023, 1024, 1025, 4095, 4096, 4097, 8192, 8193, 12288, 16384, 20480, 20481, 32768, 45000):
        data, hasher, sized = rng.randbytes(n), blake3.Hasher("some context"), ids.ContentHasher("file")
        while sized.size < n:
            part = data[sized.size : sized.size + rng.randrange(1, 7000)]
            hasher.update(part)
            sized.update(part)
        assert hasher.digest(100) == blake3.digests([data], "some context", 100)[0]
        assert sized.id() == ids.content_id("file", data)
    by_sha = ids.ContentHasher("file", "sha256")
    by_sha.update(b"ab")
    assert by_sha.id() == ids.content_id("file", b"ab", "sha256")


@pytest.mark.parametrize("p", [SMALL, chunking.Params(64, 6, 300), chunking.Params(16, 5, 100)])
def test_pieces_equal_cuts(p):
    for n in (0, 1, 511, 512, 2047, 2048, 8192, 8193, 30000):
        for data in (random.Random(n).randbytes(n), bytes(n)):
            got = list(chunking.pieces(io.BytesIO(data).read, p))
            assert b"".join(got) == data and np.cumsum([0, *map(len, got)]).tolist()[1:] == chunking.cuts(data, p)


def test_pieces_take_bounded_memory():
    rng, left, hasher = np.random.default_rng(1), 48 << 20, ids.ContentHasher("file")

    def read(n):
        nonlocal left
        n = min(n, left)
        left -= n
        return rng.bytes(n)

    tracemalloc.start()
    for piece in chunking.pieces(read, chunking.Params(64 << 10, 16, 256 << 10)):
        hasher.update(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hasher.size == 48 << 20 and peak < 40 << 20


def test_constant_runs_and_parameters():
    assert chunking.cuts(b"\0" * 4096, SMALL) in ([512 * i for i in range(1, 9)], [2048, 4096])
    for bad in ((0, 9, 10), (10, 9, 5), (10, 0, 20), (10, 64, 20)):
        with pytest.raises(InvalidParameters):
            chunking.Params(*bad)


def test_edits_stay_local():
    rng = random.Random(5)
    data = rng.randbytes(400_000)
    parts = lambda d: [d[a:b] for a, b in zip([0, *chunking.cuts(d, SMALL)], chunking.cuts(d, SMALL), strict=False)]
    old = parts(data)
    assert b"".join(old) == data and 0.8 < len(data) / len(old) / 1024 < 1.2
    new = parts(b"x" + data)
    assert len(set(old) & set(new)) >= 0.9 * len(old)
    new = parts(data[:200_000] + data[201_000:])
    assert len(set(old) & set(new)) >= 0.85 * len(old)


def test_split(spark):
    rng = random.Random(6)
    data = {f"f{i}": rng.randbytes(n) for i, n in enumerate((0, 10, 5000, 9000))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()] + [("n", None)], "file_id string, data binary")
    rows = chunking.split(df, SMALL).orderBy("file_id", "seq").collect()
    for k, v in data.items():
        mine = [r for r in rows if r.file_id == k]
        assert b"".join(bytes(r.data) for r in mine) == v and [r.seq for r in mine] == list(range(len(mine)))
        assert all(r.offset == sum(x.length for x in mine[: r.seq]) and r.chunk_id == ids.content_id("chunk", bytes(r.data)) for r in mine)
    files = {r.path: r for r in chunking.build_files(df.withColumnRenamed("file_id", "path"), SMALL).collect()}
    assert files["f3"].file_id == ids.content_id("file", data["f3"]) and files["f0"].chunks == [] and files["n"].size == 0
    # an id doesn't depend on the chunk sizes
    assert chunking.build_files(df.withColumnRenamed("file_id", "path")).where("path = 'f3'").first().file_id == files["f3"].file_id
