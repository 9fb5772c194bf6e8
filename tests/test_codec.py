import datetime as dt

import pytest

from quarrystone.errors import CaseCollision, EngineError, InvalidPath, MalformedObject
from quarrystone.functions import text
from quarrystone.operators import codec

A, B, C = "a" * 64, "b" * 64, "c" * 64
T = dt.datetime(2026, 8, 2, 14, 20, 31)
H = "quarrystone"
OBJECTS = {
    "file": (codec.File(30, ((A, 10), (B, 20))), f"{H}-file v1\nsize\t30\n{A}\t10\n{B}\t20\n"),
    "empty": (codec.File(0), f"{H}-file v1\nsize\t0\n"),
    "manifest": (codec.Manifest((("a/x.png", A, 5), ("b.txt", B, 0))), f"{H}-manifest v1\na/x.png\t{A}\t5\nb.txt\t{B}\t0\n"),
    "version": (codec.Version(A, "ann", T, (B, C), message="One\n\nTwo."), f"{H}-version v1\nmanifest\t{A}\nparent\t{B}\nparent\t{C}\nauthor\tann\ntime\t2026-08-02T14:20:31Z\nmessage\nOne\n\nTwo.\n"),
    "snapshot": (codec.Version(A, "ann", T, expiry=T, graph=C), f"{H}-version v1\nmanifest\t{A}\nauthor\tann\ntime\t2026-08-02T14:20:31Z\nexpiry\t2026-08-02T14:20:31Z\ngraph\t{C}\n"),
    "graph": (codec.Graph((("b", "0.1", ".x"),), (("l.x", "h.png", "texture"), ("l.x", "m.fbx", "mesh"))), f"{H}-graph v1\nextractor\tb\t0.1\t.x\nedge\tl.x\th.png\ttexture\nedge\tl.x\tm.fbx\tmesh\n"),
    "signature": (codec.Signature(A, "k1", b"\x01\xff"), f"{H}-signature v1\nversion\t{A}\nkey\tk1\nsignature\t01ff\n"),
}


@pytest.mark.parametrize("name", OBJECTS)
def test_round_trip(name):
    o, want = OBJECTS[name]
    assert codec.encode(o) == want.encode()
    assert codec.decode(codec.KIND_OF[type(o)], want.encode()) == o


FRAME = f"{H}-file v1\nsize\t0\n".encode()


@pytest.mark.parametrize(
    "data",
    [b"", FRAME[:-1], b"\xef\xbb\xbf" + FRAME, FRAME.replace(b"\n", b"\r\n"), FRAME + b"\n", FRAME[:-1] + b" \n", FRAME[:-1] + b"\t\n", b"\xff" + FRAME, FRAME.replace(b"v1", b"v2"), FRAME.replace(b"file", b"manifest"), FRAME + b"x\n", FRAME.replace(b"\t0", b"\t00"), FRAME.replace(b"\t0", b"\t+0"), FRAME.replace(b"\t0", b"\t-1"), FRAME.replace(b"\t0", b"\t99999999999999999999"), FRAME.replace(b"\t0", b" 0")],
)
def test_framing_and_numbers(data):
    with pytest.raises(MalformedObject):
        codec.decode("file", data)


@pytest.mark.parametrize(
    "body",
    [f"b\t{A}\t1\na\t{B}\t1\n", f"a\t{A}\t1\na\t{A}\t1\n", f"a\t{A.upper()}\t1\n", f"a\t{A}\t01\n", f"a\t{A}\n", f"/a\t{A}\t1\n", f"a/../b\t{A}\t1\n", f"A\t{A}\t1\na\t{A}\t1\n", f"é\t{A}\t1\n", f"a//b\t{A}\t1\n", f"a\t{'0' * 64}\t1\n"],
)
def test_manifest_rejects(body):
    with pytest.raises(EngineError):
        codec.decode("manifest", f"{H}-manifest v1\n{body}".encode())


def _version(*lines):
    return "".join(f"{x}\n" for x in (f"{H}-version v1", *lines)).encode()


@pytest.mark.parametrize(
    "data",
    [
        _version(f"manifest\t{A}", "time\t2026-08-02T14:20:31Z", "author\tx"), _version(f"manifest\t{A}", f"parent\t{B}", f"parent\t{B}", "author\tx", "time\t2026-08-02T14:20:31Z"),
        _version(f"manifest\t{A}", "author\tx", "time\t2026-08-02T14:20:31z"), _version(f"manifest\t{A}", "author\tx", "time\t2026-08-02T14:20:31.5Z"), _version(f"manifest\t{A}", "author\tx", "time\t2026-08-02T14:20:31+00:00"),
        _version(f"manifest\t{A}", "author\tx", "time\t2026-08-02T14:20:31Z", "extra\ty"), _version(f"manifest\t{A}", "author\t x", "time\t2026-08-02T14:20:31Z"), _version(f"manifest\t{A}", "author\tx", "time\t2026-08-02T14:20:31Z", "message", "", "x"),
        _version(f"manifest\t{A}", "author\tx", "time\t2026-08-02T14:20:31Z", "message", "x", ""), _version(f"manifest\t{A}", "author\tx", "time\t2026-08-02T14:20:31Z", "message", "x "), _version(f"manifest\t{A}", "author\tx", "time\t2026-08-02T14:20:31Z", "message"),
        _version(f"manifest\t{A}", "author\tx", "time\t2026-8-2T14:20:31Z"),
    ],
)
def test_version_rejects(data):
    with pytest.raises(EngineError):
        codec.decode("version", data)


def test_inconsistent_objects():
    for o in (codec.File(1), codec.File(2, ((A, 1),)), codec.File(0, ((A, 0),)), codec.Version(A, "", T), codec.Version(A, "a\tb", T), codec.Graph((("b", "1", "x"), ("a", "1", "x"))), codec.Graph((), (("a", "/b", "t"),)), codec.Signature(A, "k", b"")):
        with pytest.raises(EngineError):
            codec.encode(o)
    with pytest.raises(CaseCollision):
        codec.encode(codec.Manifest((("STRASSE", A, 1), ("straße", A, 1))))
    with pytest.raises(InvalidPath):
        codec.encode(codec.Manifest((("a\\b", A, 1),)))
    for kind, data in (("signature", f"{H}-signature v1\nversion\t{A}\nkey\tk\nsignature\tABCD\n"), ("graph", f"{H}-graph v1\nedge\ta\tb\tt\nextractor\tb\t1\tx\n")):
        with pytest.raises(EngineError):
            codec.decode(kind, data.encode())


def test_scalars(spark):
    df = spark.createDataFrame([(x,) for x in ("0", "12", "012", "+1", "-1", "", "9223372036854775807", "9223372036854775808", None)], "s string")
    assert [r[0] for r in df.select(text.strict_int(df.s)).collect()] == [0, 12, None, None, None, None, 9223372036854775807, None, None]
    df = spark.createDataFrame([("2026-08-02T14:20:31Z",), ("2026-02-30T00:00:00Z",), ("2026-08-02T14:20:31z",), ("x",)], "s string")
    assert [r[0] is not None for r in df.select(text.strict_time(df.s)).collect()] == [True, False, False, False]
    df = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 4352, 1 << 20, 5 << 40, (1 << 63) - 1)], "n long")
    assert [r[0] for r in df.select(text.human_bytes(df.n)).collect()] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "4.2 KiB", "1.0 MiB", "5.0 TiB", "8192.0 PiB"]
