import datetime as dt

import pytest

from quarrystone import cli
from quarrystone.errors import Usage
from quarrystone.operators.chunking import Params


def test_verbs(spark, tmp_path):
    root, lines = tmp_path / "w", []
    root.mkdir()
    (root / "a").write_text("one")

    def run(*argv, hour=0):
        lines.clear()
        return cli.main(list(argv), spark, str(root), dt.datetime(2026, 8, 2, 12 + hour), lines.append, params=Params(512, 9, 2048))

    assert run("status") == 1 and "NotASpace" in lines[0]
    assert run("init", str(tmp_path / "store")) == 0
    assert run("status", "more", "--words") == 0 and lines == ["new a"]
    assert run("commit", "-m", "first") == 0 and "1 files" in lines[0]
    assert run("commit") == 2 and run("gc", "--nope") == 2 and run("nope") == 2 and run("locking", "maybe") == 2 and run("space", "x") == 2
    (root / "a").write_text("two!")
    assert run("snapshot", hour=1) == 0
    snap = lines[0].split()[1].rstrip(":")
    assert run("snapshots") == 0 and lines[0].startswith(snap)
    assert run("diff", "main", snap) == 0 and lines == ["M a"]
    assert run("log") == 0 and lines[0].endswith("first")
    assert run("space", "check") == 0 and lines == ["1 of 1 files are safe to remove"]
    assert run("locking", "on", "--expiry", "2d") == 0 and lines == ["locking on, expiry 172800 s"]
    assert run("lock", "a", "-m", "mine") == 0 and lines == ["a"]
    assert run("locks") == 0 and "(mine)" in lines[0]
    assert run("unlock", "a") == 0
    assert run("clear", hour=2) == 0 and not (root / "a").exists()
    assert run("restore") == 0 and (root / "a").read_text() == "two!"
    assert run("gc", "--dry-run") == 0 and "deleted 0" in lines[0]
    assert run("version") == 0 and lines == [cli.VERSION]
    assert run("help") == 0 and run() == 0 and run("-h") == 0 and "commit" in lines[0] and run("sync") == 0 and run("expire") == 0


def test_durations():
    assert cli.seconds("2d") == 172800 and cli.seconds(None) is None
    with pytest.raises(Usage):
        cli.seconds("2 weeks")
