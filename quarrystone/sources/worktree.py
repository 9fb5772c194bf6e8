"""The working tree as a Spark data source, and as a sink.

The scan is a Python data source: unlike Spark's file sources it sees dot-files and
underscore files.  It lists directories only, never reads content, skips symbolic links and
whatever isn't a regular file, and does not enter ignored directories or the state folder.
"""

from __future__ import annotations

import os
import stat
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrystone.errors import UnsafePath
from quarrystone.functions import ignore, paths
from quarrystone.schemas import SCAN

STATE = ".quarrystone"


def entries(root: str, rel: str, rules: list[ignore.IgnoreRule]) -> Iterator[tuple[str, bool, os.stat_result]]:
    """(relative path, is a directory, stat) of one directory's entries that a scan looks at."""
    for e in os.scandir(os.path.join(root, rel) if rel else root):
        path = f"{rel}/{e.name}" if rel else e.name
        s = e.stat(follow_symlinks=False)
        is_dir = stat.S_ISDIR(s.st_mode)
        if path == STATE or not (is_dir or stat.S_ISREG(s.st_mode)) or ignore.matches(rules, path, is_dir):
            continue
        yield path, is_dir, s


def walk(root: str, rel: str, rules: list[ignore.IgnoreRule]) -> Iterator[tuple[str, int, int]]:
    todo = [rel]
    while todo:
        for path, is_dir, s in entries(root, todo.pop(), rules):
            if is_dir:
                todo.append(path)
            else:
                yield path, s.st_size, s.st_mtime_ns


class _Part(InputPartition):
    def __init__(self, rel: str, files: list[tuple[str, int, int]]):
        self.rel, self.files = rel, files


class _Reader(DataSourceReader):
    def __init__(self, root: str, rules: list[ignore.IgnoreRule]):
        self.root, self.rules = root, rules

    def partitions(self):
        """The files of the root, and each of its directories, which executors walk."""
        top = list(entries(self.root, "", self.rules))
        files = [(p, s.st_size, s.st_mtime_ns) for p, is_dir, s in top if not is_dir]
        return [_Part("", files), *(_Part(p, []) for p, is_dir, _ in top if is_dir)]

    def read(self, partition):
        yield from partition.files
        if partition.rel:
            yield from walk(self.root, partition.rel, self.rules)


class WorkTreeSource(DataSource):
    """Options: path, and ``ignore``, the text of the ignore rules.  The folder is one that executors see too."""

    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], ignore.parse(self.options.get("ignore", "")))


def scan(spark: SparkSession, root: str, rules: str = "") -> DataFrame:
    spark.dataSource.register(WorkTreeSource)
    return spark.read.format("worktree").option("ignore", rules).load(root)


def relative(root: str, path: str) -> str:
    """A3: the normal relative path of a host path."""
    rel = os.path.relpath(path, root)
    if rel.startswith("..") or os.path.isabs(rel):
        raise UnsafePath(path)
    return paths.normalize(rel.replace(os.sep, "/"))


def safe_join(root: str, path: str, windows: bool = False) -> str:
    """A host path under root; hostile paths, links on the way and reserved names are refused."""
    why = paths.problem_of(path)
    if why:
        raise UnsafePath(f"{path!r}: {why}")
    if windows and (paths.is_reserved_name(path) or ":" in path):
        raise UnsafePath(f"{path!r}: reserved")
    at = root
    for part in path.split("/")[:-1]:
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise UnsafePath(f"{path!r}: a link is on the way")
        if os.path.exists(at) and not os.path.isdir(at):
            raise UnsafePath(f"{path!r}: a file is on the way")
    full = os.path.join(root, *path.split("/"))
    if os.path.islink(full):
        raise UnsafePath(f"{path!r}: is a link")
    return full


def write_file(root: str, path: str, parts: Iterable[bytes]) -> os.stat_result:
    """Whole or not at all: the parts go to a temporary file in the same folder, then a rename; if they raise, nothing is left."""
    full = safe_join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(full), prefix=".tmp-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.writelines(parts)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(tmp, 0o644)
        os.replace(tmp, full)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise
    return os.stat(full)


def remove_files(root: str, gone: list[str]) -> None:
    """Removes files, then the folders that this left empty, the deepest first."""
    for p in gone:
        full = safe_join(root, p)
        if os.path.lexists(full):
            os.chmod(full, 0o644)
            os.unlink(full)
    for d in sorted({"/".join(p.split("/")[:i]) for p in gone for i in range(1, p.count("/") + 1)}, reverse=True):
        full = os.path.join(root, d)
        if os.path.isdir(full) and not os.listdir(full):
            os.rmdir(full)
