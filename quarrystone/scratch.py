"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


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


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder; removed when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/quarrystone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(tables: dict[str, DataFrame]) -> list[tuple[DataFrame, int]]:
    """Several independent tables written at the same time, each with its number of rows, which the write counts."""

    def one(item: tuple[str, DataFrame]) -> tuple[DataFrame, int]:
        seen = Observation()
        out = written(item[1].observe(seen, F.count(F.lit(1)).alias("n")), item[0])
        return out, seen.get["n"]

    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(one, tables.items()))


def sweep() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may be gone by now
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.pop(path, None)


atexit.register(sweep)
