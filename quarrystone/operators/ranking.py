"""Ranks within keys that stay distributed when a key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows than this is ranked in pieces.
HOT = 1_000_000
#: About how many rows such a piece holds, and the most pieces of a key.
PIECE, PIECES = 200_000, 1_000


def ranked(df: DataFrame, key: str, order: str, name: str, hot: int = HOT, piece: int = PIECE, heavy: dict | None = None) -> DataFrame:
    """Adds ``name``: the row's number (from 1) in ``key`` by the string column ``order``.

    Rows that tie get different numbers in any order.  Keys over ``hot`` rows (there are at most
    rows/hot of them, ``heavy`` where the caller has counted them) are split at sampled values of ``order``: a piece's rows are ranked in a
    window of their own, and the rows of the earlier pieces are added.  The result does not
    depend on the sample.
    """
    if heavy is None:
        heavy = {r[key]: r["count"] for r in df.groupBy(key).count().where(F.col("count") > hot).collect()}
    if not heavy:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))
    cuts = {}
    for k, n in heavy.items():
        want = min(PIECES, n // piece)
        near = df.where(F.col(key).eqNullSafe(k)).select(order).orderBy(F.xxhash64(order)).limit(want * 20).collect()
        values = sorted({r[0] for r in near if r[0] is not None})
        cuts[k] = values[:: max(1, len(values) // max(1, want))]
    spark = df.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in cuts.items()], df.select(F.col(key).alias("_key"), F.array(F.col(order)).alias("_cuts")).schema)
    spread = df.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("_key")), "left")  # at most rows/hot keys of PIECES cuts
    spread = spread.withColumn("_piece", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(order))), F.lit(0))).drop("_key", "_cuts")
    sizes = spread.groupBy(key, "_piece").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    before = before.where("_before > 0").withColumnsRenamed({key: "_key", "_piece": "_p"})
    at = F.row_number().over(Window.partitionBy(key, "_piece").orderBy(order))
    out = spread.withColumn("_at", at).join(F.broadcast(before), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_p")), "left")  # hot keys' pieces only
    return out.withColumn(name, (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_piece", "_at", "_before", "_key", "_p")
