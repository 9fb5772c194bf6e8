import datetime as dt
import random

from quarrystone.functions import ids
from quarrystone.operators import chunking
from quarrystone.sources.store import Store
from quarrystone.streaming.ingest import ingest


def test_ingest_puts_each_chunk_once(spark, tmp_path):
    rng, p = random.Random(2), chunking.Params(512, 9, 2048)
    data = {"a": rng.randbytes(4000), "b": rng.randbytes(3000)}
    data["c"] = data["a"]
    store = Store.create(spark, str(tmp_path / "s"))
    for k, v in data.items():
        spark.createDataFrame([(k, bytearray(v))], "file_id string, data binary").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark.readStream.schema("file_id string, data binary").parquet(str(tmp_path / "in")), store, lambda: dt.datetime(2026, 1, 1), p).awaitTermination(120)
    want = {ids.content_id("chunk", v[a:b]) for v in data.values() for a, b in zip([0, *chunking.cuts(v, p)], chunking.cuts(v, p), strict=False)}
    got = [r.digest for r in store.objects().collect()]
    assert sorted(got) == sorted(want)
