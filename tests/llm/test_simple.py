import random

import numpy as np
import pytest

from quarrystone.llm import common, fingerprints, rules, sharding
from tests.llm import brute


@pytest.fixture(scope="module")
def texts():
    return brute.awkward(random.Random(5))


def true_likeness(a, b):
    x, y = brute.shingles(a, 5), brute.shingles(b, 5)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def test_fingerprints(spark, texts):
    got = fingerprints.with_next(brute.documents(spark, texts, extra=True), fingerprints._score, fingerprints.OUT).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    prints = {}
    for r in got:
        own, after = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        other = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(own), brute.sha(other))
        assert r.near_edited == pytest.approx(true_likeness(own, other)) and r.near_next == pytest.approx(true_likeness(own, after))
        assert r.n_distinct == len(brute.shingles(own, 5))
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint


def test_fingerprint_estimates_and_merge(spark):
    rng = random.Random(1)
    a = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    b = a[: len(a) * 2 // 3]
    x, y = fingerprints.sketch(a), fingerprints.sketch(b)
    assert fingerprints.resemblance(x, y) == pytest.approx(2 / 3, abs=0.1)
    assert fingerprints.containment(y, x) == pytest.approx(1, abs=0.1)
    assert fingerprints.distinct(x) == pytest.approx(2996, rel=0.2)
    parts = spark.createDataFrame([("k", fingerprints.to_text(x)), ("k", fingerprints.to_text(y)), ("l", fingerprints.to_text(y))], "key string, fingerprint string")
    got = {r.key: r.fingerprint for r in fingerprints.merged(parts, "key").collect()}
    assert got == {"k": fingerprints.to_text(fingerprints.merge(x, y)), "l": fingerprints.to_text(y)}


def test_fingerprints_of_odd_tables(spark):
    run = lambda rows: fingerprints.with_next(brute.documents(spark, rows), fingerprints._score, fingerprints.OUT).collect()
    assert run([]) == []
    assert [(r.doc_id, r.near_next) for r in run([(7, "a b c d e f")])] == [(7, 1.0)]
    got = run([(1, "a a"), (1, "b b"), (None, "n n"), (9, "z z")])
    assert sorted((r.doc_id is not None, r.doc_id, r.edited_sha256) for r in got) == sorted(
        [(False, None, brute.sha("n " + "a")), (True, 1, brute.sha("a " + "b")), (True, 1, brute.sha("b " + "z")), (True, 9, brute.sha("z " + "n"))]
    )


def test_fingerprints_over_many_buckets(spark):
    rows = [(i * 3, f"text number {i} of many") for i in range(1000)]
    got = fingerprints.with_next(brute.documents(spark, rows), fingerprints._score, fingerprints.OUT).collect()
    text = [t for _, t in rows]
    assert {r.doc_id // 3: r.edited_sha256 for r in got} == {i: brute.sha(fingerprints.edited(t, text[(i + 1) % 1000])) for i, t in enumerate(text)}


def test_fingerprints_of_hot_keys(spark):
    """Half of the rows have one id, a quarter none; many are equal rows; texts share long beginnings."""
    rng = random.Random(12)
    rows = [(5, f"{'same start ' * (i % 3 * 10)}{rng.randrange(200)} b c d e f") for i in range(1200)] + [(None, None if i % 2 else f"n{i} n n n n n") for i in range(600)] + [(i, f"t{i} a b c d e") for i in range(600)]
    rng.shuffle(rows)
    cuts, parted = fingerprints.neighbour_cuts(brute.documents(spark, rows), "doc_id", "text", 64)
    assert parted and len({c for c in cuts if c[0] == 5}) > 3
    got = fingerprints.with_next(brute.documents(spark, rows), fingerprints._score, fingerprints.OUT).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = [(str(d), brute.sha(fingerprints.edited(t or "", after or ""))) for (d, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True)]
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(want)


def test_fingerprints_of_a_long_text(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    got = {r.doc_id: r for r in fingerprints.with_next(brute.documents(spark, [long, "a b", long]), fingerprints._score, fingerprints.OUT).collect()}
    assert got[0].fingerprint == got[2].fingerprint and got[2].near_next == 1.0 and got[0].n_chars == len(long) and got[0].n_distinct == pytest.approx(199_996, rel=0.2)



def test_statistics(texts):
    got = rules.statistics_of(texts)[:, :5].astype(int)
    assert [tuple(x) for x in got] == [brute.statistics(t) for t in texts]


def test_quality_rules(spark, texts):
    docs = brute.documents(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(3, None, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = rules.judged(docs, rules.fit(docs, labels)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        n, _, _, _, rep = want = brute.statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n) and not (r.base_failed and r.kept)
    assert rules.judged(docs.limit(0), rules.fit(docs, labels.limit(0))).count() == 0


def test_trees_learn_and_are_monotonic():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = rules.boost(x[:2000], y[:2000], [-1, 0, 0, 0])
    assert ((trees.score(x[2000:]) > 0.5) == (y[2000:] > 0)).mean() > 0.9
    grid = np.repeat(rng.random((50, 4)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(trees.score(grid).reshape(50, 40), axis=1) <= 1e-9).all()


def test_shards(spark, texts):
    docs = brute.documents(spark, [*[(i, t) for i, t in enumerate(texts)], (None, "x"), (3, texts[3])])
    records = sharding.sized(docs)
    held = sharding.loads(records)
    where = sharding.spread(held, 7)
    store = sharding.SlotMap(spark, str(sharding.shared_folder(spark)) + "/map-test")
    store.write(where, 1)
    got = sharding.placed(records, store.frame(1), held, store.read(1)).collect()
    assert len(got) == len(texts) + 2 and store.versions() == [1]
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    for r in got:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, brute.crc(raw))
    with pytest.raises(Exception, match="exist"):
        store.write(where, 1)


def test_rebalancing_moves_little():
    rng = random.Random(2)
    held = [(s, rng.randrange(500, 1500), 1) for s in range(4096)]
    old = sharding.spread(held, 40)
    new = sharding.rebalanced(old, held, 41)
    size = [sum(b for s, b, _ in held if new[s] == k) for k in range(41)]
    assert max(size) < 1.03 * sum(size) / 41 and min(size) > 0.9 * sum(size) / 41
    assert sum(a != b for a, b in zip(old, new, strict=True)) < 4096 / 41 * 1.6
    assert sharding.rebalanced(old, held, 40) == old


def test_shards_are_near_equal(spark):
    docs = brute.documents(spark, ["w " * (i % 97) for i in range(20000)])
    held = sharding.loads(sharding.sized(docs))
    where = sharding.spread(held, 40)
    size = [sum(b for s, b, _ in held if where[s] == k) for k in range(40)]
    assert max(size) <= 1.01 * min(size)


def test_no_documents_no_shards(spark):
    records = sharding.sized(brute.documents(spark, []))
    where = sharding.spread(sharding.loads(records), 40)
    store = sharding.SlotMap(spark, str(sharding.shared_folder(spark)) + "/map-empty")
    store.write(where, 1)
    assert sharding.placed(records, store.frame(1), [], store.read(1)).collect() == []


def test_nulls_in_metadata():
    from quarrystone.llm import cotraining

    meta = cotraining.Metadata.of([None, "en"] * 10, [None, "s"] * 10)
    x = meta.view([None, "en", "fr"], [None, "s", "t"], [None, 5, -3])
    assert x.shape == (3, len(meta.langs) + len(meta.sources) + 5) and np.isfinite(x).all() and len({tuple(r) for r in x.tolist()}) == 3


def test_shards_of_many_equal_rows(spark, tmp_path):
    """60,000 of 200,000 rows have neither id nor text, 20,000 others are equal: sizes stay near equal and no slot is crowded."""
    some = spark.range(120_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    rows = some.unionByName(spark.range(60_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text")).unionByName(spark.range(20_000).selectExpr("7L AS doc_id", "'same' AS text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op9_slot_shards(spark, str(tmp_path)).selectExpr("shard", "slot", "size", "virtual_slot").toPandas()
    assert len(got) == 200_000
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 40 and size.max() < 1.01 * size.mean() and size.min() > 0.99 * size.mean()
    assert got.groupby("virtual_slot").size().max() < 250
    for _, places in got.groupby("shard")["slot"]:
        assert sorted(places) == list(range(len(places)))


def test_least_hashes(spark):
    ids = spark.range(50_000).selectExpr("id AS doc_id")
    some = {r.doc_id for r in common.least_hashes(ids, 2000).collect()}
    place = {r.doc_id: r.h for r in ids.selectExpr("doc_id", "pmod(xxhash64(doc_id), 1 << 30) AS h").collect()}
    assert some == set(sorted(place, key=lambda i: (place[i], i))[:2000])
    assert common.least_hashes(ids.limit(0), 5).count() == 0 and common.least_hashes(ids.limit(3), 5).count() == 3
