import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from quarrystone.llm import graph, neardup, packing, passages, pieces, urls
from tests.llm import brute


@pytest.fixture(scope="module")
def texts():
    return brute.awkward(random.Random(5))


def fuzz(n=1500):
    rng = random.Random(11)
    odd = ["", " ", "  a  b ", "a\tb", "▁x▁▁ y", "😀ẞ", "a" * 3000, "the " * 50, " " * 100, "\n\n \n", "<|endoftext|> x", "a\x00b", "x \n y", "it's I'll", "１２ ½"]
    return odd + ["".join(rng.choice("abcde  thine\nrs▁éß😀①A.,'0") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces_equal_the_library():
    m, sp = pieces.Model(pieces.default_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for _ in range(2):  # the second time from memory
        ids = m.encode(fuzz())
        assert ids == [np.array(x, "<u4").tobytes() for x in sp.encode(fuzz(), add_bos=True, add_eos=True)]
        assert [m.decode(x) for x in ids] == [sp.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
    rng = random.Random(3)
    for _ in range(500):
        x = [rng.choice([0, 1, 2, 259, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(6))]
        assert m.decode(np.array(x, "<u4").tobytes()) == sp.decode(x)


def test_pieces_on_a_table(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    got = pieces.digests(brute.documents(spark, texts, extra=True)).collect()
    assert len(got) == len(texts) and pieces.digests(brute.documents(spark, [])).collect() == []
    for r in got:
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(sp.decode(ids)))
    assert {r.doc_id: r.ids for r in pieces.encoded(brute.documents(spark, ["a b"])).collect()} == {0: sp.encode("a b", add_bos=True, add_eos=True)}


def check_packing(got, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for d, rows in by_doc.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in rows] == [(i, s, n) for i, (s, n) in enumerate(packing.cuts(len(ids)))]
        assert sum(r.length for r in rows) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_seq)


def test_packing(spark, texts, monkeypatch):
    texts = [*texts, *fuzz(300), "long words here " * 2000]
    n = check_packing(packing.packed(brute.documents(spark, texts, extra=True)).collect(), texts)
    monkeypatch.setattr(packing, "PARTITION", 16)
    many = packing.packed(brute.documents(spark, texts)).collect()
    total = sum(r.length for r in many)
    assert n <= -(-total // 1024) + 1 and check_packing(many, texts) <= n + 2
    assert packing.packed(brute.documents(spark, [])).collect() == []
    assert len(packing.packed(brute.documents(spark, [(1, "a"), (1, "a"), (None, None)])).collect()) == 3


def test_packing_of_many_equal_rows(spark):
    """Rows without id and text are dealt evenly over the partitions of the first round."""
    rows = brute.documents(spark, [(None, None)] * 20_000 + [(i, f"text {i}") for i in range(2000)])
    got = packing.packed(rows)
    assert got.count() == 22_000
    first = got.where("sequence_id >= 0 AND sequence_id < (1L << 56)").selectExpr("(sequence_id >> 16) AS part").groupBy("part").count().collect()
    assert len(first) > 15 and max(r["count"] for r in first) < 1.3 * packing.PARTITION


def test_packing_of_special_tokens(spark, tmp_path):
    """The registered query and the pipeline encode as the library does by default."""
    texts = ["<|endoftext|> x", "a<|endoftext|><|endoftext|>\n\n b", "<|endoftext|", "<|endoftext|>" * 1500, "x"]
    brute.documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for d, x in enumerate(texts)}
    assert want[0].tolist() == [50256, 2124, 2]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for got in (packing.op8_best_fit(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()} == {
            (d, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for d, ids in want.items() for i, (s, n) in enumerate(packing.cuts(len(ids)))
        }


def test_bounds():
    rng = random.Random(4)
    assert packing.lower_bound([]) == 0 and packing.lower_bound([513] * 7) == 7 and packing.lower_bound([342] * 6) == 3
    for _ in range(200):
        sizes = [rng.randrange(1, 1024) for _ in range(rng.randrange(1, 60))]
        where, offset, fill = packing.best_fit(sizes)
        assert packing.lower_bound(sizes) <= len(fill) and max(fill) <= 1024
        assert [sum(s for s, w in zip(sizes, where, strict=True) if w == k) for k in range(len(fill))] == fill
        assert all(o >= 0 for o in offset)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, texts, k, percent):
    got = neardup.near_duplicates(brute.documents(spark, texts, extra=True), k, percent).collect()
    sets, links = brute.near_links(dict(enumerate(texts)), k, percent, 100)
    want = brute.components(range(len(texts)), links)
    assert len(links) > 3
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_near_duplicates_in_a_large_bucket(spark):
    """A row of texts, each linked with its neighbours only: their bucket's least member is far from most."""
    rng = random.Random(8)
    w = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        w = list(w)
        for i in rng.sample(range(0, 120, 3), 2):
            w[i] = f"n{rng.random()}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    got = neardup.near_duplicates(brute.documents(spark, texts), 3, 85).collect()
    want = brute.components(range(len(texts)), brute.near_links(dict(enumerate(texts)), 3, 85, 100)[1])
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < 20


def test_near_duplicates_of_odd_tables(spark):
    run = lambda rows: sorted((r.doc_id is not None, r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(brute.documents(spark, rows), 3, 85).collect())
    assert run([]) == []
    assert run([(None, "a b c"), (None, None)]) == [(False, 0, None, True)] * 2
    assert run([(4, "a b c"), (4, "a b c"), (9, "A b  c"), (2, " ")]) == [(True, 2, 2, True), (True, 4, 4, True), (True, 4, 4, True), (True, 9, 4, False)]


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(41)
    a, b, c, d = (" ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    run = lambda rows: sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(brute.documents(spark, rows), 3, 85).collect())
    assert run([(1, a), (5, a), (5, b), (9, b), (7, c)]) == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 7, True), (9, 1, False)]
    # through a near copy, a text without words, and equal rows
    near = " ".join([*b.split(" ")[:-1], "changed"])
    rows = [(9, a), (8, a), (8, b), (8, b), (8, " "), (4, near), (3, None), (3, d), (6, d), (2, c)]
    assert run(rows) == sorted([(9, 4, False), (8, 4, False), (8, 4, False), (8, 4, False), (8, 4, False), (4, 4, True), (3, 3, True), (3, 3, True), (6, 3, False), (2, 2, True)])
    texts: dict[int, list[str]] = {}
    rows = [(rng.randrange(30), rng.choice((a, b, c, d, near)) if rng.random() < 0.3 else " ".join(f"q{rng.randrange(10**6)}" for _ in range(20))) for _ in range(60)]
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    flat = {(i, k): t for i, v in texts.items() for k, t in enumerate(v)}
    sets = {x: brute.shingles(t, 3) for x, t in flat.items()}
    links = [(x[0], y[0]) for x in flat for y in flat if x < y and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])]
    want = brute.components(texts, links)
    assert run(rows) == sorted((i, want[i], want[i] == i) for i, _ in rows)


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = brute.components({x for p in pairs for x in p}, pairs)
    assert got == {n: c for n, c in want.items() if n in got} and all(n in got or not any(n in p and p[0] != p[1] for p in pairs) for n in want)


def planted(rng, n=60):
    vocab = [f"v{i}" for i in range(4000)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared, docs, want = [words(60), words(90), words(400)], [], {}
    for i in range(n):
        body = words(rng.randrange(30, 300))
        if i % 4:
            docs.append(" ".join(body))
            continue
        p = list(shared[i // 4 % 3])
        if i % 8:  # a few changed words
            for k in rng.sample(range(15, len(p) - 15), 2):
                p[k] = "other"
        at = rng.randrange(len(body))
        docs.append(" ".join([*body[:at], *p, *body[at:]]))
        start = len(" ".join(body[:at])) + (at > 0)
        want[i] = (start, start + len(" ".join(p)), i // 4 % 3)
    return docs, want


def test_passages(spark):
    docs, want = planted(random.Random(9))
    got = passages.passages(brute.documents(spark, docs, extra=True)).collect()
    first = {}
    for i in sorted(want):
        first.setdefault(want[i][2], i)
    assert {r.doc_id for r in got} == set(want) - set(first.values())
    for r in got:
        start, end, kind = want[r.doc_id]
        assert abs(r.start - start) <= 12 and abs(r.end - end) <= 12 and r.source_doc_id in {i for i in want if want[i][2] == kind}
        assert docs[r.doc_id][r.start : r.end].strip() == docs[r.doc_id][r.start : r.end]
    cleaned = {r.doc_id: r for r in passages.without_passages(brute.documents(spark, docs), passages.passages(brute.documents(spark, docs))).collect()}
    for i, t in enumerate(docs):
        cut = [r for r in got if r.doc_id == i]
        assert cleaned[i].text == (t[: cut[0].start] + t[cut[0].end :] if cut else t) and cleaned[i].n_chars == len(cleaned[i].text)


def test_passages_of_odd_tables(spark, texts):
    run = lambda rows: passages.passages(brute.documents(spark, rows)).collect()
    assert run([]) == [] and run([(None, "w " * 100), (None, None), (1, "")]) == []
    long = " ".join(f"x{i}" for i in range(80))
    got = run([(1 << 60, long.upper()), (-5, long), (-5, long), (7, None)])
    assert {(r.doc_id, r.source_doc_id, r.start, r.end, r.n_words) for r in got} == {(1 << 60, -5, 0, len(long), 80)}
    run(texts)


def covered(got, doc):
    return {c for r in got if r.doc_id == doc for c in range(r.start, r.end)}


def test_passages_split_over_earlier_documents(spark):
    """B and C share 60 words whose halves many earlier documents have apart."""
    rng = random.Random(21)
    words = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    halves = words(30), words(30)
    half = lambda k: " ".join([*words(20), *halves[k], *words(20)])
    both = " ".join([*halves[0], *halves[1]])
    docs = [half(k) for _ in range(12) for k in (0, 1)]
    docs += [both + " " + " ".join(words(30))] + [half(k) for _ in range(12) for k in (0, 1)]
    docs.append(" ".join(words(25)) + " " + both)
    got = passages.passages(brute.documents(spark, docs)).collect()
    start = docs[-1].index(both)
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(len(docs) - 1, 24)}
    assert covered(got, len(docs) - 1) == set(range(start, start + len(both)))


def test_periodic_passages(spark):
    rng = random.Random(22)
    words = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    for period in (1, 4, 10, 25):
        p = " ".join(words(period) * (120 // period))
        docs = [" ".join(words(30)) + " " + p, p + " " + " ".join(words(30))]
        got = passages.passages(brute.documents(spark, docs)).collect()
        assert {r.doc_id for r in got} == {1} and covered(got, 1) >= set(range(len(p)))


def test_passages_with_many_changed_words(spark):
    """Evenly spaced changes of 10 to 15 % of 60 words."""
    rng = random.Random(23)
    words = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for i in range(60):
        p, n = words(60), 6 + i % 4
        changed = {(2 * k + 1) * 60 // (2 * n) for k in range(n)}
        docs += [" ".join([*words(30), *p, *words(30)]), " ".join([*words(20), *("other" if k in changed else w for k, w in enumerate(p)), *words(20)])]
    assert {(r.doc_id, r.source_doc_id) for r in passages.passages(brute.documents(spark, docs)).collect()} == {(i, i - 1) for i in range(1, 120, 2)}


def test_seeds_far_into_a_text():
    far = np.array([0, 2**24 - 1, 2**24, 2**24 + 7, 2**33], np.int64)
    doc = np.array([-(1 << 62), -5, 3, 3, (1 << 62)], np.int64)
    ids, word, key = passages.unpacked(passages.packed(doc, far, np.arange(5)), 3)
    assert key.tolist() == list(range(5)) and ids.tolist() == doc.tolist() and word.tolist() == far.tolist()
    odd = [np.array([-(1 << 63), (1 << 63) - 1, 0]), np.array([-1, 1 << 62, -(1 << 62)]), np.zeros(3, np.int64)]
    assert [c.tolist() for c in passages.unpacked(passages.packed(*odd), 3)] == [c.tolist() for c in odd]
    assert [len(c) for c in passages.unpacked(passages.packed(*[np.zeros(0, np.int64)] * 2), 2)] == [0, 0]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in passages.links(none, none, none, False)] == [0] * 4
    got = passages.links(np.array([9, 9]), np.array([1, 2]), np.array([2**24 + 7, 2**25]), False)
    assert [x.tolist() for x in got] == [[2], [2**25], [1], [2**24 + 7]]


def test_every_run_of_equal_words_is_found(spark):
    """Documents of pieces of a few shared passages, 0 to 300 words apart, against an exhaustive search for runs of MIN_WORDS words."""
    rng = random.Random(31)
    word = lambda: f"q{rng.randrange(10**6)}"
    shared = [[word() for _ in range(300)] for _ in range(4)]
    texts = []
    for _ in range(90):
        body = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            p, n = rng.choice(shared), rng.randrange(10, 120)
            at = rng.randrange(300 - n)
            body += [*p[at : at + n], *(word() for _ in range(rng.choice([0, 1, 5, 40, 80, 300])))]
        texts.append(body)
    got = passages.passages(brute.documents(spark, [" ".join(t) for t in texts])).collect()
    seen, want = set(), 0
    for d, t in enumerate(texts):
        runs = {i: tuple(t[i : i + passages.MIN_WORDS]) for i in range(len(t) - passages.MIN_WORDS + 1)}
        start = np.cumsum([0, *(len(w) + 1 for w in t)])
        held = {i + j for i, r in runs.items() if r in seen for j in range(passages.MIN_WORDS)}
        want += len(held)
        found = covered(got, d)
        assert all(found.issuperset(range(start[i], start[i] + len(t[i]))) for i in held)
        seen.update(runs.values())
    assert want > 2000
    for r in got:
        assert r.source_doc_id < r.doc_id and r.likeness >= passages.LIKENESS


def test_passages_that_most_documents_have(spark):
    """More documents of one task than HOT share a passage, and a part of it."""
    rng = random.Random(32)
    words = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    p = words(70)
    texts = [" ".join([*words(20), *(p if i % 3 else p[:50]), *words(20)]) for i in range(4 * passages.HOT)]
    got = passages.passages(brute.documents(spark, texts).coalesce(1)).collect()
    for i, t in enumerate(texts[1:], 1):
        start = t.index(" ".join(p[:50]))
        assert covered(got, i) >= set(range(start, start + len(" ".join(p if i % 3 and i > 1 else p[:50]))))
    key, doc = np.array([7] * 200 + [8] * 30 + [7 + (1 << 50)] * 70, np.uint64), np.array([*range(130), *range(70), *[5] * 30, *[1] * 70])
    assert passages.hot(key, doc).tolist() == [True] * 200 + [False] * 100
    assert passages.firsts(key[:200], doc[:200]).tolist() == [i in (0, 130) for i in range(200)]


def test_common_words_and_steps():
    rng = random.Random(33)
    for _ in range(100):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 30))], [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert passages.common(a, b) == best[-1][-1]
    a = np.arange(30)
    b = np.concatenate([a[:10], [99], a[10:]])
    assert passages.steps(a, np.array([0, 6, 12, 20]), b, np.array([0, 6, 13, 21])).tolist() == [6, 6, 8]


def test_chains_are_best():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 9)
        word, src = [rng.randrange(40) for _ in range(n)], [rng.randrange(40) for _ in range(n)]

        def value(c):
            return sum(passages.SEED_WORDS for _ in c) - passages.GAP * sum(word[b] - word[a] + src[b] - src[a] for a, b in zip(c, c[1:], strict=False))  # noqa: B023

        subsets = [sorted((i for i in range(n) if m >> i & 1), key=lambda i: word[i]) for m in range(1, 1 << n)]
        best = max(value(c) for c in subsets if all(word[a] < word[b] and src[a] < src[b] for a, b in zip(c, c[1:], strict=False)))
        got = passages.chains(word, src)
        assert value(got[0]) == pytest.approx(best) and sorted(i for c in got for i in c) == list(range(n))


URLS = [
    "http://www.example.com/en/7/x", "https://a.b.com/en/1?x#y", "http://Example.NET/de/8", "http://example.net/de/7#z", "http://x.org/es/", "http://x.org/ES/", "http://com/en/", "nourl", None, "",
    "http://www.spam-farm.example.org/en/1", "https://ads.shop.io/p?q=1", "http://10.0.0.1:80/casino", "http://notcom/en/", "http://u@my-example.com/en/72", "x://é|a.net/de/", "http://ex.com?en/", "a://b://c.com/en/", "http://shop.io/casinos/Casino.html", "http://a.net/de/\n?x",
]


def test_urls(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS[:5]])], "page_id long, url string, host string, action string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = urls.op5_url_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(urls.OP5_SQL)
    order = lambda rows: sorted(rows, key=str)
    rows = order(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == order(want.fetchall()) and len(rows) == len(URLS) + 5
    verdict = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert verdict[0] == ("example.com/en/7", "allow") and verdict[2] == ("example.net/de/8", "block") and verdict[3] == ("net/de/", "allow") and verdict[5] == (None, "allow")
    assert verdict[10] == (None, "block") and verdict[8] == (None, "allow")
    monkeypatch.setattr(urls, "LITERAL_RULES", 1)
    again = urls.op5_url_rules(spark, str(tmp_path))
    assert order(tuple(r[c] for c in want.columns) for r in again.collect()) == rows
    monkeypatch.setattr(urls, "BROADCAST_RULES", 1)
    again = urls.op5_url_rules(spark, str(tmp_path))
    assert order(tuple(r[c] for c in want.columns) for r in again.collect()) == rows


def test_urls_of_odd_tables(spark, monkeypatch):
    rules = urls.PLACES + urls.PATTERNS
    long = "http://example.com/en/7" + "/spam-x" * 50_000
    rows = [(1, long, 9), (1, long, 9), (None, None, 1), (2, "", 1), (3, "http://" + "a." * 30_000 + "org/es/", 1)]
    for few in (256, 1):
        monkeypatch.setattr(urls, "LITERAL_RULES", few)
        of = lambda rows: spark.createDataFrame(rows, "page_id long, url string, rank int")
        assert urls.matched(of([]), rules).collect() == []
        got = sorted((str(r.page_id), r.rule, r.action, len(r.path)) for r in urls.matched(of(rows), rules).collect())
        path = len(long) - len("http://example.com")
        assert got == [("1", "example.com/en/7", "allow", path)] * 2 + [("2", None, None, 0), ("3", "org/es/", "block", 4), ("None", None, None, 0)]


def test_rarest_token(spark):
    pages = spark.createDataFrame([(u,) for u in ["http://a.com/x", "http://b.com/y", "http://b.com/z"]], "url string")
    r = urls.pattern_rule("block", "r", "b", ("com", "b"))
    assert urls.rarest(urls.with_parts(pages), (r,)) == {r: "b"}


def test_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30), dtype=np.uint64)) for _ in range(20)]
    monkeypatch.setattr(neardup, "CELLS", 64)
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert neardup.intersections(sets)[~np.eye(20, dtype=bool)].tolist() == np.array(want)[~np.eye(20, dtype=bool)].tolist()
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 60, 2)]
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 4)
    left = spark.createDataFrame([(7, i, i, len(texts)) for i in range(len(texts))], "bucket long, rep long, part long, members long")
    got = [(r.a, r.b) for r in neardup.blocks_verified(brute.documents(spark, texts), left, 3, 85).collect()]
    links = brute.near_links(dict(enumerate(texts)), 3, 85, 100)[1]
    assert set(got) <= set(links) and brute.components(range(len(texts)), got) == brute.components(range(len(texts)), links)


def test_pieces_of_few_rows_are_plain_and_few(spark, monkeypatch):
    """A task of many partitions sends each of them one piece of each part, not one for each part of its own."""
    cols = [np.array([5, -3, 2**62]), np.array([1, 2, 3])]
    assert [c.tolist() for c in passages.unpacked(passages.packed(*cols), 2)] == [c.tolist() for c in cols]
    assert len(passages.packed(*cols)) == 8 + 2 * 3 * 8
    texts = [" ".join(f"w{i % 7}x{j}" for j in range(80)) for i in range(70)]
    rows = passages.matched(brute.documents(spark, texts).coalesce(1), passages.SEED_WORDS).collect()
    assert rows and all(len(r.data) == passages.SUB for r in rows) and len({r.part for r in rows}) > 1
