"""Quality rules: document statistics, fixed base rules and gradient-boosted trees over the statistics.

The trees are grown here from labelled rows, with monotonic constraints on chosen statistics
(a document with more repetition or more symbols, all else equal, never scores better), and
are flattened into numpy node arrays that score a whole batch level by level.

Edge cases: a null text counts as empty; an empty text has all statistics 0 and fails the
base rules (fewer than 10 words); without labels of both kinds every document has score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, encode, groups, least_hashes, table

#: name -> constraint on the score: -1 never rises with it, +1 never falls, 0 free
STATISTICS = {
    "n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0,
    "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "mean_word": 0, "upper_share": 0,
    "digit_share": 0, "punct_share": 0, "n_lines": 0, "line_words": 0, "distinct_share": 0, "top_word_share": -1,
    "bang_share": -1, "pipe_share": -1, "long_word_share": 0, "stop_share": 0,
}
NAMES = list(STATISTICS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_PUNCT[list(b".,;:?'\"()")] = True


def _segments(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return total[b] - total[a]


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def repeated_words(hashes: np.ndarray, first: np.ndarray, shingles: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """For each text the number of words that lie in windows of k words found twice or more in it."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    order = np.lexsort((shingles, owner))
    s, o = shingles[order], owner[order]
    same = (s[1:] == s[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    window = order[twice]
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = first[owner[window]] + window - off[owner[window]]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    inside = _sums(np.cumsum(cover)[:-1] > 0)
    return _segments(inside, first[:-1], first[1:])


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text; the first five are the exact counts of the base rules."""
    w = Words(texts)
    data, n = w.data, np.diff(w.first)
    lo, hi = w.origin, np.append(w.origin[1:] - 1, len(data) - 1) if len(texts) else w.origin
    head = (data & 0xC0) != 0x80  # the first byte of each code point
    heads = _sums(head)
    chars = heads[w.end] - heads[w.start]
    words_off = w.first
    sums = np.concatenate([[0], np.cumsum(chars)])
    word_chars = _segments(sums, words_off[:-1], words_off[1:])
    count = lambda mask: _segments(_sums(mask), lo, hi)
    n_symbols = count(_SYMBOL[data])
    sh, off = w.shingles(5, short=False)
    repeat = repeated_words(w.hashes, w.first, sh, off, 5)
    dup_lines, n_lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            n_lines[i], dup_lines[i] = len(lines), len(lines) - len(set(lines))
        else:
            n_lines[i] = n[i] > 0
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((w.hashes, owner))
    h, o = w.hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(h)))
    top, distinct = np.zeros(len(texts)), np.bincount(o[at], minlength=len(texts)).astype(float)
    np.maximum.at(top, o[at], run)
    m, c = np.maximum(n, 1).astype(float), np.maximum(word_chars, 1).astype(float)
    long = np.bincount(owner[chars > 15], minlength=len(texts)) if len(owner) else np.zeros(len(texts))
    short = np.bincount(owner[chars <= 3], minlength=len(texts)) if len(owner) else np.zeros(len(texts))
    return np.column_stack([
        n, word_chars, n_symbols, dup_lines, repeat, n_symbols / c, dup_lines / np.maximum(n_lines, 1), repeat / m,
        word_chars / m, count(_UPPER[data]) / c, count(_DIGIT[data]) / c, count(_PUNCT[data]) / c, n_lines,
        n / np.maximum(n_lines, 1), distinct / m, top / m, count(data == 0x21) / c, count(data == 0x7C) / c, long / m, short / m,
    ]).astype(np.float64)


def statistics_of(texts: list[str | None]) -> np.ndarray:
    raw = [encode(t) for t in texts]
    parts = [statistics(raw[a:b]) for a, b in groups(raw)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


@dataclass
class Trees:
    """Boosted trees as flat node arrays: a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int = field(default=0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray, constraints: list[int], rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Trees:
    """Grows logistic-loss trees on histograms; splits that break a constraint are not taken, and
    the children's values are kept on their sides of the split's middle, so the whole is monotonic."""
    nodes: list[list] = []
    if not len(y) or y.min() == y.max():
        return Trees(*(np.zeros(1, np.int64) if k in (0, 2, 3) else np.zeros(1) for k in range(5)), np.zeros(0, np.int64), 20.0 if not len(y) or y.max() else -20.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    out, roots = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + l2), lo, hi))
        me = len(nodes)
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gj = np.cumsum(np.bincount(code[rows, j], g[rows], len(e) + 1))[:-1]
                hj = np.cumsum(np.bincount(code[rows, j], h[rows], len(e) + 1))[:-1]
                vl, vr = np.clip(-gj / (hj + l2), lo, hi), np.clip(-(gs - gj) / (hs - hj + l2), lo, hi)
                gain = gj**2 / (hj + l2) + (gs - gj) ** 2 / (hs - hj + l2) - gs**2 / (hs + l2)
                gain[(hj < least) | (hs - hj < least)] = -1
                if constraints[j]:
                    gain[(vr - vl) * constraints[j] < 0] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k, vl[k], vr[k])
        _, j, k, vl, vr = best
        if j >= 0:
            go = code[rows, j] <= k
            mid = (vl + vr) / 2
            a, b = ((lo, mid), (mid, hi)) if constraints[j] > 0 else ((mid, hi), (lo, mid)) if constraints[j] < 0 else ((lo, hi), (lo, hi))
            left = grow(rows[go], g, h, level + 1, *a)
            right = grow(rows[~go], g, h, level + 1, *b)
            nodes[me] = [j, edges[j][k], left, right, 0.0]
        return me

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-out))
        roots.append(grow(np.arange(len(y)), q - y, np.maximum(q * (1 - q), 1e-6), 0, -np.inf, np.inf))
        f, c, le, r, v = (np.array(z) for z in zip(*nodes, strict=True))
        out += Trees(f, c, le, r, v, np.array(roots[-1:]), 0.0, depth).raw(x)
    f, c, le, r, v = (np.array(z) for z in zip(*nodes, strict=True))
    return Trees(f, c, le, r, v, np.array(roots), base, depth)


#: The trees are fitted on at most so many labelled documents, those with the least hash of their id.
FIT_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, target: str = "quality") -> DataFrame:
    """At most ``rows`` labelled documents (the least hashes of doc_id), as doc_id, text and label y.

    A document with several labels takes the highest; null ids and labels don't count."""
    ids = least_hashes(labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("double").alias("y")), rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most FIT_ROWS rows of 16 bytes


def featured(df: DataFrame, carry: str, feature_rows) -> DataFrame:
    """``carry`` columns and an array of features made by ``feature_rows(list of texts)``."""
    fields = [f for f in df.schema.fields if f.name in carry.split()]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "x array<double>"])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = feature_rows(b.column(b.schema.get_field_index("text")).to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), flat], names=[*names, "x"])

    return df.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on a bounded sample of labelled documents; only its statistics come to the driver."""
    got = featured(labelled_sample(docs, labels, rows), "doc_id y", statistics_of).collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in got]).reshape(len(got), len(NAMES))
    return boost(x, np.array([float(r["y"] > 0) for r in got]), list(STATISTICS.values()))


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judged(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """Statistics, base rules and verdict of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            x = statistics_of(texts)
            n, repeat = x[:, 0].astype(np.int64), x[:, 4].astype(np.int64)
            failed = (n < 10) | (100 * repeat > 20 * n)
            score = trees.score(x)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(x[:, i].astype(np.int64)) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                names=[c.split()[0] for c in OUT.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
