"""Quality classifier by co-training.

Two views of a document, the statistics of its text and the metadata of its page (language,
source and declared size), each train a logistic classifier on the labelled rows.  In every
round each classifier labels all unlabelled documents that it is sure of for the other one's
training, at a bar that falls from round to round; their part in the other's Newton steps is
summed where the documents are, and counts for no more than a share of the labelled rows.
Both are then calibrated on held-out labelled rows, and the calibrated log-odds are combined,
by a third fit on the same rows, into the score of every document.

Edge cases: null text counts as empty, null language, source or size as a value of its own;
without labels of both kinds every document has score 1 and is kept; repeated rows get equal
results, and an id that is labelled twice counts as good if one label is; ties can't matter, as
rows are judged each for itself; rows with a null id are scored but don't train; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fields, least_hashes, numbered, table
from .neardup import BROADCAST_IDS
from .rules import statistics_of

#: Bound of the labelled rows that train: those with the least hashes of doc_id.
LABELLED = 20_000
#: Rounds, and how sure a view must be of a document in the first and in the last one.
ROUNDS, SURE = 5, (0.998, 0.98)
#: Least score of a kept document; below one half, as losing a clean document costs more than keeping a poor one.
KEEP = 0.25


def text_view(texts: list[str | None]) -> np.ndarray:
    x = statistics_of(texts)
    x[:, :5] = np.log1p(x[:, :5])
    x[:, 12:14] = np.log1p(x[:, 12:14])
    return np.column_stack([x, np.sqrt(np.maximum(x[:, 5:8], 0)), np.sqrt(x[:, 16:18])])


@dataclass(frozen=True)
class Metadata:
    """The page's side of a document: its language, source and declared size; the text has no part in it.

    Languages and sources of enough labelled rows have columns of their own, null and all others share one each."""

    langs: tuple[str | None, ...] = ()
    sources: tuple[str | None, ...] = ()

    @staticmethod
    def of(langs: list, sources: list, least: int = 10, most: int = 100) -> Metadata:
        def known(values: list) -> tuple:
            n = Counter(values)
            return tuple(v for v, k in sorted(n.items(), key=lambda x: (-x[1], str(x[0])))[:most] if k >= least)

        return Metadata(known(langs), known(sources))

    def view(self, langs: list, sources: list, sizes: list) -> np.ndarray:
        out = np.zeros((len(sizes), len(self.langs) + len(self.sources) + 5))
        base = 0
        for known, values in ((self.langs, langs), (self.sources, sources)):
            at = {v: i for i, v in enumerate(known)}
            place = np.fromiter((base + at.get(v, len(known)) for v in values), np.int64, len(values))
            out[np.arange(len(place)), place] = 1
            base += len(known) + 1
        size = np.log1p(np.fromiter((max(n or 0, 0) for n in sizes), np.float64, len(sizes)))
        out[:, base], out[:, base + 1], out[:, base + 2] = size, size * size, [n is None for n in sizes]
        return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, l2: float = 1e-3, steps: int = 30) -> Logistic:
    """Ridge logistic regression by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    c = np.ones(len(x)) if weights is None else weights
    c, w = c / c.sum(), np.zeros(z.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (c * (p - y)) + ridge * w
        h = (z * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


@dataclass
class CoTrained:
    views: tuple[Logistic, Logistic] | None
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    mix: tuple[float, float, float] = (1.0, 1.0, 0.0)
    metadata: Metadata = Metadata()

    def logits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of the two views and of both together, one row each."""
        if self.views is None:
            return np.full((3, len(a)), 30.0)
        u, v = (s * m.logit(x) + o for m, x, (s, o) in zip(self.views, (a, b), self.calibration, strict=True))
        return np.stack([u, v, self.mix[0] * u + self.mix[1] * v + self.mix[2]])


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Slopes and offset of a logistic fit that keeps the columns' signs."""
    m = logistic(x, y, l2=1e-3)
    w = np.maximum(m.weight / m.scale, 0)
    return (*map(float, w), float(m.bias - (m.mean * w).sum()))


def _padded(m: Logistic, x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip((x - m.mean) / m.scale, -8, 8), np.ones(len(x))])


Sums = list[list[tuple[float, np.ndarray, np.ndarray]]]


def pool_sums(students: tuple[Logistic, Logistic], teachers: tuple[Logistic, Logistic], cutoff: float, views: tuple[np.ndarray, np.ndarray]) -> Sums:
    """For each view and each label the number, gradient and curvature of the rows that the other view's teacher is sure of."""
    out: Sums = []
    z = [m.logit(x) for m, x in zip(teachers, views, strict=True)]
    for k in (0, 1):
        x = _padded(students[k], views[k])
        p = 1 / (1 + np.exp(-np.clip(x @ np.append(students[k].weight, students[k].bias), -30, 30)))
        out.append([])
        for label in (0.0, 1.0):
            sure = z[1 - k] > cutoff if label else z[1 - k] < -cutoff
            v, q = x[sure], p[sure]
            out[k].append((float(sure.sum()), v.T @ (q - label), (v * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ v))
    return out


#: Weight of all pseudo-labels of a kind, as a share of the labelled rows of that kind; Newton steps of a round.
GIVEN, STEPS = 0.3, 2


def cotrain(a: np.ndarray, b: np.ndarray, y: np.ndarray, sums: Callable[..., Sums], rounds: int = ROUNDS, sure: tuple[float, float] = SURE) -> CoTrained:
    """a, b, y: the views and labels of labelled rows; ``sums(students, teachers, cutoff)``: pool_sums() over all unlabelled rows."""
    if not len(y) or y.min() == y.max():
        return CoTrained(None)
    held = np.arange(len(y)) % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    fit = ~held
    views, t = (a, b), y[fit]
    models = tuple(logistic(x[fit], t) for x in views)
    own = [_padded(m, x[fit]) for m, x in zip(models, views, strict=True)]
    kinds = [(t == 0).sum(), (t == 1).sum()]
    for r in range(rounds):
        teachers = models
        p = sure[0] + (sure[1] - sure[0]) * r / max(1, rounds - 1)
        for _ in range(STEPS):
            given = sums(models, teachers, float(np.log(p / (1 - p))))
            models = tuple(_step(m, x, t, given[k], kinds) for k, (m, x) in enumerate(zip(models, own, strict=True)))
    at = held if held.any() else fit
    cal = tuple(_line(m.logit(x[at])[:, None], y[at]) for m, x in zip(models, views, strict=True))
    got = CoTrained(models, cal)  # type: ignore[arg-type]
    got.mix = _line(got.logits(a[at], b[at])[:2].T, y[at])  # type: ignore[assignment]
    return got


def _step(m: Logistic, x: np.ndarray, t: np.ndarray, given: list[tuple[float, np.ndarray, np.ndarray]], kinds: list[int], l2: float = 1e-3) -> Logistic:
    """A Newton step on the labelled rows and the pseudo-labelled ones."""
    w = np.append(m.weight, m.bias)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    g, h, total = x.T @ (p - t), (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x, float(len(t))
    for (n, more, curve), known in zip(given, kinds, strict=True):
        share = GIVEN * min(1.0, known / n) if n else 0.0
        g, h, total = g + share * more, h + share * curve, total + share * n
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    step = np.linalg.solve(h / total + np.diag(ridge), g / total + ridge * w)
    w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return Logistic(m.mean, m.scale, w[:-1], float(w[-1]))


_META = ("lang", "source", "n_chars")
FEATURES = "doc_id long, lang string, source string, n_chars long, a array<double>"


def _matrix(c: pa.Array) -> np.ndarray:
    n = len(c)
    return c.flatten().to_numpy().reshape(n, -1) if n else text_view([])


def features(docs: DataFrame) -> DataFrame:
    """The text's statistics and the page's metadata of every document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_view(b.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["doc_id", *_META, "a"])

    kinds = ("long", "string", "string", "long", "string")
    return docs.select(*(F.col(n).cast(t) for n, t in zip(("doc_id", *_META, "text"), kinds, strict=True))).mapInArrow(run, FEATURES)


#: Sums of a pass over the pool travel as whole multiples of this, so that they don't depend on the order of the tasks.
UNIT = 2.0**-20


def frame_sums(pool: DataFrame, metadata: Metadata) -> Callable[..., Sums]:
    """pool_sums() over a table of features; a task sends its sums, which meet entry by entry."""

    def sums(students, teachers, cutoff) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                cols = dict(zip(b.schema.names, b.columns, strict=True))
                views = _matrix(cols["a"]), metadata.view(*(cols[n].to_pylist() for n in _META))
                flat = np.concatenate([np.concatenate([[n], g, h.ravel()]) for kind in pool_sums(students, teachers, cutoff, views) for n, g, h in kind])
                total = flat if total is None else total + flat
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(total[at] / UNIT).astype(np.int64))], names=["at", "v"])

        wide = [len(m.weight) + 1 for m in students]
        flat = np.zeros(2 * sum(1 + d + d * d for d in wide))
        for r in pool.select(*_META, "a").mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():  # a few thousand sums
            flat[r["at"]] = r["v"] * UNIT
        out: Sums = []
        for d in wide:
            out.append([])
            for _ in range(2):
                n, g, h, flat = flat[0], flat[1 : 1 + d], flat[1 + d : 1 + d + d * d].reshape(d, d), flat[1 + d + d * d :]
                out[-1].append((float(n), g, h))
        return out

    return sums


def fit(found: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """A model from ``found``, a written table of features(): a bounded sample of labelled rows, whose features come to
    the driver, and all rows without labels, of which only sums do."""
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    n = truth.count()
    rows = sorted(found.join(F.broadcast(least_hashes(truth, labelled)), "doc_id").collect(), key=lambda r: (r["doc_id"], r["a"]))  # at most ``labelled`` ids
    meta = Metadata.of([r["lang"] for r in rows], [r["source"] for r in rows])
    a = np.array([r["a"] for r in rows]).reshape(len(rows), text_view([]).shape[1])
    b = meta.view(*([r[k] for r in rows] for k in _META))
    pool = found.where("doc_id IS NOT NULL").join(F.broadcast(truth.select("doc_id")) if n <= BROADCAST_IDS else truth.select("doc_id"), "doc_id", "left_anti")
    if n > BROADCAST_IDS:
        pool = cut(pool, "pool")
    got = cotrain(a, b, np.array([r["y"] > 0 for r in rows], float), frame_sums(pool, meta), rounds)
    got.metadata = meta
    return got


OUT = "text_score double, metadata_score double, score double, kept boolean"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _scores(model: CoTrained, threshold: float, a: np.ndarray, metadata: list[list]) -> list[pa.Array]:
    z = model.logits(a, model.metadata.view(*metadata))
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return [*(pa.array(x) for x in p), pa.array(p[2] >= threshold)]


def scored_features(found: DataFrame, model: CoTrained, threshold: float = KEEP) -> DataFrame:
    """doc_id of every row of features() with the calibrated scores of both views and of both together; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            yield pa.RecordBatch.from_arrays([cols["doc_id"], *_scores(model, threshold, _matrix(cols["a"]), [cols[n].to_pylist() for n in _META])], names=["doc_id", *_NAMES])

    return found.mapInArrow(run, f"doc_id long, {OUT}")


def scored(docs: DataFrame, model: CoTrained, carry: list[str], threshold: float = KEEP) -> DataFrame:
    """``carry`` columns of every document and OUT: the calibrated scores of both views and of both together; no shuffle.

    A carried column with the name of a result keeps the name, and the result gets ``_`` before its own."""
    need = list(dict.fromkeys([*carry, "text", *_META]))
    names = result_names(carry)
    docs = docs.select(*(F.col(f"`{n}`") for n in need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(need, batch.columns, strict=True))
            got = _scores(model, threshold, text_view(cols["text"].to_pylist()), [cols[n].to_pylist() for n in _META])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *got], names=[*(f"c{i}" for i in range(len(carry))), *_NAMES])

    return numbered(docs).mapInArrow(run, ", ".join([*fields(docs).split(", ")[: len(carry)], OUT])).toDF(*carry, *names)


def result_names(carry: list[str]) -> list[str]:
    """Names of the results beside the carried columns; the last one says whether a document is kept."""
    taken, out = {n.lower() for n in carry}, []
    for n in _NAMES:
        while n in taken:
            n = f"_{n}"
        out.append(n)
        taken.add(n)
    return out


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = KEEP) -> DataFrame:
    """``docs``, its columns as they are, without the documents that the classifier rejects."""
    model = fit(cut(features(docs), "features"), labels)
    return scored(docs, model, docs.columns, threshold).where(f"`{result_names(docs.columns)[-1]}`").select(*(F.col(f"`{n}`") for n in docs.columns))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(features(table(spark, sf_dir, "documents")), "features")
    return scored_features(found, fit(found, table(spark, sf_dir, "labels")))
