"""Secret scans: fixed patterns, and Markov models of characters that tell random strings from identifiers.

One bigram model is trained for each kind of random string (hex, upper case with digits,
letters with digits, base64), one for ordinary identifiers and words.  A token's score is the
best log-likelihood ratio of a random kind against the ordinary model, per character.  Tokens of
LEAST characters or more over the threshold, which held-out labelled samples set, are spans of
kind ``markov`` where they touch no span of the fixed patterns; of a token that isn't, its parts
between separators are tried.  Nothing but the ratio decides: words, numbers and identifiers are
ordinary because the model has learnt them, words from all documents.

Edge cases: null counts as empty; an empty text has no spans and the digest of the empty
string and no best score; rows are judged each for itself, so repeated rows get equal results;
an empty table gives no rows, and its models know only the generated samples.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, numbered, table

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f] is whole, so shorter runs are those that fail
_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Characters that a token must have to be judged.
LEAST = 16
_CANDIDATE, _PART = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"), re.compile(rf"[A-Za-z0-9+]{{{LEAST},}}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    out: list[Span] = []
    if ("=" in text or ":" in text) and any(k in low for low in (text.lower(),) for k in _KEYS):
        out += (("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6)
    if "AKIA" in text:
        out += (("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20)
    out += (("hex", m.start(), m.end()) for m in _HEX.finditer(text))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, len(_ALPHABET), np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_N = len(_ALPHABET) + 2  # others, and the place before the first character


def _codes(token: str) -> np.ndarray:
    raw = np.frombuffer(token.encode("ascii", "replace"), np.uint8)
    return np.concatenate([[_N - 1], _CODE[raw]])


def bigrams(samples: Iterable[str]) -> np.ndarray:
    """How often each character comes after each."""
    n = np.zeros((_N, _N), np.int64)
    for s in samples:
        c = _codes(s)
        np.add.at(n, (c[:-1], c[1:]), 1)
    return n


def bigram_model(samples: Iterable[str], smooth: float = 0.5, more: np.ndarray | None = None) -> np.ndarray:
    """Log-probabilities of each character after each; ``more``: further bigrams."""
    n = bigrams(samples) + smooth + (0 if more is None else more)
    return np.log(n / n.sum(axis=1, keepdims=True))


@dataclass
class Models:
    ordinary: np.ndarray
    kinds: list[np.ndarray]
    threshold: float

    def score(self, token: str) -> float:
        c = _codes(token)
        plain = self.ordinary[c[:-1], c[1:]].sum()
        return float(max(m[c[:-1], c[1:]].sum() for m in self.kinds) - plain - np.log(len(self.kinds))) / (len(c) - 1)


_HEXED, _UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
RANDOM_KINDS = {"hex": _HEXED, "upper": _UPPER, "letters": _ALPHABET[:62], "base64": _ALPHABET[:64]}
_STEMS = (
    "get set user name index value file path config table column row count list map item node tree parse read write open close data text line word "
    "token key hash number total size length start end first last next prev buffer stream request response client server session cache queue event handler "
    "manager factory service model view render update delete insert select order price customer account address message error status result default option"
).split()


def random_strings(n: int, seed: int = 17) -> dict[str, list[str]]:
    """Labelled samples of the random kinds, 20 to 64 characters each."""
    rng = random.Random(seed)
    return {k: ["".join(rng.choice(a) for _ in range(rng.randrange(20, 65))) for _ in range(n)] for k, a in RANDOM_KINDS.items()}


def identifiers(n: int, seed: int = 18) -> list[str]:
    """Labelled samples of ordinary identifiers, paths, slugs and numbers of at least LEAST characters."""
    rng = random.Random(seed)
    out: list[str] = []
    while len(out) < n:
        w = [rng.choice(_STEMS) for _ in range(rng.randrange(3, 9))]
        number = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(2, 20))) for _ in range(rng.randrange(1, 5))]
        kind = rng.randrange(6)
        s = ["_".join(w), "-".join(w), "/".join(w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper(), "-".join(number)][kind]
        s += rng.choice(["", "", str(rng.randrange(100)), f"_{rng.randrange(1990, 2030)}", "=" * rng.randrange(20)])
        if len(s) >= LEAST:
            out.append(s)
    return out


def train(random_samples: dict[str, list[str]], ordinary: list[str], words: Iterable[str] | np.ndarray = ()) -> Models:
    """Models from four fifths of the labelled samples; the threshold is between the rest's scores.

    ``words`` are further ordinary strings or their bigrams, only for training: shorter than candidates may be."""
    held = lambda v: [x for i, x in enumerate(v) if i % 5 == 0]
    rest = lambda v: [x for i, x in enumerate(v) if i % 5]
    more = words if isinstance(words, np.ndarray) else bigrams(words)
    got = Models(bigram_model(rest(ordinary), more=more), [bigram_model(rest(v)) for v in random_samples.values()], 0.0)
    plain = sorted(map(got.score, held(ordinary)))
    odd = sorted(got.score(x) for v in random_samples.values() for x in held(v))
    low, high = plain[-1 - len(plain) // 1000] if plain else 0.0, odd[len(odd) // 100] if odd else 0.0
    got.threshold = (low + high) / 2 if high > low else low
    return got


def judged(text: str, models: Models) -> tuple[list[Span], float | None]:
    """Base spans and those that the models add, by start, then kind; and the best score of all tokens judged."""
    out, best = base_spans(text), None
    base = list(out)
    at = 0
    for m in _CANDIDATE.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        for tried in ([m], _PART.finditer(text, *m.span())):  # the whole token, else its parts
            found = False
            for p in tried:
                score = models.score(p[0])
                best = score if best is None else max(best, score)
                if score > models.threshold and not _touches(base, at, *p.span()):
                    out.append(("markov", *p.span()))
                    found = True
            if found:
                break
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]))), best


def _touches(base: list[Span], at: int, a: int, b: int) -> bool:
    """Whether a span of ``base`` from ``at`` on, by start, meets [a, b)."""
    while at < len(base) and base[at][1] < b:
        if a < base[at][2]:
            return True
        at += 1
    return False


def spans(text: str, models: Models) -> list[Span]:
    """Base spans and those that the models add, by start, then kind."""
    return judged(text, models)[0]


#: Samples of each random kind, and of identifiers.
SAMPLES = 2000


def word_bigrams(docs: DataFrame) -> np.ndarray:
    """Bigrams of the distinct plain words of all documents, counted where the words are; at most _N * _N sums reach the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[A-Za-z]+"), F.lit(0))).alias("w")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((_N, _N), np.int64)
        for b in batches:
            raw = np.frombuffer("\n".join(["", *b.column(0).to_pylist(), ""]).encode(), np.uint8)
            c = np.where(raw == 10, _N - 1, _CODE[raw])
            n += np.bincount((c[:-1] * _N + c[1:])[c[1:] != _N - 1], minlength=_N * _N).reshape(_N, _N)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n.ravel()[at], pa.int64())], names=["pair", "n"])

    out = np.zeros(_N * _N, np.int64)
    for r in words.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(_N, _N)


def fitted(docs: DataFrame, samples: int = SAMPLES) -> Models:
    """Models from generated labelled samples and the distinct plain words of all documents."""
    return train(random_strings(samples), identifiers(samples), word_bigrams(docs))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long, best_score double"


def scanned(docs: DataFrame, models: Models) -> DataFrame:
    """Counts and spans of every document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, best = zip(*(judged(t or "", models) for t in b.column(1).to_pylist()), strict=True) if b.num_rows else ((), ())
            base = [[s for s in x if s[0] != "markov"] for x in found]
            count = lambda k: pa.array([sum(s[0] == k for s in x) for x in found], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(count, KINDS[:3]), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()), pa.array(map(joined, found), pa.string()), count("markov"), pa.array(best, pa.float64())],
                names=[c.split()[0] for c in OUT.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


def redacted(docs: DataFrame, models: Models, by: str = "[SECRET]") -> DataFrame:
    """``docs``, its columns as they are, with every span of ``text`` replaced; ``n_chars`` follows where it is there.

    Rows without spans stay as they are, null texts stay null, and an empty table stays empty."""
    names = docs.columns

    def clean(text: str | None) -> str | None:
        found = spans(text, models) if text else []
        if not found:
            return text
        keep, pos = [], 0
        for _, a, b in found:
            if a >= pos:
                keep += [text[pos:a], by]
            pos = max(pos, b)
        return "".join([*keep, text[pos:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(names, b.columns, strict=True))
            old = cols["text"].to_pylist()
            new = [clean(t) for t in old]
            cols["text"] = pa.array(new, cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if x == y else len(y) for n, x, y in zip(cols["n_chars"].to_pylist(), old, new, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=[f"c{i}" for i in range(len(names))])

    return numbered(docs).mapInArrow(run, fields(docs)).toDF(*names)


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, fitted(docs))
