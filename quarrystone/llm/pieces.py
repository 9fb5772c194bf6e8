"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A text is cut into words, each a run of spaces with what follows, as no piece holds a space
after another character.  The words not seen yet are laid out as one flat symbol array.  In
each round the least pair rank of every word is found by a segmented minimum, all of the
word's pairs of that rank merge at once from the left, and the arrays are compacted, until no
pair is left.  A rank whose merged piece is part of a better-ranked piece merges one pair a
round, so that the result is always that of merging the best pair at a time.

Edge cases: null counts as empty; an empty text gives only the begin and end ids; characters
outside the vocabulary become their bytes; bytes that aren't UTF-8 decode to U+FFFD each.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Words whose ids a worker remembers; beyond, it starts again.
REMEMBER = 300_000
_RUN = re.compile(" +[^ ]*")
codecs.register_error("byte_by_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Model:
    """The vocabulary and merge table of a SentencePiece BPE model file; the library only reads the file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        of = {names[i]: i for i in plain}
        for p in of:
            if SPACE in p[1:] and p.strip(SPACE):
                raise ValueError("a piece holds a space after another character")
        self.byte = np.zeros(256, np.int64)
        self.symbol: dict[str, int] = {p: i for p, i in of.items() if len(p) == 1}
        symbols = dict(of)
        for p in of:  # characters that only occur within pieces can merge too
            for c in p:
                if c not in symbols:
                    symbols[c] = self.symbol[c] = n + len(symbols)
        self.bytes_of: list[bytes] = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for i in range(n):
            if sp.is_control(i):
                self.bytes_of[i] = b""
            elif sp.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif sp.is_byte(i):
                b = int(names[i][3:5], 16)
                self.byte[b], self.bytes_of[i] = i, bytes([b])
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.leads = [x.startswith(SPACE) for x in names]
        self.vocab = n
        self.base = n + len(symbols) + 1
        score = {p: sp.get_score(i) for p, i in of.items()}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        shared = np.bincount([rank[s] for s in score.values()], minlength=len(rank)) > 1
        keys, ranks, to, one = [], [], [], shared.copy()
        for p, i in of.items():
            r = rank[score[p]]
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbols and b in symbols:
                    keys.append(symbols[a] * self.base + symbols[b])
                    ranks.append(r)
                    to.append(i)
                for part in (a, b):
                    if part in score and rank[score[part]] >= r:
                        one[rank[score[part]]] = True
        order = np.argsort(keys)
        self.keys, self.ranks, self.to = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order], np.array(to, np.int64)[order]
        self.one, self.none = one, len(rank)
        self.seen: dict[str, bytes] = {}

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; rank ``none`` where it doesn't merge."""
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        ok = self.keys[at] == key
        return np.where(ok, self.ranks[at], self.none), self.to[at]

    def learn(self, words: Sequence[str]) -> None:
        """Encodes words (each without its first space) in merge rounds, and remembers them as little-endian ids."""
        texts = [SPACE + w.replace(" ", SPACE) for w in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        unknown = self.base - 1
        get = self.symbol.get
        sym = np.fromiter((get(c, unknown) for c in joined), np.int64, len(joined))
        char = np.arange(len(joined))  # the first character of each symbol, for those that have no id
        word = np.repeat(np.arange(len(texts)), lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), self.none)
        to = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self._pairs(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = self.none
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            open_ = least < self.none
            if not open_.all():  # words without pairs leave
                stay = np.repeat(open_, size)
                done.append((word[~stay], sym[~stay], char[~stay]))
                sym, word, char, rank, to = sym[stay], word[stay], char[stay], rank[stay], to[stay]
                if not len(sym):
                    break
                size, least = size[open_], least[open_]
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # leftmost first: of pairs that overlap in a row, every other one
            new = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            start = hit[np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))]
            take = (hit - start) % 2 == 0
            owner = word[hit]
            lone = self.one[rank[hit]] & np.concatenate([[False], owner[1:] == owner[:-1]])
            at = hit[take & ~lone]
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.zeros(len(sym), bool)
            moved[at] = True
            sym, word, char, rank, to, moved = sym[keep], word[keep], char[keep], rank[keep], to[keep], moved[keep]
            # only pairs beside a merged symbol change
            look = moved.copy()
            look[:-1] |= moved[1:]
            i = np.flatnonzero(look)
            last = i == len(sym) - 1
            j = np.where(last, i, i + 1)
            r, m = self._pairs(sym[i], sym[j])
            r[last | (word[i] != word[j])] = self.none
            rank[i], to[i] = r, m
        if not done:
            return
        word, sym, char = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, sym, char = word[order], sym[order], char[order]
        odd = np.flatnonzero(sym >= self.vocab)
        if len(odd):  # characters without a piece: their bytes
            raw = [joined[c].encode("utf-8", "replace") for c in char[odd].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(x) for x in raw]
            at = np.cumsum(times) - times
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            where = np.concatenate([np.arange(at[o], at[o] + len(x)) for o, x in zip(odd, raw, strict=True)])
            sym[where] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        flat = sym.astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(texts)))])).tolist()
        for i, w in enumerate(words):
            self.seen[w] = flat[cuts[i] : cuts[i + 1]]

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text, each without its first space; the dummy space before a text belongs to its first word."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        return [w[1:] for w in _RUN.findall(" " + text)] if "  " in text or text[0] == " " else text.split(" ")

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        cut = [self.words(t or "") for t in texts]
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        new = set().union(*cut).difference(self.seen)
        if new:
            self.learn(sorted(new))
        get = self.seen.__getitem__
        a, z = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        return [b"".join([a, *map(get, w), z]) for w in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids, as little-endian unsigned 32-bit integers."""
        at = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.bytes_of.__getitem__, at))
        for i in at:  # the dummy space of the first piece that shows
            if i in self.control:
                continue
            if self.leads[i]:
                raw = raw[1:]
            break
        return raw.decode("utf-8", "byte_by_byte")


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and digests of the ids and of the decoded text; one pass, no shuffle.  The file is read where it runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path or default_path())
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = m.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(m.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids])],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path or default_path())
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in m.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
