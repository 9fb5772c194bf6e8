"""Plain restatements of the contracts, and a small table with the awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, extra=False):
    """A documents table; ids are given or counted."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'x' AS _k", "1 AS size", "'y' AS component_id", "2 AS rep") if extra else df


def awkward(rng, n=60, words=40):
    vocab = ["alpha", "Beta", "gamma", "DELTA", "épsilon", "zeta", "eta,", "theta.", "ßharp", "😀", "k=v", "#tag"] + [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, words))) for _ in range(n)]
    near = []
    for t in base[: n // 3]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *near, None, "", " ", "\n\t ", "one", "two words", "x\ny\nx\n\nx", base[0], base[0].upper(), base[1], " ".join(vocab) * 30, "a" * 5000]


def shingles(text, k, lower=True):
    w = WORD.findall((text or "").translate(LOWER) if lower else text or "")
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_links(texts: dict, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    return sets, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(data):
    return zlib.crc32(data)


__all__ = ["Counter", "components", "documents"]
