"""Awkward rows and brute-force twins."""

import collections
import re

import numpy as np
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, raw string, size string, block string, cls string, rid string"
LONG = " ".join(f"wort{i * i % 977}" for i in range(60_000))


def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns named like internals."""
    clash = ("x",) * 7
    some = "The cat sat on the mat and then it went to the house by the sea with all of its friends"
    rows = [
        (1, None, "en", "a", None, *clash),
        (2, "", None, None, 0, *clash),
        (3, " \t\n ", "en", "a", 4, *clash),
        (4, some, "en", "a", len(some), *clash),
        (4, some, "en", "a", len(some), *clash),
        (5, some, None, None, len(some), *clash),
        (None, some + " today", "en", "b", 3, *clash),
        (None, None, None, None, None, *(None,) * 7),
        (6, LONG, "de", "b", len(LONG), *clash),
        (7, LONG[200_000:], "de", "b", 1, *clash),
        (8, "a" * 3000, "en", "c", 1, *clash),
        (9, "één twee 日本語 😀 " * 80, "nl", "c", 1, *clash),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_components(rows, k=3, percent=85):
    """{place: component} of (id, text) rows by comparing all that share a shingle."""
    sets, by = [shingles(t, k) for _, t in rows], collections.defaultdict(list)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in by[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(at)] = find(j)
        for x in s:
            by[x].append(at)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, float("inf")), float("inf") if i is None else i)
    return [None if least[find(k)] == float("inf") else least[find(k)] for k in range(len(rows))], sets


def without_repeats(raws, least=400):
    """(kept bytes, removed, spans) for each text by counting all strings of `least` bytes."""
    seen = collections.Counter(b[a : a + least] for b in raws for a in range(len(b) - least + 1))
    out = []
    for b in raws:
        cover = np.zeros(len(b) + 1, np.int64)
        for a in range(len(b) - least + 1):
            if seen[b[a : a + least]] > 1:
                cover[a] += 1
                cover[a + least] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((bytes(np.frombuffer(b, np.uint8)[~gone]), int(gone.sum()), spans))
    return out


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*[F.col(c) for c in cols]).collect()]


def trigrams(text):
    padded = "\0\0" + text
    return [padded[i : i + 3] for i in range(len(text))]


class KneserNey:
    """Interpolated modified Kneser-Ney over characters, by dictionaries."""

    def __init__(self, texts, least=1):
        grams = collections.Counter(g for t in texts for g in trigrams(t))
        two = collections.Counter(g[1:] for g in grams)
        self.levels = [(collections.Counter(g[1:] for g in two), 1), (two, 1), (grams, least)]
        self.cuts = []
        for level, _ in self.levels:
            n1, n2, n3, n4 = (max(sum(v == k for v in level.values()), 1) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            self.cuts.append([max(0.1, min(m, x)) for x, m in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.9), (3 - 4 * y * n4 / n3, 2.85))])

    def p(self, gram):
        p = 1 / (len(self.levels[0][0]) + 1) if self.levels[0][0] else 0.0
        for order, ((level, least), cut) in enumerate(zip(self.levels, self.cuts, strict=True), 1):
            own = gram[3 - order :]
            mates = {g: n for g, n in level.items() if g[:-1] == own[:-1]}
            if mates:
                total = sum(mates.values())
                p *= sum(cut[min(n, 3) - 1] if n >= least else n for n in mates.values()) / total
                if level[own] >= least:
                    p += (level[own] - cut[min(level[own], 3) - 1]) / total
        return p
