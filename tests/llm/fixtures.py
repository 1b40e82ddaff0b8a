"""Awkward documents, and plain functions that the operators are held against."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, score double, digest string, path string, flags string, length long, shard int, rep long, key long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, a shared passage."""
    base = passage(1, 120)
    shared = passage(2, 60)
    near = base.split()
    near[60] = "changed"
    long = passage(3, 9000)
    texts = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, passage(4, 30) + "\n" + shared + " tail"), (5, shared + " " + passage(5, 50)),
        (6, None), (7, ""), (8, " \t\n "), (9, "one"), (10, "one"), (11, "one two three four"), (12, long), (13, passage(6, 20) + " " + long),
        (14, "Of " * 300), (15, "ABC!! DEF!! " * 80), (16, "a | b | c # d " * 40), (17, "é ß 中文字 😀 Ünï ́x <|endoftext|> it's 12,5"), (18, "x" * 5000), (19, base.upper()),
        (None, base), (None, None), (20, "same id, first text " * 5), (20, "same id, other text " * 5),
    ]
    return [(i, t, None, None, None, None, None, None, None, None, None, None, None, None, None) for i, t in texts]


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, pairs=((1, 1, 0), (3, 1, 0), (4, 1, 1), (12, 1, 0), (14, 0, 0), (15, 0, 1), (16, 0, 0), (None, 1, 1), (6, None, None), (9, 1, 0))):
    return spark.createDataFrame(list(pairs), "doc_id long, quality int, toxic int")


def removed_words(docs, window=13):
    """{(id, text): flags of removed words} by the plain definition; docs without an id take no part."""
    first = {}
    for i, t in docs:
        w = words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = {}
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out[i, t] = gone
    return out


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def jaccard_groups(docs, threshold=0.8):
    """{id: (smallest id of the group, links)} by comparing all pairs of rows with an id."""
    held = [(i, shingles(t)) for i, t in docs if i is not None]
    links, parent = [0] * len(held), list(range(len(held)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(held)):
        for b in range(a):
            x, y = held[a][1], held[b][1]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(held):
        least[root(a)] = min(i, least.get(root(a), i))
    return [(i, least[root(a)], links[a]) for a, (i, _) in enumerate(held)]


def thue_morse(n=10):
    """Two texts of 2 ** n letters that swap a and b, and whose sums by powers of any odd number agree modulo 2 ** 64."""
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))
