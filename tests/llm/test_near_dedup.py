"""Near-dedup against exact sets of all pairs; parts of it alone."""

import random
import re

import numpy as np

from wavepanel.llm import near_dedup as N


def sets(rows, size):
    out = []
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        g = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        out.append((i, g))
    return out


def plain(rows, size, percent):
    found = sets(rows, size)
    at = list(range(len(found)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                at[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(found):
        groups.setdefault(root(k), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted(((i, len(g), least[root(k)], i == least[root(k)]) for k, (i, g) in enumerate(found)), key=repr)


def check(docs, rows, size=3, percent=85):
    got = sorted((tuple(r) for r in N.near_duplicates(docs(rows), size=size, percent=percent).collect()), key=repr)
    assert got == plain(rows, size, percent)
    return got


def test_sample_against_all_pairs(docs, sample):
    check(docs, sample)


def test_chains_groups_and_edges(docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    rows, text = [], list(base)
    for i in range(40):  # a chain: each text a little further from the first
        rows.append((200 - i, " ".join(text)))
        text = list(text)
        text[rng.randrange(len(text))] = f"x{i}"
    for i in range(60):  # a star: copies that differ in one word each
        t = list(base)
        t[i] = f"y{i}"
        rows.append((300 + i, " ".join(t)))
    rows += [(1000 + i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(40)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "É"), (9, "é"), (50, " ".join(base)), (50, " ".join(base))]
    rows += [(60, " ".join(f"long{i}" for i in range(9000))), (61, " ".join(f"long{i}" for i in range(9000)) + " end")]
    got = check(docs, rows)
    assert dict((r[0], r[2]) for r in got)[61] == 60


def test_defaults_nulls_and_empty(docs):
    rows = [(None, "a b c d e f g h"), (None, "x y z u v w"), (3, "a b c d e f g h")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs(rows)).collect()}
    assert got == {(None, 3, False), (None, None, True), (3, 3, True)}
    assert N.near_duplicates(docs([])).count() == 0


def test_clashing_columns(docs):
    from pyspark.sql import functions as F

    t = docs([(1, "a b c d e f"), (2, "a b c d e f")])
    for c in ("cid", "bands", "sketch", "band", "root", "component_id", "kept", "x"):
        t = t.withColumn(c, F.lit(1))
    assert {tuple(r)[:1] + tuple(r)[2:] for r in N.near_duplicates(t).collect()} == {(1, 1, True), (2, 1, False)}


def bits(x, y):
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    limit, over = N.most_differing_bits(85), 0
    for _ in range(200):
        pool = rng.integers(1, 1 << 63, 600, dtype=np.uint64)
        a, b = pool[:555], pool[45:]  # similarity 0.85
        x, y = N.odd_sketch(N.samples(np.sort(a))), N.odd_sketch(N.samples(np.sort(b)))
        over += bits(x, y) > limit
    assert over == 0
    a, b = rng.integers(1, 1 << 63, 500, dtype=np.uint64), rng.integers(1, 1 << 63, 500, dtype=np.uint64)
    assert bits(N.odd_sketch(N.samples(a)), N.odd_sketch(N.samples(b))) > limit
    assert (1 - 0.85**N.ROWS) ** N.BANDS < 1e-6


def test_components_of_a_path_and_a_star(spark):
    path = [(bytes([i]), bytes([i + 1])) for i in range(1, 30)]
    star = [(bytes([100]), bytes([100 + i])) for i in range(1, 50)]
    edges = spark.createDataFrame(path + star, "a binary, b binary")
    got = {bytes(r["cid"]): bytes(r["root"]) for r in N.components(edges).collect()}
    assert got == {**{bytes([i]): bytes([1]) for i in range(1, 31)}, **{bytes([100 + i]): bytes([100]) for i in range(50)}}
