"""Line dedup against a plain version."""

import hashlib
import random

from wavepanel.llm import line_dedup


def cut(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [((h[i - 1] if i else 0) * line_dedup.MULTIPLIER + x) % (1 << 32) for i, x in enumerate(h)]
    ends = [i + 1 for i in range(1, len(lines) - 2) if r[i] < min(r[i - 1], r[i + 1])]
    return [lines[a:b] for a, b in zip([0, *ends], [*ends, len(lines)])]


def plain(rows):
    first = {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, c in enumerate(cut(text)):
            first.setdefault("\n".join(c), (i, text, k))
    out = []
    for i, text in rows:
        chunks = cut(text)
        gone = [c for k, c in enumerate(chunks) if len(c) > 1 and first["\n".join(c)] != (i, text, k)]
        kept = [c for k, c in enumerate(chunks) if len(c) < 2 or first["\n".join(c)] == (i, text, k)]
        out.append((i, sum(map(len, chunks)), sum(map(len, gone)), len(gone), text if not gone else "\n".join("\n".join(c) for c in kept)))
    return out


def check(docs, rows):
    got = line_dedup.line_dedup(docs(rows)).select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)
    return got


def test_against_plain_version(docs, sample):
    check(docs, sample)


def test_shared_passage_and_edges(docs):
    passage = "\n".join(f"shared line {i}" for i in range(30))
    rows = [(i, f"own {i}\n{passage}\nlast {i}\nand {i}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "one line"), (104, "one line"), (105, passage), (106, "x\n" * 3000), (107, f"{passage}\n{passage}")]
    got = check(docs, rows)
    assert sum(r[2] for r in got if 0 < r[0] < 40) > 39 * 10


def test_repeated_rows_null_ids_and_clashing_columns(docs):
    from pyspark.sql import functions as F

    text = "\n".join(f"line {i}" for i in range(20))
    got = check(docs, [(5, text), (5, text), (None, "a\nb\nc\nd\ne\nf")])
    assert all(r[2] == 0 for r in got)
    t = docs([(1, text), (2, text)]).withColumn("h", F.lit(1)).withColumn("ks", F.lit(2)).withColumn("n_lines", F.lit("x")).withColumn("c", F.lit(3))
    out = line_dedup.line_dedup(t).orderBy("doc_id").collect()
    assert out[0]["n_lines"] == 20 and out[1]["n_removed_lines"] > 0 and out[1]["ks"] == 2 and out[1]["c"] == 3
    assert line_dedup.line_dedup(docs([])).count() == 0


def test_planted_passages_lose_lines(docs):
    """Passages of over 50 words in several documents, found by comparing lines and not by the rule that cuts chunks."""
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(13))
    rows, passages = [], []
    for k in range(60):
        passage = [line() for _ in range(rng.randint(4, 24))]
        for c in range(3):
            own = [line() for _ in range(rng.randint(0, 8))], [line() for _ in range(rng.randint(0, 8))]
            rows.append((10 * k + c, "\n".join([*own[0], *passage, *own[1]])))
            passages.append((10 * k + c, set(passage), {*own[0], *own[1]}))
    kept = {r["doc_id"]: set(r["text"].split("\n")) for r in line_dedup.line_dedup(docs(rows)).collect()}
    later = [(i, p, own) for i, p, own in passages if i % 10]
    assert all(own <= kept[i] for i, _, own in passages) and all(p <= kept[i] for i, p, _ in passages if i % 10 == 0)
    lost = [p - kept[i] for i, p, _ in later]
    assert sum(map(bool, lost)) >= 0.9 * len(later)
    assert sum(map(len, lost)) >= 0.7 * sum(len(p) for _, p, _ in later)
