"""Mixing against a plain version, and what the weights must hold."""

import hashlib
import math
import re

from wavepanel.llm import mixing


def plain(rows, max_passes=4.0, gain=0.5, budget=None):
    """(doc_id, source, n, pass) of every copy; exponent by bisection over floats."""
    n = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for k, r in enumerate(rows)}
    size = {}
    for k, r in enumerate(rows):
        size[r[2]] = size.get(r[2], 0) + n[k]
    size = {s: t for s, t in size.items() if t}
    if not size:
        return []
    total = sum(size.values())
    budget = total if budget is None else budget
    p = [t / total for t in size.values()]

    def entropy(a):
        w = [x**a for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    def passes(a):
        return min(p) ** (a - 1) / sum(x**a for x in p) * budget / total

    def bisect(bad):
        if not bad(0.0):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if bad(mid) else (lo, mid)
        return hi

    goal = entropy(1) + (entropy(0) - entropy(1)) * gain if gain is not None else None
    a = max(bisect(lambda x: gain is not None and entropy(x) > goal), bisect(lambda x: passes(x) > max_passes))
    out = []
    for s, t in size.items():
        ppb = round((t / total) ** a / sum(x**a for x in p) * 1_000_000_000)
        due = ppb * budget // 1_000_000_000
        key = lambda r: hashlib.md5(f"wavepanel|cut|{'' if s is None else s}|{'' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: E731, B023
        own = [(key(r), n[k], r) for k, r in enumerate(rows) if r[2] == s]
        for h, m, r in own:
            upto = sum(y for x, y, _ in own if x <= h)
            copies = due // t + (upto <= due % t and due % t > 0)
            out += [(r[0], s, m, i, ppb) for i in range(copies)]
    return sorted(out, key=repr)


def check(docs, rows, **args):
    got = mixing.mix(docs(rows), **{{"gain": "entropy_gain", "budget": "budget_tokens"}.get(k, k): v for k, v in args.items()}).collect()
    assert sorted(((r["doc_id"], r["source"], r["n_tokens"], r["mix_pass"], r["weight_ppb"]) for r in got), key=repr) == plain(rows, **args)
    return got


def corpus():
    rows = [(i, "w " * (5 + i % 7), "hot") for i in range(300)]
    rows += [(1000 + i, "w " * (3 + i % 5), "mid") for i in range(60)] + [(2000 + i, "w " * 4, "rare") for i in range(6)]
    return rows


def test_against_plain_version(docs):
    got = check(docs, corpus())
    share = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in ("hot", "mid", "rare")}
    for r in got:  # each source gets its weight of the budget, but for one document at most
        due = r["weight_ppb"] / 1e9 * sum(len(x[1].split()) for x in corpus())
        assert due - 12 < share[r["source"]] <= due
    assert {r["mix_block"] for r in got} <= set(range(mixing.STREAM_BLOCKS))
    check(docs, corpus(), gain=None, max_passes=2.0)
    check(docs, corpus(), budget=500)


def test_stream_blocks_hold_the_weights(docs):
    got = mixing.mix(docs(corpus()), entropy_gain=1.0, max_passes=None).collect()
    half = [r for r in got if r["mix_block"] < mixing.STREAM_BLOCKS // 2]
    for s in ("hot", "mid", "rare"):
        a, b = (sum(r["n_tokens"] for r in x if r["source"] == s) for x in (half, got))
        assert 0.3 < a / b < 0.7


def test_edges(docs):
    from pyspark.sql import functions as F

    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (4, "x", None), (4, "x", None), (None, "p q r", "b"), (None, "p q r", "b"), (6, "long " * 20_000, "b"), (7, "", "void")]
    check(docs, rows)
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs([(1, None, "a"), (2, " ", None)])).count() == 0
    t = docs(corpus()[:20])
    for c in ("_k", "cut", "full", "reps", "n_tokens", "b", "n", "tokens", "mix_key"):
        t = t.withColumn(c, F.lit("u"))
    out = mixing.mix(t)
    assert out.where("_k = 'u' AND cut = 'u' AND n_tokens > 0 AND mix_key != 'u'").count() == out.count() > 0


def test_no_python_in_the_plan(docs):
    plan = mixing.mix(docs(corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
