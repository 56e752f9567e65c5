"""The classifier on a made-up language, and on the labelled rows of a test table."""

import random
import zlib

import numpy as np
import pytest

from wavepanel.llm import toxicity as T


def made(n, rng):
    words = {"en": "the of and to".split(), "de": "der die und das".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        text = [rng.choice(words[lang]) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 200))]
        y = rng.random() < 0.3
        if y:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice({"en": ["BADWORD,", "awful"], "de": ["schlimm", "übel!"]}[lang]))
        rows.append((i, " ".join(text), int(y)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = made(600, random.Random(2))
    return T.train([r[1] for r in rows], [r[2] for r in rows], [i % 5 == 1 for i in range(600)])


def test_learns_planted_words(model):
    rows = made(300, random.Random(3))
    score = model.scores([r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    assert ((score >= 0.5) == y).mean() > 0.97


def test_whole_text_counts_and_texts_do_not_mix(model):
    rng = random.Random(4)
    plain = " ".join(f"w{rng.randrange(3000)}" for _ in range(300_000))
    texts = [plain, plain + " badword awful badword", "", None, "x", "badword"]
    together = model.scores(texts)
    assert together[1] > 0.5 > together[0]
    alone = np.array([model.scores([t])[0] for t in texts])
    assert np.allclose(together, alone) and ((together >= 0) & (together <= 1)).all()


def test_language_is_guessed_from_the_text():
    from wavepanel.llm.textblocks import words_by_text

    run = ["the cat and the dog", "der Hund und die Katze", "le chat et les chiens", "el gato y los perros", ""]
    assert T.languages(*words_by_text([x.encode() for x in run], T.SEPARATORS)).tolist() == [0, 1, 2, 3, 0]


def test_nothing_to_learn():
    assert T.train([], [], []).scores(["a", None]).max() < 0.5
    assert T.train(["a"], [1], [False]).scores(["a"])[0] > 0.5
    assert T.train(["a", "b"], [0, 0], [False, True]).scores(["a"])[0] < 0.5


def test_tables_held_out_rows_and_edges(spark, docs):
    rows = [(r[0], r[1]) for r in made(400, random.Random(5))] + [(900, None), (901, ""), (901, ""), (None, "badword")]
    truth = [(i, y) for i, _, y in made(400, random.Random(5))] + [(900, 0), (None, 1), (5, None), (7, 0), (7, 1)]
    labels = spark.createDataFrame(truth, "doc_id long, toxic int")
    sample = T.training_rows(docs(rows), labels).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in sample) and len({r["doc_id"] for r in sample}) == len(sample)
    # labels, languages and sources of the scored rows change nothing
    fitted = T.fit(docs(rows), labels)
    flipped = labels.selectExpr("doc_id", "IF(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    again = T.fit(docs(rows).selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source", "n_chars"), flipped)
    a, b = ({(r["doc_id"], r["text"]): r["score"] for r in T.score(docs(rows), m).collect()} for m in (fitted, again))
    assert a == b and len(T.score(docs(rows), fitted).collect()) == len(rows)
    assert T.score(docs([]), fitted).count() == 0


def test_held_out_accuracy(spark):
    from wavepanel.llm.queries import op7_toxicity

    sf = "/root/testdata/sf0.01"
    got = op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.85


def test_every_labelled_row_is_learnt_from(spark, docs):
    from pyspark.sql import functions as F

    rows = docs([(1, "long " * 5000 + "badword")]).unionByName(spark.range(2, 9000).selectExpr("id AS doc_id", "concat('w', id) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars"))
    labels = spark.range(1, 9000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    got = T.training_rows(rows, labels).select("doc_id", F.length("text").alias("n"), "y").collect()
    want = [i for i in range(1, 9000) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r["doc_id"] for r in got) == want and all(r["y"] == r["doc_id"] % 2 for r in got)
    assert {r["n"] for r in got if r["doc_id"] == 1} == {25_007}


def test_rounds_over_shards(docs, spark):
    rows = [(r[0], r[1]) for r in made(1500, random.Random(6))]
    labels = spark.createDataFrame([(i, y) for i, _, y in made(1500, random.Random(6))], "doc_id long, toxic int")
    one, other = (T.fit(t, labels, size=30_000) for t in (docs(rows), docs(rows[::-1]).repartition(7)))
    assert all(np.array_equal(a, b) for a, b in zip((one.keys, one.embeddings, one.thresholds), (other.keys, other.embeddings, other.thresholds)))
    fresh = made(300, random.Random(8))
    assert ((one.scores([r[1] for r in fresh]) >= 0.5) == [r[2] for r in fresh]).mean() > 0.95


def test_long_texts_are_learnt_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    p = T.start(50, 1)
    filters = [p[f"F{w}"] for w in T.WIDTHS]
    own = rng.integers(0, 51, 500)
    best, places = T._pooled(p["E"], filters, own)
    for i, (w, f) in enumerate(zip(T.WIDTHS, filters)):  # against each place on its own
        plain = np.array([p["E"][own[j : j + w]].ravel() @ f for j in range(len(own) - w + 1)])
        assert np.allclose(best[i], plain.max(axis=0)) and np.allclose(plain[places[i], np.arange(T.FILTERS)], best[i])
    monkeypatch.setattr(T, "PIECE", 7)
    again, at = T._pooled(p["E"], filters, own)
    assert np.allclose(again, best) and (at == places).all()
