"""Toxicity: a convolutional text classifier over hashed words, in numpy.

Words are hashed; those seen often enough in training have an embedding, all
others share a vector of zeros.  Filters of several widths run over the whole
text, the greatest response of each is kept, and a logistic layer scores them.
All labelled texts are learnt from, in rounds over shards of them whose
parameters are averaged.  Thresholds are calibrated by language, which is
guessed from the text itself; the score is shifted so that each language's
threshold lies at 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import forget, map_arrow, materialise
from wavepanel.llm.textblocks import WHITE, grouped, hash_words, words_by_text

NUMBERS = 1 << 18  # the hashes of words are cut to so many numbers, so that the model doesn't grow with the corpus
SHARD = 1 << 20  # words, about, that one task learns from in a round
PIECE = 1 << 16  # words of a text that are looked at together when learning
GRID = 256  # thresholds are settled on logits to 1 / GRID
FIXED = 1 << 24  # parameters are added up as whole numbers of 1 / FIXED
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
SEEN = 5  # training texts that a word must be in to have an embedding
ROUNDS, BATCH, RATE, DECAY = 8, 32, 0.02, 3e-4
PRIOR = 20.0  # texts of a language that weigh as much as the common threshold

SEPARATORS = WHITE.copy()
SEPARATORS[[b for b in range(0x21, 0x80) if not chr(b).isalnum()]] = True

#: Frequent words by which the language of a text is guessed.
LANGUAGE_WORDS = {
    "en": "the of and to in is that it for was with as on be by at this from are or an not",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "le la les de des et en un une du que qui dans pour sur par au avec est pas ne ce",
    "es": "el la los de y en que del las un una por con no se su para es al lo como más",
}
LANGUAGES = list(LANGUAGE_WORDS)


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    rows = [(int(h), k) for k, name in enumerate(LANGUAGES) for h in hash_words(LANGUAGE_WORDS[name].encode(), SEPARATORS)[0]]
    keys = np.array(sorted({h for h, _ in rows}), np.uint64)
    marks = np.zeros((len(keys) + 1, len(LANGUAGES)), np.int32)
    for h, k in rows:
        marks[np.searchsorted(keys, np.uint64(h)), k] = 1
    return keys, marks


_LANGUAGE_KEYS, _LANGUAGE_MARKS = _language_table()


def _lookup(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in sorted ``keys``; their number if it isn't there."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return np.where(keys[at] == hashes, at, len(keys))


def languages(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Guessed language of each text of a block; the first if no word tells."""
    marks = _LANGUAGE_MARKS[_lookup(_LANGUAGE_KEYS, hashes)]
    sums = np.vstack([np.zeros((1, len(LANGUAGES)), np.int64), np.cumsum(marks, axis=0)])
    return np.argmax(sums[at[1:]] - sums[at[:-1]], axis=1)


def numbers(hashes: np.ndarray) -> np.ndarray:
    return hashes % np.uint64(NUMBERS)


@dataclass
class Model:
    keys: np.ndarray  # numbers of the known words, sorted
    embeddings: np.ndarray  # one more row, of zeros, for all other words
    filters: list[np.ndarray]  # (width * DIM, FILTERS) of each width
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray  # on the logit, by language

    @cached_property
    def _places(self) -> np.ndarray:
        """The embedding's row of each number that a word may have."""
        out = np.full(NUMBERS, len(self.keys), np.int64)
        out[self.keys] = np.arange(len(self.keys))
        return out

    @cached_property
    def _responses(self) -> list[list[np.ndarray]]:
        """Of each width and place of the filters: each known word's responses."""
        return [[(self.embeddings @ f[k * DIM : (k + 1) * DIM]).astype(np.float32) for k in range(w)] for w, f in zip(WIDTHS, self.filters)]

    def logits(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the texts of a block, by the numbers of their words: ``at`` is where the words of each begin."""
        sizes = np.diff(at)
        pad = max(WIDTHS)  # unknown words after each text
        ids = np.full(len(words) + pad * len(sizes), len(self.keys), np.int64)
        starts = at[:-1] + pad * np.arange(len(sizes))
        ids[np.arange(len(words)) + pad * np.repeat(np.arange(len(sizes)), sizes)] = self._places[words]
        out = np.full(len(sizes), self.bias)
        for n, (width, b) in enumerate(zip(WIDTHS, self.biases)):
            total = np.zeros((len(ids), FILTERS), np.float32)
            for k in range(width):
                total[: len(ids) - k] += self._responses[n][k][ids[k:]]
            for k in range(1, width):  # places from which the filter would reach into the next text
                total[starts + sizes + pad - k] = -np.inf
            best = np.maximum.reduceat(total, starts, axis=0) + b
            out += np.maximum(best, 0) @ self.weights[n * FILTERS : (n + 1) * FILTERS]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        parts = [np.zeros(0)]
        for _, run in grouped(texts):
            hashes, at = words_by_text(run, SEPARATORS)
            z = self.logits(numbers(hashes), at) - self.thresholds[languages(hashes, at)]
            parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(parts)


def _pooled(embeddings: np.ndarray, filters: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each filter of each width: the greatest response to a text, and the place in ``own`` where it begins."""
    best, places = np.full((len(WIDTHS), FILTERS), -np.inf), np.zeros((len(WIDTHS), FILTERS), np.int64)
    for lo in range(0, len(own), PIECE):
        vectors = embeddings[own[lo : lo + PIECE + max(WIDTHS) - 1]]
        for i, (w, f) in enumerate(zip(WIDTHS, filters)):
            n = min(PIECE, len(vectors) - w + 1)
            if n <= 0:
                continue
            response = vectors[:n] @ f[:DIM]
            for k in range(1, w):
                response += vectors[k : k + n] @ f[k * DIM : (k + 1) * DIM]
            at = response.argmax(axis=0)
            top = response[at, np.arange(FILTERS)]
            more = top > best[i]
            best[i, more], places[i, more] = top[more], at[more] + lo
    return best, places


def start(known: int, seed: int) -> dict[str, np.ndarray]:
    """The parameters that learning begins with; the last row of the embeddings, of zeros, is for unknown words."""
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.1, (known + 1, DIM)).astype(np.float32), "u": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "c": np.zeros(1)}
    p["E"][-1] = 0
    for w in WIDTHS:
        p[f"F{w}"], p[f"b{w}"] = rng.normal(0, 0.5, (w * DIM, FILTERS)), np.zeros(FILTERS)
    return p


def learn(p: dict[str, np.ndarray], words: list[np.ndarray], y: np.ndarray, share: float, rng: np.random.Generator) -> None:
    """One round of Adam, in place, over all texts (the embeddings' rows of their words); ``share`` of all texts have label 1.

    Of the embeddings a step changes those that its texts push; those that no
    text of the round pushes decay to zeros.
    """
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    pushed = np.zeros(len(p["E"]), bool)
    pad = np.full(max(WIDTHS), len(p["E"]) - 1)
    order = rng.permutation(len(words))
    for step, lo in enumerate(range(0, len(order), BATCH), 1):
        filters, biases = [p[f"F{w}"].astype(np.float32) for w in WIDTHS], np.stack([p[f"b{w}"] for w in WIDTHS])
        g = {k: np.zeros_like(v) for k, v in p.items() if k != "E"}
        touched, pushes = [], []  # rows of embeddings and their gradients
        for d in order[lo : lo + BATCH]:
            own = np.concatenate([words[d], pad])
            best, places = _pooled(p["E"], filters, own)
            flat = (best + biases).ravel()
            a = np.maximum(flat, 0)
            z = a @ p["u"] + p["c"][0]
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]) * (0.5 / share if y[d] else 0.5 / (1 - share))
            g["u"] += dz * a
            g["c"] += dz
            back = dz * p["u"] * (flat > 0)
            for n, w in enumerate(WIDTHS):
                db = back[n * FILTERS : (n + 1) * FILTERS]
                g[f"b{w}"] += db
                for k in range(w):
                    at = own[places[n] + k]
                    g[f"F{w}"][k * DIM : (k + 1) * DIM] += p["E"][at].T * db
                    touched.append(at)
                    pushes.append(db[:, None] * p[f"F{w}"][k * DIM : (k + 1) * DIM].T)
        rows, to = np.unique(np.concatenate(touched), return_inverse=True)
        g["E"] = np.zeros((len(rows), DIM), np.float32)
        np.add.at(g["E"], to, np.concatenate(pushes))
        some = g["E"].any(axis=1) & (rows < len(pushed) - 1)
        rows, g["E"] = rows[some], g["E"][some]
        pushed[rows] = True
        for k in p:
            at = rows if k == "E" else slice(None)
            grad = g[k] / BATCH + (DECAY * p[k][at] if k != "c" else 0)
            m1[k][at] = 0.9 * m1[k][at] + 0.1 * grad
            m2[k][at] = 0.999 * m2[k][at] + 0.001 * grad * grad
            p[k][at] -= RATE * (m1[k][at] / (1 - 0.9**step)) / (np.sqrt(m2[k][at] / (1 - 0.999**step)) + 1e-8)
    p["E"][~pushed] = 0


def _sure(label: int) -> Model:
    """The model where nothing can be learnt: every score is 0 or 1, as all labels are."""
    none = [np.zeros((w * DIM, FILTERS)) for w in WIDTHS]
    rest = [np.zeros(FILTERS) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), 30.0 if label else -30.0, np.zeros(len(LANGUAGES))
    return Model(np.zeros(0, np.uint64), np.zeros((1, DIM)), none, *rest)


def _model(keys: np.ndarray, p: dict[str, np.ndarray]) -> Model:
    return Model(keys, p["E"], [p[f"F{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["u"], float(p["c"][0]), np.zeros(len(LANGUAGES)))


def train(texts: list[str], labels: list[int], calibrate: list[bool], seed: int = 7) -> Model:
    """Fit a model on texts in memory, but for those to ``calibrate`` by, which set the thresholds; ``fit`` does the same for tables.

    With no text, or texts of one class only, nothing can be learnt: every score
    is then 0 (all labels 0, or none) or 1.
    """
    y = np.array(labels, float)
    held = np.array(calibrate, bool)
    if len(set(labels)) < 2 or len(set(y[~held])) < 2:
        return _sure(len(labels) and y.min() == 1)
    hashes = [hash_words(t.encode("utf-8", "surrogatepass"), SEPARATORS)[0] for t in texts]
    words = [numbers(h) for h in hashes]
    found, counts = np.unique(np.concatenate([np.unique(w) for w, h in zip(words, held) if not h]), return_counts=True)
    keys = found[counts >= SEEN]
    p = start(len(keys), seed)
    for k in range(ROUNDS):
        learn(p, [_lookup(keys, w) for w, h in zip(words, held) if not h], y[~held], y[~held].mean(), np.random.default_rng([seed, k, 0]))
    model = _model(keys, p)
    at = np.cumsum([0] + [len(w) for w in words])
    language = languages(np.concatenate(hashes), at)
    cell = cells(model.logits(np.concatenate(words), at))
    model.thresholds = _thresholds(*(v[held] for v in (language, y, cell)), np.ones(held.sum(), np.int64))
    return model


def cells(z: np.ndarray) -> np.ndarray:
    """Logits, cut off at -30 and 30, on the grid that thresholds are settled on."""
    return np.floor((np.clip(z, -30, 30) + 30) * GRID).astype(np.int64)


def _thresholds(language: np.ndarray, y: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each language: the logit with the fewest errors of both kinds on the ``n`` texts of each cell held for it, drawn to the common one."""

    def best(use: np.ndarray) -> float:
        if not (use & (y == 1)).any() or not (use & (y == 0)).any():
            return 0.0
        bad, good = (np.bincount(cell[use & (y == v)], n[use & (y == v)], 60 * GRID + 1) for v in (1, 0))
        cuts = np.arange(cell[use].min(), cell[use].max() + 2)  # texts of lesser cells are scored under 0.5
        missed = np.concatenate([[0], np.cumsum(bad)])[cuts]
        wrong = good.sum() - np.concatenate([[0], np.cumsum(good)])[cuts]
        least = cuts[missed + wrong == (missed + wrong).min()]
        return float((least[0] + least[-1]) / 2 / GRID - 30)

    common = best(np.ones(len(y), bool))
    out = np.full(len(LANGUAGES), common)
    for k in range(len(LANGUAGES)):
        own = language == k
        if (own & (y == 1)).any() and (own & (y == 0)).any():
            total = n[own].sum()
            out[k] = (best(own) * total + common * PRIOR) / (total + PRIOR)
    return out


def fold(doc_id: Column) -> Column:
    """0 to 4: rows of fold 0 are held out, those of fold 1 calibrate, the others train."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """All labelled rows outside fold 0, whole: (doc_id, text, y, calibrate)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(label).cast("int").alias("y"))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(known, F.col("doc_id") == F.col("_doc"))
    one = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # a doc_id with several texts: the least
    return one.select("doc_id", "text", "y", (fold(F.col("doc_id")) == 1).alias("calibrate"))


def _words(batches):
    """(mixed, y, calibrate, language, n_words, words) of rows (mixed, y, calibrate, text)."""
    for batch in batches:
        for first, run in grouped(batch.column(3).to_pylist()):
            hashes, at = words_by_text(run, SEPARATORS)
            own = numbers(hashes).astype(np.uint32)
            sent = pa.array([own[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
            rest = pa.array(languages(hashes, at).astype(np.int32)), pa.array(np.diff(at).astype(np.int64)), sent
            yield pa.RecordBatch.from_arrays([*batch.slice(first, len(run)).columns[:3], *rest], names=["mixed", "y", "calibrate", "language", "n_words", "words"])


def _seen(batches):
    """(word, n): in how many of a task's texts each word is."""
    total = np.zeros(NUMBERS, np.int64)
    for batch in batches:
        for words in batch.column(0):
            total[np.unique(np.frombuffer(words.as_py(), np.uint32))] += 1
    word = np.flatnonzero(total)
    for lo in range(0, len(word), 1 << 16):
        some = word[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["word", "n"])


_DENSE = ["u", "c", *(f"{kind}{w}" for w in WIDTHS for kind in "Fb")]  # the parameters besides the embeddings
_SUMS = ["row int", *(f"v{k} long" for k in range(DIM))]


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    """The parameters besides the embeddings, in rows as long as an embedding."""
    flat = np.concatenate([p[k].ravel() for k in _DENSE])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def _unflat(rows: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in _DENSE])
    return {k: part.reshape(like[k].shape).copy() for k, part in zip(_DENSE, np.split(rows.ravel(), ends))}


def _round(sent, share: float, seed: int, turn: int):
    """A function for one round over one shard: its parameters times the number of texts that each counts for.

    An embedding counts for the texts with its word, all else for all texts;
    embeddings of zeros are left out.  Values are fixed-point numbers, whose
    sums don't depend on their order.
    """

    def run(shard):
        keys, p = sent.value
        rows = sorted(zip(*(shard.column(c).to_pylist() for c in ("mixed", "y", "words"))))
        words = [_lookup(keys, np.frombuffer(w, np.uint32)) for _, _, w in rows]
        known, counts = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
        known, counts = known[known < len(keys)], counts[known < len(keys)]
        own = {k: v.copy() for k, v in p.items() if k != "E"} | {"E": np.concatenate([p["E"][known], p["E"][-1:]])}
        rng = np.random.default_rng([seed, turn, shard.column("shard")[0].as_py()])
        learn(own, [_lookup(known, w) for w in words], np.array([y for _, y, _ in rows], float), share, rng)
        some, rest = np.flatnonzero(own["E"][:-1].any(axis=1)), _flat(own)
        row = np.concatenate([known[some], len(keys) + np.arange(len(rest))])
        weight = np.concatenate([counts[some], np.full(len(rest), len(rows))])
        fixed = np.rint(np.concatenate([own["E"][some], rest]) * weight[:, None] * FIXED).astype(np.int64)
        return pa.table([pa.array(row.astype(np.int32)), *map(pa.array, fixed.T)], names=[c.split()[0] for c in _SUMS])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 7, size: int = SHARD) -> Model:
    """Train on all labelled rows outside fold 0, whole, in rounds of Spark jobs.

    The texts are dealt by their ids into shards of about ``size`` words.  In
    each round every shard goes on alone from the common parameters, which then
    are the mean of the shards': of an embedding weighted by the texts that have
    its word, else by all texts.  So what a task holds is bounded by a shard,
    what the driver holds by ``NUMBERS``, and the result depends on neither the
    cluster nor the order of rows.
    """
    mixed = F.xxhash64(F.col("doc_id").cast("string")).alias("mixed")
    rows = training_rows(docs, labels, label).select(mixed, "y", "calibrate", "text")
    rows = materialise(map_arrow(rows, _words, "mixed long, y int, calibrate boolean, language int, n_words long, words binary"), "toxic-words")
    classes = {(r["calibrate"], r["y"]): r for r in rows.groupBy("calibrate", "y").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).collect()}
    ours = {y: r for (calibrate, y), r in classes.items() if not calibrate}
    if len(ours) < 2:
        forget(rows)
        return _sure(len(classes) > 0 and min(y for _, y in classes) == 1)
    texts = rows.where(~F.col("calibrate")).select("mixed", "y", "words")
    seen = map_arrow(texts.select("words"), _seen, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    keys, counts = (c.to_numpy() for c in seen.toArrow().sort_by("word").columns)  # NUMBERS at most
    keys = keys.astype(np.uint64)
    p = start(len(keys), seed)
    total = sum(r["n"] for r in ours.values())
    share = sum(y * r["n"] for y, r in ours.items()) / total
    weight = np.concatenate([counts, np.full(len(_flat(p)), total)])
    shards = max(1, -(-sum(r["words"] for r in ours.values()) // size))
    dealt = texts.withColumn("shard", F.pmod("mixed", F.lit(shards))).repartition("shard").persist(StorageLevel.DISK_ONLY)
    for turn in range(ROUNDS):
        sent = docs.sparkSession.sparkContext.broadcast((keys, p))
        shares = dealt.groupBy("shard").applyInArrow(_round(sent, share, seed, turn), ", ".join(_SUMS))
        row, *values = (c.to_numpy() for c in shares.groupBy("row").agg(*(F.sum(c.split()[0]) for c in _SUMS[1:])).toArrow().columns)
        mean = np.zeros((len(weight), DIM))
        mean[row] = np.stack(values, 1) / FIXED / weight[row, None]
        p = {"E": np.concatenate([mean[: len(keys)], p["E"][-1:]]).astype(np.float32), **_unflat(mean[len(keys) :], p)}
        sent.destroy()
    dealt.unpersist()
    model = _model(keys, p)
    if any(calibrate for calibrate, _ in classes):
        model.thresholds = _calibrated(rows.where("calibrate"), model)
    forget(rows)
    return model


def _calibrated(rows: DataFrame, model: Model) -> np.ndarray:
    """Thresholds by all ``rows``, counted by language, label and cell."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                words = [np.frombuffer(w.as_py(), np.uint32) for w in part.column(2)]
                z = sent.value.logits(np.concatenate(words), np.cumsum([0] + [len(w) for w in words]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells(z))], names=["language", "y", "cell"])

    found = map_arrow(rows.select("language", "y", "words"), run, "language int, y int, cell long").groupBy("language", "y", "cell").count().toArrow()
    return _thresholds(*(c.to_numpy() for c in found.columns))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of the whole ``text`` of every row.

    Nothing but the text counts.  A null text is scored as an empty one.  Other
    columns pass unchanged, repeated rows too; columns of those two names are
    replaced.  An empty table stays empty.
    """
    rest = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("score", "predicted")])
    at = rest.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by NUMBERS

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = sent.value.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"]
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), "score double, predicted int"])
    return map_arrow(rest, run, schema)
