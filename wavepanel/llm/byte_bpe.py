"""Byte-level BPE from a file of ranks: merges on padded matrices, decoding by an offset table.

Pre-tokens that are no token themselves are put in matrices by their length, one
row each, padded to the next power of two.  In each round every row finds the
least rank among its pairs, by a hash table of pairs, and merges the leftmost
pair of that rank; rows and columns that are done are then squeezed out.  Where the
token that is made is in no pair of a lower rank (known for each token when the
file is read), the other pairs of that rank in the row, taken from the left, are
merged in the same round: one at a time would give the same, so a long row needs
few rounds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wavepanel.llm.arrowblocks import parts, schema_of
from wavepanel.llm.common import map_arrow

CACHE = 400_000  # pre-tokens that a worker remembers
AT_ONCE = 200_000  # pre-tokens of a text that are held together
CELLS = 1 << 20  # of a matrix
DECODED_AT_ONCE = 1 << 18  # tokens
PART = 1 << 20  # bytes of text that are worked on together
_NONE = np.int32(np.iinfo(np.int32).max)  # the rank of a pair that is no token
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of pairs of tokens: an open hash table with linear probing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):  # all keys in their next slot at once; of those that meet in a free slot one stays
            self.probes += 1
            free = todo[self._keys[at[todo]] == -1]
            self._keys[at[free]] = keys[free]
            done = self._keys[at[todo]] == keys[todo]
            self._ranks[at[todo[done]]] = rank[todo[done]]
            todo = todo[~done]
            at[todo] = (at[todo] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _ODD >> self._shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            held = self._keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self._ranks[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self._mask
        return out.reshape(left.shape)


class MatrixBpe:
    """Encoder and decoder for the ranks of a vocabulary of byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if set(ranks) < {bytes([b]) for b in range(256)}:
            raise ValueError("the vocabulary lacks a byte")
        self._ranks = ranks
        self._split = regex.compile(pattern)
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        halves = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(halves, np.int64).reshape(-1, 3)
        self._table = PairTable(pairs[:, 0], pairs[:, 1], pairs[:, 2].astype(np.int32))
        # tokens that are half of a pair of a lower rank: what they make may have to be merged before others of their kind
        self._lone = np.zeros(max(ranks.values()) + 1, bool)
        for half in (0, 1):
            self._lone[pairs[pairs[:, half] > pairs[:, 2], half]] = True
        self._words: dict[str, bytes] = {}
        tokens = sorted((r, t) for t, r in ranks.items())
        size = np.zeros(tokens[-1][0] + 1, np.int64)
        size[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
        self._offsets = np.concatenate([[0], np.cumsum(size)])
        self._buffer = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)

    # -- encoding -------------------------------------------------------------------------------

    def _first_only(self, rows: np.ndarray, sizes: np.ndarray, r: np.ndarray, c: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rows in which a merge of those at (r, c) makes a pair of a lower rank than its own."""
        after = np.where(c + 2 < sizes[r], rows[r, np.minimum(c + 2, rows.shape[1] - 1)], -1)
        lower = (after >= 0) & (self._table.ranks(rank, np.maximum(after, 0)) < rank)
        follows = np.zeros(len(r), bool)  # the pair before is merged too
        follows[1:] = (r[1:] == r[:-1]) & (c[1:] == c[:-1] + 2)
        before = np.where(follows, rank, rows[r, np.maximum(c - 1, 0)])
        lower |= (c > 0) & (self._table.ranks(before, rank) < rank)
        return r[lower]

    def _merge(self, rows: np.ndarray, sizes: np.ndarray, out: list, names: np.ndarray) -> None:
        """Carry out all merges of a padded matrix; the ids of each row go to its name in ``out``."""
        inside = np.arange(1, rows.shape[1])[None, :] < sizes[:, None]
        ranks = np.full(rows.shape, _NONE, np.int32)  # of each place and the next
        ranks[:, :-1][inside] = self._table.ranks(rows[:, :-1][inside], rows[:, 1:][inside])
        while True:
            least = ranks.min(axis=1)
            over = least == _NONE
            if over.any():
                for k in np.flatnonzero(over).tolist():
                    out[names[k]] = rows[k, : sizes[k]].astype("<u4").tobytes()
                live = ~over
                rows, sizes, names, ranks, least = rows[live], sizes[live], names[live], ranks[live], least[live]
                if not len(rows):
                    return
            r, c = np.nonzero(ranks == least[:, None])
            # of pairs that overlap every second one from the left
            first = np.ones(len(r), bool)
            first[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)
            nth = np.arange(len(r))
            taken = (nth - np.maximum.accumulate(np.where(first, nth, 0))) % 2 == 0
            r, c = r[taken], c[taken]
            lone = self._lone[least[r]]
            if lone.any():
                alone = np.zeros(len(rows), bool)
                alone[self._first_only(rows, sizes, r[lone], c[lone], least[r[lone]])] = True
                starts = np.ones(len(r), bool)
                starts[1:] = r[1:] != r[:-1]
                keep = starts | ~alone[r]
                r, c = r[keep], c[keep]
            rows[r, c] = least[r]
            column = np.arange(rows.shape[1])
            stays = column < sizes[:, None]
            stays[r, c + 1] = False
            merged = np.bincount(r, minlength=len(rows))
            sizes = sizes - merged
            squeezed = np.arange(int(sizes.max())) < sizes[:, None]
            was, rank_was = rows[stays], ranks[stays]
            rows, ranks = np.zeros(squeezed.shape, np.int32), np.full(squeezed.shape, _NONE, np.int32)
            rows[squeezed], ranks[squeezed] = was, rank_was
            # the merged places have moved left by the merges before them; their pairs and those before are new
            c = c - (np.arange(len(r)) - (np.cumsum(merged) - merged)[r])
            r, c = np.concatenate([r, r[c > 0]]), np.concatenate([c, c[c > 0] - 1])
            pair = c + 1 < sizes[r]
            ranks[r[~pair], c[~pair]] = _NONE
            r, c = r[pair], c[pair]
            ranks[r, c] = self._table.ranks(rows[r, c], rows[r, c + 1])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            own = self._ranks.get(w)
            if own is not None:
                out[k] = own.to_bytes(4, "little")
            elif not w:
                out[k] = b""
            else:
                by_width.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(k)
        for width, members in by_width.items():
            step = max(1, CELLS // width)
            for lo in range(0, len(members), step):
                some = members[lo : lo + step]
                sizes = np.array([len(words[k]) for k in some])
                rows = np.zeros((len(some), int(sizes.max())), np.int32)
                rows[np.arange(rows.shape[1]) < sizes[:, None]] = self._byte[np.frombuffer(b"".join(words[k] for k in some), np.uint8)]
                self._merge(rows, sizes, out, np.array(some))
        return out

    def _known(self, held: list[list[str]]) -> dict[str, bytes]:
        """The encodings of lists of pre-tokens; each distinct one that is not remembered is encoded once."""
        known, words = self._words, set().union(*held)
        new = words.difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = words
        if new:
            order = list(new)
            known.update(zip(order, self.encode_words([w.encode("utf-8", "surrogatepass") for w in order])))
        return known

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; their pre-tokens are looked up together, those of a long text some at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        count = 0

        def flush():
            known = self._known([ws for _, ws in held])
            for k, ws in held:
                out[k].append(b"".join(map(known.__getitem__, ws)))
            held.clear()

        for k, text in enumerate(texts):
            found = (m.group() for m in self._split.finditer(text)) if len(text) > AT_ONCE else iter(self._split.findall(text))
            while ws := list(islice(found, AT_ONCE)):
                held.append((k, ws))
                count += len(ws)
                if count >= AT_ONCE:
                    flush()
                    count = 0
        if held:
            flush()
        return [b"".join(x) for x in out]

    # -- decoding -------------------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, gathered from one buffer by the offset table."""
        ids = np.frombuffer(ids, "<u4")
        done = []
        for lo in range(0, len(ids), DECODED_AT_ONCE):
            some = ids[lo : lo + DECODED_AT_ONCE].astype(np.int64)
            first, size = self._offsets[some], self._offsets[some + 1] - self._offsets[some]
            ends = np.cumsum(size)
            done.append(self._buffer[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)].tobytes())
        return b"".join(done)


def read_ranks(path: str) -> str:
    """The content of a file of ranks: a byte string in base64 and its rank on each line."""
    with open(path, encoding="ascii") as f:
        return f.read()


def parse_ranks(content: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


_loaded: dict[int, MatrixBpe] = {}


def _load(content: str, pattern: str) -> MatrixBpe:
    """One encoder for each worker and file: it lives on between tasks."""
    key = hash((content, pattern))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = MatrixBpe(parse_ranks(content), pattern)
    return _loaded[key]


def _mapped(df: DataFrame, source: str, target: str, work, kind: pa.DataType, content: str, pattern: str) -> DataFrame:
    """``df`` with a binary column ``target``: ``work(encoder, values)`` of those of ``source`` that are not null."""
    rest = df.select(*[f"`{c}`" for c in df.columns if c.lower() != target])
    at = rest.columns.index(source)
    sent = df.sparkSession.sparkContext.broadcast((content, pattern))  # one file of ranks, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(*sent.value)
        for batch in batches:
            for part in parts(batch, at, PART):
                values = part.column(at).to_pylist()
                made = iter(work(bpe, [x for x in values if x is not None]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else next(made) for x in values], kind)], names=[*part.schema.names, target])

    return map_arrow(rest, run, schema_of(rest, f"{target} binary"))


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit) of the whole ``text`` of every row.

    ``ranks`` is the content of a file of ranks, ``pattern`` splits texts into
    pre-tokens, each of which is encoded alone.  No string stands for a special
    token.  A null text has null ids, an empty one none.  Other columns pass
    unchanged, repeated rows too; a column ``ids`` is replaced.  A long text goes
    through in pieces of AT_ONCE pre-tokens, so a task holds it and its ids only.
    An empty table stays empty.
    """
    return _mapped(docs, "text", "ids", lambda bpe, texts: bpe.encode_all(texts), pa.binary(), ranks, pattern)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Add ``decoded`` (binary) of the ``ids`` of every row; null ids give null. A column ``decoded`` is replaced."""
    return _mapped(encoded, "ids", "decoded", lambda bpe, many: [bpe.decode(x) for x in many], pa.binary(), ranks, pattern)
