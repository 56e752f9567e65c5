"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton finds the longest token at each place of a pre-token.
Tokens are taken from the left; a token may follow another if the merges of the
two would never have merged across the boundary between them.  Where no token
may follow, the last one is given up for the next shorter.  A sequence whose
neighbours are all compatible is the one that the merges give, so no merge is
ever carried out.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from wavepanel.llm.common import map_arrow

END = "</w>"
_END = "\n"  # stands for the end of a word; the byte alphabet has no line feed
CACHE = 300_000  # pre-tokens, and pairs of tokens, that a worker remembers
PART = 1 << 20  # bytes of a column that are worked on together
DECODED_AT_ONCE = 1 << 18  # tokens
#: Code points on whose case, class or composition the libraries used here may differ: texts
#: with any of them are normalised and split by the tokenizer file's own rules.
_ODD_ONES = re.compile("[՘-῿⁪-⿿ꀀ-\U0010ffffΣ]")
#: The pattern that the tokenizer file splits by.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class BacktrackingBpe:
    """Encoder and decoder for a tokenizer file with byte-level, word-final BPE."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or data["decoder"] is not None:
            raise ValueError("a BPE file with word ends and no decoder is asked for")
        # the file's normaliser and splitter alone: no second vocabulary in memory
        self._own = Tokenizer.from_str(json.dumps(data | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self._split = regex.compile(_SPLIT)
        alphabet = byte_alphabet()
        self._shown = str.maketrans({chr(b): c for b, c in enumerate(alphabet)})
        special = {a["content"]: a["id"] for a in data["added_tokens"]}
        self._special = special
        self._special_at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        vocab = model["vocab"]
        form = {i: (t[: -len(END)] + _END if t.endswith(END) and t != END else t) for t, i in vocab.items()}
        by_form = {t: i for i, t in form.items()}
        self._length = {i: len(t) for i, t in form.items()}
        self._rank: dict[tuple[int, int], int] = {}  # pair -> rank of its merge
        self._made: dict[int, tuple[int, int, int]] = {}  # token -> its halves and the rank of the merge that makes it
        for rank, (x, y) in enumerate(model["merges"]):
            x, y, made = vocab[x], vocab[y], vocab[x + y]
            self._rank[x, y] = rank
            self._made.setdefault(made, (x, y, rank))
        self._joins: dict[int, bool] = {}  # by left << 32 | right
        # a token that its own merges don't give is never in an encoding
        usable = {i for i in form if i not in self._made}
        for i in sorted(self._made, key=lambda t: self._made[t][2]):
            x, y, rank = self._made[i]
            if x in usable and y in usable and self._apart(x, y, rank):
                usable.add(i)
        self._shorter = {}
        self._automaton = ahocorasick.Automaton()
        for i in usable:
            t = form[i]
            self._automaton.add_word(t, (i, len(t)))
            self._shorter[i] = next((by_form[t[:k]] for k in range(len(t) - 1, 0, -1) if by_form.get(t[:k]) in usable), -1)
        self._automaton.make_automaton()
        self._words = _Cache(self._encode_word)
        # decoding: all token strings in one buffer, and where each begins
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in special.items()}}
        texts = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self._offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self._buffer = np.frombuffer(b"".join(texts), np.uint8)

    def _spine(self, token: int, half: int) -> list[tuple[int, int]]:
        """(token, rank at which it is merged away) along the left or right edge, from the single character up."""
        up, limit = [], 1 << 40
        while token in self._made:
            up.append((token, limit))
            limit, token = self._made[token][2], self._made[token][half]
        return [(token, limit), *reversed(up)]

    def _apart(self, left: int, right: int, until: int = 1 << 40) -> bool:
        """Whether no merge of rank under ``until`` crosses the boundary between two adjacent tokens.

        Follows in time the two symbols that touch at the boundary.  A merge across
        it happens if its rank is less than that which merges the left symbol away,
        and no more than that of the right one: of equal merges the leftmost is first.
        """
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = a[i], b[j]
            rank = self._rank.get((x, y))
            if rank is not None and rank < x_goes and rank <= y_goes and rank < until:
                return False
            if i + 1 < len(a) and (j + 1 == len(b) or x_goes <= y_goes):
                i += 1
            elif j + 1 < len(b):
                j += 1
            else:
                return True

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self._joins.get(key)
        if found is None:
            if len(self._joins) >= CACHE:
                self._joins.clear()
            found = self._joins[key] = self._apart(left, right)
        return found

    def _encode_word(self, word: str) -> bytes:
        """Ids of a pre-token, as little-endian unsigned 32-bit integers."""
        shown = word.encode("utf-8").decode("latin-1").translate(self._shown) + _END
        n = len(shown)
        longest, size = [-1] * n, [0] * n
        for last, (token, length) in self._automaton.iter(shown):
            if length > size[last - length + 1]:
                longest[last - length + 1], size[last - length + 1] = token, length
        out, dead, at, token = [], bytearray(n + 1), 0, longest[0]
        while at < n:
            while token >= 0:
                then = at + self._length[token]
                if not dead[then] and (not out or self._compatible(out[-1], token)):
                    break
                token = self._shorter[token]
            if token >= 0:
                out.append(token)
                at = then
                token = longest[at] if at < n else -1
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= self._length[token]
                token = self._shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte")
        return np.array(out, "<u4").tobytes()

    def pre_tokens(self, text: str) -> list[str]:
        if _ODD_ONES.search(text):
            own = self._own.pre_tokenizer.pre_tokenize_str(self._own.normalizer.normalize_str(text))
            back = {c: b for b, c in enumerate(byte_alphabet())}
            return [bytes(back[c] for c in t).decode("utf-8") for t, _ in own]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self._split.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if self._special_at is None or "<|" not in text:
            return b"".join(map(self._words.__getitem__, self.pre_tokens(text)))
        parts = []
        for k, piece in enumerate(self._special_at.split(text)):
            if k % 2:
                parts.append(np.array([self._special[piece]], "<u4").tobytes())
            else:
                parts.extend(map(self._words.__getitem__, self.pre_tokens(piece)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The token strings with a space between, in UTF-8, gathered from the offset table."""
        ids = np.frombuffer(ids, "<u4")
        parts = []
        for lo in range(0, len(ids), DECODED_AT_ONCE):
            some = ids[lo : lo + DECODED_AT_ONCE].astype(np.int64)
            first, size = self._offsets[some], self._offsets[some + 1] - self._offsets[some]
            ends = np.cumsum(size)
            parts.append(self._buffer[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)].tobytes())
        return b"".join(parts)[:-1]


class _Cache(dict):
    def __init__(self, make):
        self._make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = self._make(key)
        return value


_loaded: dict[int, BacktrackingBpe] = {}


def _load(spec: str) -> BacktrackingBpe:
    """One encoder for each worker and file: it lives on between tasks."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = BacktrackingBpe(spec)
    return _loaded[key]


def _slices(batch: pa.RecordBatch, column: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in a column, so that results stay small too.

    After the last part Arrow's free memory goes back to the system: workers live on between tasks.
    """
    size = max(1, batch.column(column).nbytes // max(1, batch.num_rows))
    step = max(1, most // size)
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)
    pa.default_memory_pool().release_unused()


def _mapped(df: DataFrame, source: str, target: str, kind: str, arrow: pa.DataType, spec: str, method: str) -> DataFrame:
    """``df`` with ``target`` = ``method`` of ``source``; a column of that name is replaced."""
    rest = df.select(*[f"`{c}`" for c in df.columns if c.lower() != target])
    at = rest.columns.index(source)
    sent = df.sparkSession.sparkContext.broadcast(spec)  # one tokenizer file, whatever the data

    def run(batches):
        work = getattr(_load(sent.value), method)
        for batch in batches:
            for part in _slices(batch, at):
                made = [None if x is None else work(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary()).cast(arrow)], names=[*part.schema.names, target])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"{target} {kind}"])
    return map_arrow(rest, run, schema)


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit) of the whole ``text`` of every row.

    ``spec`` is the content of a tokenizer file.  As that library encodes without
    special tokens added; their strings in a text become their ids.  A null text
    has null ids, an empty one none.  Other columns pass unchanged, repeated
    rows too; a column ``ids`` is replaced.  An empty table stays empty.
    """
    return _mapped(docs, "text", "ids", "binary", pa.binary(), spec, "encode")


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """Add ``decoded`` (string) of the ``ids`` of every row; null ids give null. A column ``decoded`` is replaced."""
    return _mapped(encoded, "ids", "decoded", "string", pa.string(), spec, "decode")


def round_trip(docs: DataFrame, spec: str) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` in place of ``text``: ``encode`` and ``decode`` in one pass.

    One Python worker for each task in place of two.  A null text gives nulls, an
    empty one an empty list and string; other columns pass unchanged, repeated
    rows too; columns ``ids`` and ``decoded`` are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in ("ids", "decoded", "text")]
    sent = docs.sparkSession.sparkContext.broadcast(spec)  # one tokenizer file, whatever the data

    def run(batches):
        work = _load(sent.value)
        for batch in batches:
            for part in _slices(batch, 0):
                ids = [None if x is None else work.encode(x) for x in part.column(0).to_pylist()]
                decoded = pa.array([None if x is None else work.decode(x) for x in ids], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(ids, pa.binary()), decoded], names=[*part.schema.names[1:], "ids", "decoded"])

    rows = docs.select("text", *[f"`{c}`" for c in rest])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "ids binary, decoded string"])
    return map_arrow(rows, run, schema)
