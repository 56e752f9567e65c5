"""Token counts under a unigram model, by dynamic programming over a trie.

Distinct pre-tokens are inserted in a trie of characters.  A node's forward score
is that of the best split of its prefix into pieces; it is computed once, however
many pre-tokens share the prefix.  The end of a pre-token stores its count.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from wavepanel.llm.common import map_arrow

MARK = "▁"  # begins a pre-token
NODES = 700_000  # of a worker's trie; beyond, it starts anew
WORDS = 300_000  # whose counts a worker looks up without a walk through the trie
OTHER = -10.0  # added to the least score for each byte of a character that no piece holds


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities by rank: the piece of rank r has a share of 1/r."""
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in reversed(list(enumerate(pieces, 1)))}


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model in its order, without control, byte and unused ones and runs of white space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p for p in map(model.id_to_piece, kept) if p == MARK or p.strip(MARK)]  # words hold no runs of white space


class TrieCounter:
    """Numbers of tokens of pre-tokens; of equal scores, the split with fewer tokens counts.

    Nodes are numbers: ``edges`` has the child of (node, character); ``best`` the
    forward score of a node's prefix and its negated number of tokens; ``ends``
    the tokens of the pre-tokens that end at a node.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        lengths: dict[str, set[int]] = {}  # of the pieces that end with a character
        for p in scores:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}
        self.longest = max(map(len, scores), default=0)
        self.least = min(scores.values(), default=0.0)
        self.known = {p for p in scores if len(p) == 1}
        self.computed = 0  # forward scores
        self._clear()

    def _clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.score: list[float] = [0.0]
        self.tokens: list[int] = [0]
        self.ends: dict[int, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a pre-token."""
        if len(self.score) > NODES:
            self._clear()
        if len(word) > NODES:  # must not fill the trie
            return self._unkept(word)
        edges, node, path = self.edges, 0, [0]
        for j, c in enumerate(word, 1):
            edge = node << 21 | ord(c)
            node = edges.get(edge, -1)
            if node < 0:
                node = edges[edge] = len(self.score)
                score, tokens = self._forward(word, j, path, self.score, self.tokens)
                self.score.append(score)
                self.tokens.append(tokens)
            path.append(node)
        return self.ends.setdefault(node, self.tokens[node])

    def _forward(self, word: str, j: int, path, score: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of the best split of ``word[:j]``; ``path`` has the places of those of its prefixes."""
        self.computed += 1
        scores, last = self.scores, word[j - 1]
        most, fewest = -math.inf, 0
        for n in self.lengths.get(last, ()):
            if n > j:
                break
            s = scores.get(word[j - n : j])
            if s is not None:
                at = path[j - n]
                s += score[at]
                if s > most or s == most and tokens[at] + 1 < fewest:
                    most, fewest = s, tokens[at] + 1
        if last not in self.known:  # its bytes, one by one
            size, at = len(last.encode("utf-8", "surrogatepass")), path[j - 1]
            s = score[at] + size * (self.least + OTHER)
            if s > most or s == most and tokens[at] + size < fewest:
                most, fewest = s, tokens[at] + size
        return most, fewest

    def _unkept(self, word: str) -> int:
        """The same without nodes, for a very long word: the last scores only are held."""
        score, tokens, keep = [0.0], [0], max(1, self.longest)
        for j in range(1, len(word) + 1):
            part = word[max(0, j - keep) : j]
            score, tokens = score[-len(part) :], tokens[-len(part) :]
            s, n = self._forward(part, len(part), range(len(part)), score, tokens)
            score.append(s)
            tokens.append(n)
        return tokens[-1]


class _Counts(dict):
    """Counts of the latest words, by their bytes."""

    def __init__(self, counter: TrieCounter):
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        n = self[word] = self.counter.count(MARK + word.decode("utf-8", "surrogatepass"))
        return n


_counters: dict[int, _Counts] = {}


def token_counts(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """Add ``n_pre_tokens`` and ``n_tokens`` (long) of the whole ``text`` of every row.

    Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+``, each with a mark before it.
    ``scores`` has the log-probability of each piece.  Null and empty texts have
    no tokens.  Other columns pass unchanged, repeated rows too; columns of those
    two names are replaced.  An empty table stays empty.

    Each worker counts its own rows with one trie of bounded size: no shuffle,
    and nothing that grows with the table.
    """
    rest = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("n_pre_tokens", "n_tokens")])
    at = rest.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(scores)  # one vocabulary

    def run(batches):
        key = hash(frozenset(sent.value.items()))
        if key not in _counters:
            _counters.clear()
            _counters[key] = _Counts(TrieCounter(sent.value))
        count = _counters[key].__getitem__
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(at).to_pylist():
                own = (text or "").encode("utf-8", "surrogatepass").split()  # at white space in ASCII only
                words.append(len(own))
                tokens.append(sum(map(count, own)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*batch.schema.names, "n_pre_tokens", "n_tokens"]
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), "n_pre_tokens long, n_tokens long"])
    return map_arrow(rest, run, schema)
