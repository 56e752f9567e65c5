"""Fill-in-middle transformation: texts cut in three and put in another order, by code points.

Cuts are given in code points and made in UTF-8 bytes.  An index lists only the
characters of more than one byte: the code point at which each stands and the
bytes that it and those before it have in excess.  A binary search in it turns
code points into bytes and back; between its entries both count alike, so a
text in ASCII costs no entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.arrowblocks import parts, schema_of, strings, utf8
from wavepanel.llm.common import map_arrow

MARKERS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
PLAIN_PERCENT = 10  # of texts that stay as they are
SPM_PERCENT = 20  # of the others: suffix first


class ExceptionIndex:
    """Code points and bytes of UTF-8 data, by the characters of more than one byte alone."""

    def __init__(self, data: np.ndarray):
        leads = np.flatnonzero(data >= 0xC0)
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        first = data[leads]
        self._excess = np.zeros(len(leads) + 1, kind)  # bytes in excess of the characters before an entry
        np.cumsum(1 + (first >= 0xE0).astype(np.int8) + (first >= 0xF0), out=self._excess[1:], dtype=kind)
        self._points = (leads - self._excess[:-1]).astype(kind)

    def __len__(self) -> int:
        return len(self._points)

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        points = np.asarray(points, np.int64)
        return points + self._excess[np.searchsorted(self._points, points)]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte at which a character begins, or the data end."""
        at = np.asarray(at, np.int64)
        return at - self._excess[np.searchsorted(self._points + self._excess[:-1], at)]


def _numbers(seed: str, doc_id) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def _checked(markers: tuple[str, str, str]) -> None:
    """Markers must be told apart wherever they stand: none ends as another begins."""
    for a in markers:
        for b in markers:
            if not a or any(a.endswith(b[:k]) for k in range(1, len(b) + (a != b))):
                raise ValueError(f"markers {a!r} and {b!r} overlap")


def _replaced(docs: DataFrame, *added: str) -> DataFrame:
    return docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in added])


def fill_middle(
    docs: DataFrame, *, seed: str = "1", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """Add to each row its transformed text.

    Columns added: ``n`` (code points of ``text``), ``form`` (plain, psm, spm),
    ``prefix_chars`` and ``middle_chars`` (long; null if plain) and ``output``.
    Columns of ``docs`` with these names are replaced, others pass.  Cuts and
    form follow from SHA-256 of ``seed:doc_id`` and the text alone, so repeated
    rows get equal results, on any cluster.

    A null text counts as empty, an empty one is plain, and so is any text that
    holds a marker.  A null doc_id counts as an empty string.  A long text is
    one part of work: its bytes, a few times over, must fit in a task.  An
    empty table gives an empty table.
    """
    _checked(markers)
    rest = _replaced(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    id_at, text_at = rest.columns.index("doc_id"), rest.columns.index("text")
    p, s, m = (x.encode() for x in markers)

    def run(batches):
        for batch in batches:
            for part in parts(batch, text_at):
                data, starts = utf8(part.column(text_at))
                index = ExceptionIndex(data)
                points = index.to_points(starts)
                n = np.diff(points)
                drawn = [_numbers(seed, i) for i in part.column(id_at).to_pylist()]
                cuts = np.array([sorted((d[0] % (k + 1), d[1] % (k + 1))) for d, k in zip(drawn, n.tolist())], np.int64)
                at = index.to_bytes(points[:-1, None] + cuts).tolist()
                form, made = [], []
                for k, (d, (a, b)) in enumerate(zip(drawn, at)):
                    lo, hi = int(starts[k]), int(starts[k + 1])
                    text = data[lo:hi].tobytes()
                    if not text or d[2] % 100 >= 100 - plain_percent or p in text or s in text or m in text:
                        form.append("plain")
                        made.append(text)
                        continue
                    prefix, middle, suffix = text[: a - lo], text[a - lo : b - lo], text[b - lo :]
                    form.append("spm" if d[3] % 100 < spm_percent else "psm")
                    made.append(b"".join((s, suffix, p, prefix, m, middle) if form[-1] == "spm" else (p, prefix, s, suffix, m, middle)))
                plain = np.array([f == "plain" for f in form])
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(cuts[:, 0], pa.int64(), mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns, strings(made)], names=[*part.schema.names, "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_arrow(rest, run, schema_of(rest, "n long, form string, prefix_chars long, middle_chars long, output string"))


def restore(made: DataFrame, *, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Add ``restored``: the text from ``output`` and ``form`` alone; a column of that name is replaced.

    A null output or form gives null.  An output whose markers do not fit its form is refused.
    """
    out, (p, s, m) = F.col("output"), markers

    def between(first: str, then: str | None):
        """From behind a marker up to the next one, or the end."""
        lo = F.instr(out, first) + len(first)
        return F.substring(out, lo, F.length(out) if then is None else F.locate(then, out, 1) - lo)

    def fits(*order: str):
        places = [F.instr(out, x) for x in order]
        return (places[0] == 1) & (places[1] > places[0]) & (places[2] > places[1])

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    bad = F.raise_error(F.lit("the output's markers do not fit its form"))
    text = F.when(F.col("form") == "plain", out).when((F.col("form") == "psm") & fits(p, s, m), psm).when((F.col("form") == "spm") & fits(s, p, m), spm)
    return _replaced(made, "restored").withColumn("restored", text.otherwise(F.when(out.isNull() | F.col("form").isNull(), F.lit(None).cast("string")).otherwise(bad.cast("string"))))
