"""Column-level helpers (all built from Spark SQL expressions, no UDFs).

Each helper returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------
# decoding and banding
# --------------------------------------------------------------------------
def decode(col: str | Column, mapping: Mapping[str, str] | Sequence[tuple[str, str]], default: str | None) -> Column:
    """Simple CASE: exact-match lookup, everything else (NULL included) -> default."""
    items = mapping.items() if isinstance(mapping, Mapping) else mapping
    c = _c(col)
    expr = None
    for k, v in items:
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def band(col: str | Column, cuts: Sequence[tuple[float, str]], else_label: str, null_label: str | None = "unknown") -> Column:
    """Searched CASE with half-open upper-exclusive cuts.

    ``cuts`` is ``[(upper, label), ...]`` in ascending order; a value below
    ``upper`` gets ``label``; values at or above the last cut get
    ``else_label``; NULL gets ``null_label``.
    """
    c = _c(col)
    expr = F.when(c.isNull(), F.lit(null_label))
    for upper, label in cuts:
        expr = expr.when(c < F.lit(upper), F.lit(label))
    return expr.otherwise(F.lit(else_label))


def bucket(col: str | Column, groups: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Grouped CASE: ``[(codes, label), ...]`` -> first group whose codes contain the value."""
    c = _c(col)
    expr = None
    for codes, label in groups:
        cond = c.isin(list(codes))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def default_label(col: str | Column, label: str = "unknown") -> Column:
    return F.coalesce(_c(col), F.lit(label))


# --------------------------------------------------------------------------
# dates (F1-F6)
# --------------------------------------------------------------------------
def try_date(col: str | Column, fmt: str = "M/d/yyyy") -> Column:
    """Tolerant date parse: masked ('*'), blank or impossible dates -> NULL.

    Surrounding blanks are trimmed first.  Two-digit years do not match the
    four-digit pattern and come out NULL.
    """
    return F.try_to_date(F.trim(_c(col)), fmt)


def year_diff(start: str | Column, end: str | Column) -> Column:
    """Calendar-year difference (number of year boundaries crossed)."""
    return (F.year(_c(end)) - F.year(_c(start))).cast("int")


def exact_years(start: str | Column, end: str | Column) -> Column:
    """Completed years between two dates (birthday-exact)."""
    return F.floor(F.months_between(_c(end), _c(start)) / F.lit(12)).cast("int")


def month_key(col: str | Column) -> Column:
    """'yyyy-MM' key of a date."""
    return F.date_format(_c(col), "yyyy-MM")


def month_start(ym: str | Column) -> Column:
    """Date of the first day of a 'yyyy-MM' key."""
    return F.concat(_c(ym), F.lit("-01")).cast("date")


# --------------------------------------------------------------------------
# null handling and comparisons
# --------------------------------------------------------------------------
def changed_when_present(a: str | Column, b: str | Column) -> Column:
    """a IS DISTINCT FROM b, both present -> never NULL."""
    a, b = _c(a), _c(b)
    return (~a.eqNullSafe(b)) & a.isNotNull() & b.isNotNull()


def last_known(cols_newest_first: Iterable[str | Column]) -> Column:
    """Newest non-null of a list of per-period values."""
    return F.coalesce(*[_c(c) for c in cols_newest_first])


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / NULLIF(den, 0): NULL instead of an error or infinity."""
    return F.try_divide(_c(num), F.nullif(_c(den), F.lit(0)))


def ratio_minus_one(num: str | Column, den: str | Column) -> Column:
    """Growth: num / NULLIF(den, 0) - 1."""
    return safe_div(num, den) - F.lit(1)


def pct(num: str | Column, den: str | Column) -> Column:
    """100.0 * num / NULLIF(den, 0) as double."""
    return safe_div(F.lit(100.0) * _c(num).cast("double"), _c(den))


def flag_int(col: str | Column) -> Column:
    return _c(col).cast("int")


def zip5(col: str | Column) -> Column:
    """Left-pad an area code to 5 characters (truncates longer ones)."""
    return F.lpad(_c(col).cast("string"), 5, "0")


def money(col: str | Column, scale: int = 2) -> Column:
    """Exact money for sums: cast to decimal so sums do not depend on order."""
    return _c(col).cast(f"decimal(18,{scale})")


def exact_mean(col: str | Column) -> Column:
    """Mean of a money column with an exact (decimal) sum, returned as double."""
    return F.sum(money(col)).cast("double") / F.count(F.lit(1))
