"""Column expressions for text, arrays and probabilities (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NA_MARKERS, TOKEN_RUN

# --- Fixed values: Python str.splitlines / str.isspace character sets ------
# Line boundaries of str.splitlines beyond \n, \r and \r\n.
EXTRA_LINE_BREAKS = r"[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
# All line boundaries of str.splitlines (\r\n first so it stays one break).
ALL_LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
# Characters for which str.isspace is true.
PY_WHITESPACE = (r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                 r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c) -> Column:
    """pandas-style NA markers (and the empty string) become null."""
    col = _c(c)
    return F.when(col.isin(*NA_MARKERS), F.lit(None).cast("string")).otherwise(col)


def is_blank(c) -> Column:
    """True when the string is empty or whitespace only (as str.isspace).

    A whole-string match that fails at the first non-space character.
    """
    return _c(c).rlike(r"\A" + PY_WHITESPACE + r"*\z")


def token_array(text) -> Column:
    """Maximal runs of letters/digits of the lower-cased text (no empty pieces:
    the same tokens as splitting on ``TOKEN_SPLIT`` and dropping empties)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_RUN), 0)


def softmax(scores) -> Column:
    """Row-wise softmax over an array of doubles (max-shifted)."""
    s = _c(scores)
    m = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - m))
    z = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / z)


def argmax(scores) -> Column:
    """0-based index of the largest value; the first one on ties."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")
