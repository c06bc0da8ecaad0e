"""Cleaning rules as Column expressions (JVM side, inside whole-stage codegen).

Spark 4 runs in ANSI mode, so every cast, parse and division here is a
``try_`` form or guarded: a bad value gives NULL, never a failed task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolift.schema import MISSING_ARTICLE, MISSING_STATUS

# The texts pandas' CSV reader treats as missing by default
# (pandas.read_csv ``na_values`` documentation).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Accepted date layouts, tried in this order; the first that
# fits wins (so 01/10/2025 is 1 October and 10/25/2025 is 25 October). Each
# has a shape guard: one or two digit day and month, four digit year.
DATE_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]
# Our listed tail instead of open-ended guessing: ISO date-time with ``T``
# (date part taken) and compact ``yyyyMMdd``.
ISO_T = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
COMPACT = r"^\d{8}$"

# Spark's double cast also takes Java suffixes (1.0d, 2f); pandas does not.
_JAVA_SUFFIX = r"[0-9.][dDfF]\s*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# What ``\s`` matches, and the line ends before which ``$`` matches too.
_OUTER = " \t\n\x0b\f\r\x85\u2028\u2029"


def strip(c: str | Column) -> Column:
    """Trim all leading and trailing white space (not only blanks).

    The pattern is searched for only where a text begins or ends with a sign it can begin or end at.
    """
    c = _col(c)
    return F.when(F.btrim(c, F.lit(_OUTER)) == c, c).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def null_if_na(c: str | Column, tokens: list[str] | None = None) -> Column:
    """NULL for a missing-value token, the text otherwise."""
    c = _col(c)
    toks = NA_TOKENS if tokens is None else tokens
    if not toks:
        return c
    return F.when(~c.isin(*toks), c)


def parse_date(c: str | Column) -> Column:
    """Text to DATE: strip, cut at the first blank, first listed layout that fits."""
    s = F.substring_index(strip(_col(c).cast("string")), " ", 1)
    tries = [F.when(s.rlike(rx), F.try_to_date(s, fmt)) for rx, fmt in DATE_FORMATS]
    tries.append(F.when(s.rlike(ISO_T), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")))
    tries.append(F.when(s.rlike(COMPACT), F.try_to_date(s, "yyyyMMdd")))
    return F.coalesce(*tries)


def to_date_any(c: str | Column, dtype: T.DataType) -> Column:
    """DATE from a column of any type: dates kept, timestamps truncated, text parsed."""
    c = _col(c)
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return parse_date(c)


def norm_status(c: str | Column) -> Column:
    """Upper-case status; a missing one becomes ``NAN`` (and so counts as promo)."""
    return F.coalesce(F.upper(_col(c).cast("string")), F.lit(MISSING_STATUS))


def num_or_null(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Number or NULL: bad text, NaN and Java-suffixed text give NULL."""
    c = _col(c)
    null = F.lit(None).cast("double")
    if dtype is not None and isinstance(dtype, T.NumericType):
        return F.nanvl(c.cast("double"), null)
    text = c.cast("string")
    return F.when(~text.rlike(_JAVA_SUFFIX), F.nanvl(text.try_cast("double"), null))


def num_or_zero(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Number, or 0 for anything that is not one."""
    return F.coalesce(num_or_null(c, dtype), F.lit(0.0))


def article_text(c: str | Column) -> Column:
    """Article id as text, white space trimmed; a missing one becomes the text ``nan`` and stays in the analysis."""
    return F.coalesce(strip(_col(c).cast("string")), F.lit(MISSING_ARTICLE))


# Sums that do not depend on the order of rows: the whole numbers of the values, and 2^30ths of
# their fractions, are summed as longs; what is left below 2^-30 (``rest``, in 2^30ths) as doubles,
# exactly for values of 1 and more. A sum with a value that can't be cut so (NaN, infinite, 2^52 and
# more), or beyond 2^60, is the plain sum of doubles. So no addend is rounded, nothing overflows.
_FRACTIONS = float(1 << 30)
_CUTTABLE, _LARGE = float(1 << 52), float(1 << 60)
SUM_PARTS = ("whole", "part", "rest", "plain", "most")


def _cut(c: Column) -> dict[str, Column]:
    """Aggregates of the parts of a sum. The value stands once in each, so plans stay small."""
    x = c.cast("double")
    return {"whole": F.try_sum(x.try_cast("long")), "part": F.sum(((x % 1.0) * _FRACTIONS).try_cast("long")),
            "rest": F.sum((x * _FRACTIONS) % 1.0), "plain": F.sum(x), "most": F.max(F.abs(x))}


def _merge(parts: dict[str, Column]) -> dict[str, Column]:
    return {k: F.max(v) if k == "most" else F.try_sum(v) if k == "whole" else F.sum(v) for k, v in parts.items()}


def sum_parts(c: str | Column, name: str) -> list[Column]:
    """Aggregates for the parts of a sum, as columns ``name__part``: they can be saved, and merged later."""
    return [v.alias(f"{name}__{k}") for k, v in _cut(_col(c)).items()]


def _parts_of(name: str, where: Column | None = None) -> dict[str, Column]:
    return {k: F.col(p) if where is None else F.when(where, F.col(p)) for k, p in _part_names(name).items()}


def _part_names(name: str) -> dict[str, str]:
    return {k: f"{name}__{k}" for k in SUM_PARTS}


def merged_parts(name: str, where: Column | None = None, to: str | None = None) -> list[Column]:
    """Aggregates that merge the parts of sums (of the rows that meet ``where``), under the name ``to``."""
    out = _part_names(to or name)
    return [v.alias(out[k]) for k, v in _merge(_parts_of(name, where)).items()]


def _total(parts: dict[str, Column]) -> Column:
    """The sum as a double; NULL without a value."""
    exact = parts["whole"].cast("double") + (parts["part"].cast("double") + parts["rest"]) / _FRACTIONS
    return F.when((parts["most"] < _CUTTABLE) & (F.abs(parts["plain"]) < _LARGE), exact).otherwise(parts["plain"])


def merged_sum(name: str, where: Column | None = None) -> Column:
    """Sum from the parts of sums, as an aggregate: the same as ``exact_sum`` over all rows."""
    return _total(_merge(_parts_of(name, where)))


def sum_of(name: str) -> Column:
    """Sum of one row's parts."""
    return _total(_parts_of(name))


def exact_sum(c: str | Column) -> Column:
    """Sum without rounding or overflow, the same whatever the order of the rows."""
    return _total(_cut(_col(c)))


def exact_avg(c: str | Column) -> Column:
    """``exact_sum`` over the number of values; NULL without a value."""
    return F.try_divide(exact_sum(c), F.count(_col(c)))


def uplift(sales: Column, baseline: Column) -> Column:
    """(sales - baseline) / baseline."""
    return F.try_divide(sales - baseline, baseline)


def forecast_accuracy(qty: Column, forecast: Column) -> Column:
    """(actual - forecast) / forecast, only when the forecast is above 0."""
    return F.when(forecast > 0, (qty - forecast) / forecast)
