"""Row clean-up at ingest: empty rows, typed sales columns, bad dates, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift import schema as S
from promolift.functions import clean as C

LINEAGE_COLUMNS = (S.SOURCE_FILE, S.ROW_ORDER)


def _input_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in LINEAGE_COLUMNS]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose input columns are all NULL (lineage columns do not count)."""
    return df.dropna(how="all", subset=_input_columns(df))


def empty_row_counts(df: DataFrame) -> DataFrame:
    """Rows read and rows kept by ``drop_empty_rows``, in one pass."""
    non_empty = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in _input_columns(df)])
    return df.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(non_empty).cast("long").alias("rows_kept"))


def dedup_rows(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Full-row distinct. With ``order_col``, keep the first copy (smallest order value).

    Both are aggregations with a map-side partial step, so a value copied
    into a third of all rows is merged before the shuffle.
    """
    if order_col is None or order_col not in df.columns:
        return df.dropDuplicates()
    keys = [c for c in df.columns if c != order_col]
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(order_col).alias(order_col))


def typed_sales(raw: DataFrame) -> DataFrame:
    """Status upper-cased (missing -> NAN), date parsed, sales and quantity numeric or 0."""
    types = {f.name: f.dataType for f in raw.schema.fields}
    return raw.withColumns({
        S.STATUS: C.norm_status(F.col(f"`{S.STATUS}`")),
        S.SALES_DATE: C.to_date_any(F.col(f"`{S.SALES_DATE}`"), types[S.SALES_DATE]),
        S.NET_SALES: C.num_or_zero(F.col(f"`{S.NET_SALES}`"), types[S.NET_SALES]),
        S.QUANTITY: C.num_or_zero(F.col(f"`{S.QUANTITY}`"), types[S.QUANTITY]),
    })


def clean_sales(raw: DataFrame) -> DataFrame:
    """Empty rows dropped, columns typed, rows without a valid date dropped, duplicates removed."""
    typed = typed_sales(drop_empty_rows(raw))
    return dedup_rows(typed.where(F.col(S.SALES_DATE).isNotNull()))


def date_quality(raw: DataFrame, date_col: str = S.SALES_DATE) -> DataFrame:
    """Rows, rows with a valid date and rows without one (one pass)."""
    types = {f.name: f.dataType for f in raw.schema.fields}
    parsed = C.to_date_any(F.col(f"`{date_col}`"), types[date_col])
    return raw.agg(F.count(F.lit(1)).alias("rows"),
                   F.count(parsed).alias("valid_dates"),
                   F.count_if(parsed.isNull()).cast("long").alias("invalid_dates"))


def bad_dates(raw: DataFrame, order_col: str, n: int = 3, date_col: str = S.SALES_DATE) -> DataFrame:
    """A few rows whose date does not parse, first by ``order_col`` (a top-k, not a sort)."""
    types = {f.name: f.dataType for f in raw.schema.fields}
    parsed = C.to_date_any(F.col(f"`{date_col}`"), types[date_col])
    return raw.where(parsed.isNull()).orderBy(order_col).limit(n)


def preview(df: DataFrame, order_col: str = S.ROW_ORDER, n: int = 100) -> DataFrame:
    """First ``n`` rows in load order."""
    return df.orderBy(order_col).limit(n)
