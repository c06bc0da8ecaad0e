"""Saved partial aggregates: baselines and promotion facts without the rows they came from.

Sales rows are summed to *cells*, one for each article, promotion, region, sub
category, PSA, date and side of the promo test. Cells hold the parts of the sums
(``clean.sum_parts``), so sums of cells are the sums of their rows, to the last digit,
and every filter of the summary is a filter on cells. Each batch of sales is summed once,
when it comes; its cells are saved in a folder of its own (a batch that comes again
replaces itself), and readers merge the cells of all batches. An append so reads its own
rows alone, and a report reads cells alone.

Batches must not share rows: append what ``store.new_rows_only`` leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift import schema as S
from promolift.functions import clean as C
from promolift.operators import promo as P

PROMO, ROWS, SALES, QTY = "promo", "rows", "sales", "qty"


def cells(prepared: DataFrame) -> DataFrame:
    """One row per article, promotion, region, sub category, PSA, date and side of the promo test."""
    keys = [c for c in (S.ARTICLE, S.BONUS_BUY, S.REGION, S.SUBCAT, S.PSA, S.SALES_DATE) if c in prepared.columns]
    forecast = [F.bool_or(S.HAS_FORECAST).alias(S.HAS_FORECAST), F.max(S.FORECAST_QTY).alias(S.FORECAST_QTY),
                F.max(S.FORECAST_DAILY).alias(S.FORECAST_DAILY)] if S.HAS_FORECAST in prepared.columns else []
    # Ranges of the keys: rows travel as they are, not as the many parts of sums of cells that hold one row or two, and
    # the cells of an article end up together. Equal keys alone can't be cut, and those make one cell.
    needed = [c for c in (S.STATUS, S.NET_SALES, S.QUANTITY, S.HAS_FORECAST, S.FORECAST_QTY, S.FORECAST_DAILY) if c in prepared.columns]
    order = [c for c in (S.ARTICLE, S.SALES_DATE, S.BONUS_BUY, S.REGION, S.SUBCAT, S.PSA) if c in keys]
    return (prepared.select(*keys, *needed).repartitionByRange(*order).groupBy(*keys, S.is_promo().alias(PROMO))
            .agg(F.count(F.lit(1)).alias(ROWS), *C.sum_parts(S.NET_SALES, SALES), *C.sum_parts(S.QUANTITY, QTY), *forecast))


def append_cells(prepared: DataFrame, base: str, batch: str) -> None:
    """Sum a batch of prepared sales and save its cells; the same batch again replaces itself."""
    cells(prepared).write.mode("overwrite").parquet(f"{base}/batch={batch}")


def read_cells(spark: SparkSession, base: str) -> DataFrame:
    """The cells of all batches, with the filter columns Year and Month."""
    found = spark.read.option("mergeSchema", True).parquet(base).drop("batch")
    return found.withColumns({S.YEAR: F.year(S.SALES_DATE), S.MONTH: F.month(S.SALES_DATE)})


def article_days(found: DataFrame) -> DataFrame:
    """``baseline.article_days`` from cells."""
    plain = ~F.col(PROMO)
    return (found.where(F.col(S.ARTICLE).isNotNull()).groupBy(S.ARTICLE, S.SALES_DATE)
            .agg(F.bool_or(PROMO).alias("has_promo"),
                 F.coalesce(F.sum(F.when(plain, F.col(ROWS))), F.lit(0)).cast("long").alias("nonpromo_rows"),
                 *C.merged_parts(SALES, plain, "nonpromo_sales")))


def promo_summary(found: DataFrame, region: str = S.ALL) -> DataFrame:
    """``promo.promo_summary`` from cells."""
    rows = found.where(PROMO) if region == S.ALL else found.where(F.col(PROMO) & (F.col(S.REGION) == F.lit(region)))
    return P.summed_years(rows, S.promo_keys(found.columns), C.merged_parts(SALES), C.merged_parts(QTY))
