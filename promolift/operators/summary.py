"""Summary reports: overview, top/bottom N, indicators, strategy, display tables, profile.

Global indicators are one ``agg`` each (one job, partial aggregation), never
several counts; top-N is ``orderBy().limit()`` which Spark runs as a
per-partition top-k (TakeOrderedAndProject), never a full sort.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolift import schema as S
from promolift.functions import clean as C
from promolift.functions import labels as L


def overview(filtered: DataFrame) -> DataFrame:
    """Records, promo records, non-promo records, distinct articles, forecast matches."""
    aggs = [F.count(F.lit(1)).alias("total_records"),
            F.count_if(S.is_promo()).cast("long").alias("promo_records"),
            F.count_if(F.col(S.STATUS) == S.NON_PROMO).cast("long").alias("nonpromo_records"),
            F.countDistinct(S.ARTICLE).alias("unique_articles")]
    if S.HAS_FORECAST in filtered.columns:
        aggs.append(F.count_if(F.col(S.HAS_FORECAST)).cast("long").alias("forecast_matches"))
    return filtered.agg(*aggs)


def _order_best(df: DataFrame):
    return [F.col("Uplift_Pct").desc_nulls_last(), F.col(S.ARTICLE).asc(), F.col(S.BONUS_BUY).asc()]


def _order_worst(df: DataFrame):
    return [F.col("Uplift_Pct").asc_nulls_last(), F.col(S.ARTICLE).desc(), F.col(S.BONUS_BUY).desc()]


def top_promos(rollup: DataFrame, n: int = S.DEFAULT_TOP_N) -> DataFrame:
    """The N roll-up rows with the highest uplift (ties by Article, Bonus Buy)."""
    return rollup.orderBy(*_order_best(rollup)).limit(n)


def bottom_promos(rollup: DataFrame, n: int = S.DEFAULT_TOP_N) -> DataFrame:
    """The N roll-up rows with the lowest uplift, lowest first; may overlap the top N."""
    return rollup.orderBy(*_order_worst(rollup)).limit(n)


def promo_kpis(rows: DataFrame) -> DataFrame:
    """Mean uplift %, total uplift in thousands, mean duration, mean forecast accuracy %, total sales."""
    aggs = [(C.exact_avg("Uplift_Pct") * 100).alias("avg_uplift_pct"),
            ((C.exact_sum("PromoSales") - C.exact_sum("BaselineSales")) / 1000).alias("total_uplift_k"),
            C.exact_avg("Duration").alias("avg_duration"),
            C.exact_sum("PromoSales").alias("total_sales"),
            F.count(F.lit(1)).alias("promotions")]
    if "Forecast_Accuracy" in rows.columns:
        aggs.append((C.exact_avg("Forecast_Accuracy") * 100).alias("forecast_accuracy_pct"))
    k = rows.agg(*aggs)
    texts = {"avg_uplift_display": L.pct_text(F.col("avg_uplift_pct"), scale=1.0),
             "total_uplift_display": L.thousands_text(F.col("total_uplift_k")),
             "avg_duration_display": F.format_string("%.1f days", F.col("avg_duration"))}
    if "forecast_accuracy_pct" in k.columns:
        texts["forecast_accuracy_display"] = L.pct_text(F.col("forecast_accuracy_pct"), scale=1.0)
    return k.withColumns(texts)


def top_kpis(rollup: DataFrame, n: int = S.DEFAULT_TOP_N) -> DataFrame:
    return promo_kpis(top_promos(rollup, n))


def bottom_kpis(rollup: DataFrame, n: int = S.DEFAULT_TOP_N) -> DataFrame:
    return promo_kpis(bottom_promos(rollup, n))


def with_verdict(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("Interpretation", L.uplift_verdict(F.col("Uplift_Pct")))


def strategy(rollup: DataFrame) -> DataFrame:
    """Roll-up rows grouped by verdict, most frequent verdict first, with the action text."""
    region = F.sum(S.REGION) if S.REGION in rollup.columns else F.lit(None).cast("long")
    df = (with_verdict(rollup).groupBy("Interpretation")
          .agg(F.count(S.BONUS_BUY).alias("Count"),
               C.exact_avg("Uplift_Pct").alias("Avg_Uplift"),
               C.exact_sum("PromoSales").alias("Total_Sales"),
               C.exact_sum("BaselineSales").alias("Total_Baseline"),
               region.alias("Total_Regions"),
               C.exact_avg("Duration").alias("Avg_Duration")))
    return (df.withColumn("Total_Uplift", F.col("Total_Sales") - F.col("Total_Baseline"))
            .withColumn("Action", L.action(F.col("Interpretation")))
            .orderBy(F.col("Count").desc(), F.col("Interpretation")))


def verdict_detail(rollup: DataFrame, verdict: str) -> DataFrame:
    """Roll-up rows of one verdict: losses worst first, the others best first."""
    df = with_verdict(rollup).where(F.col("Interpretation") == F.lit(verdict))
    worst_first = verdict == L.LOSS
    return df.orderBy(*(_order_worst(df) if worst_first else _order_best(df)))


def verdict_details(rollup: DataFrame) -> DataFrame:
    """The drill-down of every verdict: its roll-up rows with their ``Rank`` in the order of ``verdict_detail``.

    The rows are range-sorted and saved; a row's rank is its place in its partition plus the
    rows of its verdict in the partitions before (a few counts). So a verdict that holds
    most rows is never in one task.
    """
    from promolift.sources.store import work_dir, write_parquet
    df = with_verdict(rollup)
    loss = F.col("Interpretation") == F.lit(L.LOSS)
    by = F.when(loss, F.col("Uplift_Pct")).otherwise(-F.col("Uplift_Pct"))
    # Ties go up by Article and Bonus Buy, but down among losses.
    names = [F.col(c) for c in (S.ARTICLE, S.BONUS_BUY)]
    order = ["Interpretation", by.asc_nulls_last(), *[F.when(~loss, c).asc() for c in names], *[F.when(loss, c).desc() for c in names]]
    spark = rollup.sparkSession
    path = f"{work_dir(spark)}/verdict_details-{uuid.uuid4().hex}"
    here = F.row_number().over(Window.partitionBy("_part", "Interpretation").orderBy(*order[1:]))
    write_parquet(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy("Interpretation", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("Interpretation").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("Interpretation", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (rows.withColumn("_here", here).join(F.broadcast(offsets), ["Interpretation", "_part"])
            .withColumn("Rank", F.col("_here") + F.col("_before")).select(*df.columns, "Rank"))


def display_table(rollup: DataFrame, lowest_first: bool = False) -> DataFrame:
    """Renamed, formatted roll-up, ordered by the rounded uplift percent (highest first, or lowest)."""
    cols = [F.col(S.ARTICLE).alias("Article"),
            F.col(S.BONUS_BUY).alias("Promotion"),
            L.money_text(F.col("PromoSales")).alias("Promo Sales"),
            L.money_text(F.col("BaselineSales")).alias("Baseline"),
            L.qty_text(F.col("PromoQuantity")).alias("Promo Qty")]
    if S.FORECAST_QTY in rollup.columns:
        cols.append(L.qty_text(F.col(S.FORECAST_QTY)).alias("Forecast Qty"))
    cols += [F.col("Uplift_Display").alias("Uplift %"),
             F.col("Duration").alias("Duration (Days)")]
    if S.REGION in rollup.columns:
        cols.append(F.col(S.REGION).alias("Regions Count"))
    if "Forecast_Accuracy_Display" in rollup.columns:
        cols.append(F.col("Forecast_Accuracy_Display").alias("Forecast Accuracy"))
    cols.append(F.round(F.col("Uplift_Pct") * 100, 1).alias("uplift_sort"))
    by_uplift = F.col("uplift_sort").asc_nulls_last() if lowest_first else F.col("uplift_sort").desc_nulls_last()
    return rollup.select(*cols).orderBy(by_uplift, F.col("Article"), F.col("Promotion"))


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, columns, distinct articles and regions, date range, valid and invalid dates.

    Rows are summed to one per (Article, Region) first, so the distinct counts
    work on those few rows; ``approximate`` counts them by sketches instead.
    """
    keys = [c for c in (S.ARTICLE, S.REGION) if c in df.columns]
    d = F.col(S.SALES_DATE) if S.SALES_DATE in df.columns else F.lit(None).cast("date")
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(d).alias("_first"), F.max(d).alias("_last"),
                                  F.count(d).alias("_valid"))
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    aggs = [F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"), F.lit(len(df.columns)).cast("int").alias("columns")]
    aggs += [distinct(c).alias(name) for c, name in ((S.ARTICLE, "articles"), (S.REGION, "regions")) if c in keys]
    if S.SALES_DATE in df.columns:
        aggs += [F.min("_first").alias("min_date"), F.max("_last").alias("max_date"),
                 F.coalesce(F.sum("_valid"), F.lit(0)).cast("long").alias("valid_dates"),
                 F.coalesce(F.sum(F.col("_n") - F.col("_valid")), F.lit(0)).cast("long").alias("invalid_dates")]
    return cells.agg(*aggs)


FILTER_COLUMNS = [S.YEAR, S.MONTH, S.SUBCAT, S.PSA, S.REGION]


def filter_options(prepared: DataFrame) -> DataFrame:
    """Sorted distinct non-NULL values of the five filter columns, in one job (long form).

    The different combinations come first (a hash aggregate); only they are turned into one row a value.
    """
    present = [c for c in FILTER_COLUMNS if c in prepared.columns]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in present)
    long = prepared.select(*present).distinct().selectExpr(f"stack({len(present)}, {pairs}) AS (filter, value)")
    return (long.where(F.col("value").isNotNull()).distinct()
            .orderBy("filter", F.length("value"), "value"))
