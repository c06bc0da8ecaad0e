"""Article view: per-article metrics, region baselines, uplift by region and promo type.

The reference computes these for one chosen article at a time; here
``Article`` is the leading group key, so one job covers every article and
``article_rows`` gives the one-article case (a literal filter that reaches
the Parquet scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolift import schema as S
from promolift.functions import clean as C
from promolift.functions import labels as L
from promolift.operators import baseline as B


def article_metrics(prepared: DataFrame) -> DataFrame:
    """Per article: rows, distinct dates, promo and non-promo rows, first and last date."""
    return (prepared.groupBy(S.ARTICLE)
            .agg(F.count(F.lit(1)).alias("total_rows"),
                 F.countDistinct(S.SALES_DATE).alias("unique_days"),
                 F.count_if(F.col(S.STATUS) != S.NON_PROMO).cast("long").alias("promo_count"),
                 F.count_if(F.col(S.STATUS) == S.NON_PROMO).cast("long").alias("nonpromo_count"),
                 F.min(S.SALES_DATE).alias("first_date"),
                 F.max(S.SALES_DATE).alias("last_date")))


def valid_articles(prepared: DataFrame, min_promo: int = S.VALID_ARTICLE_MIN_PROMO,
                   min_nonpromo: int = S.VALID_ARTICLE_MIN_NONPROMO,
                   limit: int | None = None) -> DataFrame:
    """Articles with enough promo and non-promo rows, most rows first; all of them unless ``limit`` is given."""
    df = (article_metrics(prepared)
          .where((F.col("promo_count") >= min_promo) & (F.col("nonpromo_count") >= min_nonpromo))
          .select(S.ARTICLE, "total_rows")
          .orderBy(F.col("total_rows").desc(), F.col(S.ARTICLE)))
    return df.limit(limit) if limit else df


def article_list(prepared: DataFrame, limit: int | None = None) -> DataFrame:
    """The valid articles in alphabetical order (the choice list)."""
    return valid_articles(prepared, limit=limit).select(S.ARTICLE).orderBy(S.ARTICLE)


def article_rows(prepared: DataFrame, article: str) -> DataFrame:
    return prepared.where(F.col(S.ARTICLE) == F.lit(article))


def article_kpis(prepared: DataFrame) -> DataFrame:
    """Per article with promo rows: promo days, records, sales, types; clean and non-promo days.

    One scan: rows are summed by article and day and by article and promo type (two grouping
    sets of one hash aggregate, combined on the map side), then per article.
    """
    promo = S.is_promo()
    known = prepared.where(F.col(S.ARTICLE).isNotNull())
    cells = (known.groupingSets([[S.ARTICLE, S.SALES_DATE], [S.ARTICLE, S.BONUS_BUY]], S.ARTICLE, S.SALES_DATE, S.BONUS_BUY)
             .agg((F.grouping(S.SALES_DATE) == 0).alias("day"), F.bool_or(promo).alias("p"), F.bool_or(~promo).alias("np"),
                  F.count_if(promo).alias("pr"), *C.sum_parts(F.when(promo, F.col(S.NET_SALES)), "ps")))
    day = F.col("day")
    return (cells.groupBy(S.ARTICLE)
            .agg(F.count_if(day & F.col("p")).cast("long").alias("promo_days"),
                 F.sum(F.when(day, F.col("pr"))).cast("long").alias("promo_records"),
                 F.coalesce(C.merged_sum("ps", day), F.lit(0.0)).alias("promo_sales"),
                 F.count_if(day & F.col("np") & ~F.col("p")).cast("long").alias("clean_days"),
                 F.count_if(day & F.col("np")).cast("long").alias("nonpromo_days"),
                 F.count_if(~day & F.col("p") & F.col(S.BONUS_BUY).isNotNull()).cast("long").alias("promo_types"))
            .where(F.col("promo_records") > 0))


def article_promos(prepared: DataFrame) -> DataFrame:
    """Promo rows by Article, Bonus Buy, Region: sums, days, row means, forecast maxima."""
    keys = [S.ARTICLE, S.BONUS_BUY, S.REGION]
    aggs = [C.exact_sum(S.NET_SALES).alias("PromoSales"),
            C.exact_sum(S.QUANTITY).alias("PromoQuantity"),
            F.countDistinct(S.SALES_DATE).alias("PromoDays"),
            C.exact_avg(S.NET_SALES).alias("AvgDailySales"),
            C.exact_avg(S.QUANTITY).alias("AvgDailyQuantity")]
    if S.HAS_FORECAST in prepared.columns:
        aggs += [F.bool_or(S.HAS_FORECAST).alias(S.HAS_FORECAST),
                 F.max(S.FORECAST_QTY).alias(S.FORECAST_QTY),
                 F.max(S.FORECAST_DAILY).alias(S.FORECAST_DAILY)]
    return prepared.where(S.is_promo()).dropna(subset=keys).groupBy(*keys).agg(*aggs)


def article_uplift(prepared: DataFrame, min_days: int = S.ARTICLE_MIN_DAYS,
                   min_baseline: float = S.ARTICLE_MIN_BASELINE) -> DataFrame:
    """Reliable region promotions: region baseline, uplift, forecast accuracy and verdict."""
    promos = article_promos(prepared).where(F.col("PromoDays") >= min_days)
    rb = B.region_baselines(prepared).select(S.ARTICLE, S.REGION, "Daily_NonPromo_Avg")
    df = promos.join(rb, [S.ARTICLE, S.REGION], "left")
    df = df.withColumn("Baseline", F.col("Daily_NonPromo_Avg") * F.col("PromoDays"))
    df = df.withColumn("Uplift", F.col("PromoSales") - F.col("Baseline")) \
           .withColumn("Uplift_Pct", F.try_divide(F.col("Uplift"), F.col("Baseline")))
    if S.FORECAST_QTY in df.columns:
        df = df.withColumn("Forecast_Accuracy", C.forecast_accuracy(F.col("PromoQuantity"), F.col(S.FORECAST_QTY))) \
               .withColumn("Forecast_Interpretation", L.forecast_verdict(F.col("Forecast_Accuracy")))
    return df.where(F.col("Baseline") >= min_baseline)


def _leading(prepared: DataFrame):
    """The leading number of the load order; None if it does not begin with a number."""
    order = prepared.schema[S.ROW_ORDER].dataType
    if isinstance(order, T.IntegralType):
        return F.col(S.ROW_ORDER)
    if isinstance(order, T.StructType) and isinstance(order.fields[0].dataType, T.IntegralType):
        return F.col(S.ROW_ORDER)[order.fields[0].name]
    return None


def article_info(prepared: DataFrame) -> DataFrame:
    """Per article: first Sub Category and PSA in load order, any forecast.

    Found in stages, for a minimum over a struct or a text would sort all rows: the
    least leading number of each article is a hash aggregate; only rows that have it (the lines of one
    order) are left to be ranked by the whole load order.
    """
    from promolift.sources.store import saved_measured
    order = F.col(S.ROW_ORDER)
    has = [F.bool_or(S.HAS_FORECAST).alias(S.HAS_FORECAST)] if S.HAS_FORECAST in prepared.columns else []
    lead = _leading(prepared)
    if lead is None:
        return prepared.groupBy(S.ARTICLE).agg(F.min_by(S.SUBCAT, order).alias(S.SUBCAT), F.min_by(S.PSA, order).alias(S.PSA), *has)
    least, small = saved_measured(prepared.groupBy(S.ARTICLE).agg(F.min(lead).alias("_least"), *has), "article_first")
    least = least.withColumnRenamed(S.ARTICLE, "_article")
    rows = prepared.select(S.ARTICLE, S.SUBCAT, S.PSA, order, lead.alias("_lead"))
    same = F.col(S.ARTICLE).eqNullSafe(F.col("_article")) & (F.col("_lead") == F.col("_least"))
    firsts = rows.join(F.broadcast(least) if small else least, same)
    rank = F.row_number().over(Window.partitionBy(S.ARTICLE).orderBy(S.ROW_ORDER))
    return firsts.withColumn("_rank", rank).where(F.col("_rank") == 1).select(S.ARTICLE, S.SUBCAT, S.PSA, *([S.HAS_FORECAST] if has else []))


def _reliable_by_article(prepared: DataFrame, min_days: int) -> DataFrame:
    """Reliable region promotions, hash-partitioned by Article once.

    Rows here are already aggregated (one per article, promo type and region),
    so an article's rows are bounded by its promo types times regions, however
    many sales rows it has. Every later step (promo types, per-article
    medians, counts) runs on this partitioning without another shuffle.
    """
    return article_uplift(prepared, min_days).repartition(S.ARTICLE)


def promo_types_from(rel: DataFrame, *extra) -> DataFrame:
    """Reliable region promotions (one row per article, promo type and region) summed by Article and Bonus Buy."""
    aggs = [C.exact_sum("PromoSales").alias("Total_Sales"),
            C.exact_sum("PromoQuantity").alias("Total_Quantity"),
            F.avg("PromoDays").alias("Avg_PromoDays"),
            F.count(S.REGION).alias("Region_Count"),
            C.exact_sum("Baseline").alias("Baseline"),
            C.exact_sum("Uplift").alias("Uplift")]
    if S.FORECAST_QTY in rel.columns:
        aggs += [F.max(S.FORECAST_QTY).alias("Total_Forecast"),
                 C.exact_avg("Forecast_Accuracy").alias("Forecast_Accuracy")]
    df = rel.groupBy(S.ARTICLE, S.BONUS_BUY).agg(*aggs, *extra)
    return df.withColumn("Uplift_Pct", F.try_divide(F.col("Uplift"), F.col("Baseline"))) \
             .withColumn("Uplift_Numeric", F.col("Uplift_Pct") * 100) \
             .withColumn("Uplift_Display", L.pct_text(F.col("Uplift_Numeric"), scale=1.0))


def promo_types(prepared: DataFrame, min_days: int = S.ARTICLE_MIN_DAYS) -> DataFrame:
    """Reliable region promotions summed by Article and Bonus Buy."""
    return promo_types_from(article_uplift(prepared, min_days))


def rank_promo_types(types: DataFrame) -> DataFrame:
    """Display order: per article, best uplift first (ties by Bonus Buy)."""
    return types.orderBy(S.ARTICLE, F.col("Uplift_Numeric").desc_nulls_last(), S.BONUS_BUY)


def promo_details(types: DataFrame) -> DataFrame:
    """Promo types with display names and formatted values, best uplift first in each article."""
    out = [F.col(S.ARTICLE).alias("Article"), F.col(S.BONUS_BUY).alias("Promotion"),
           L.money_text(F.col("Total_Sales")).alias("Promo Sales"), F.col("Total_Quantity").alias("Promo Quantity"),
           F.col("Avg_PromoDays").alias("Avg Duration"), F.col("Region_Count").alias("Regions"),
           L.money_text(F.col("Baseline")).alias("Expected Baseline"), L.money_text(F.col("Uplift")).alias("Uplift Amount"),
           L.pct_text(F.col("Uplift_Numeric"), scale=1.0).alias("Uplift %")]
    if "Total_Forecast" in types.columns:
        out += [L.qty_text(F.col("Total_Forecast")).alias("Forecast Qty"),
                L.pct_text(F.col("Forecast_Accuracy")).alias("Forecast Accuracy %")]
    best = Window.partitionBy(S.ARTICLE).orderBy(F.col("Uplift_Numeric").desc_nulls_last(), S.BONUS_BUY)
    return types.select(*out, F.row_number().over(best).alias("Rank"))


def effectiveness(prepared: DataFrame, min_days: int = S.ARTICLE_MIN_DAYS) -> DataFrame:
    """Per article: mean uplift %, promo types, success rate, mean duration, accuracy, regions, verdict.

    One shuffle by Article: the distinct reliable regions are a window count
    over the article's rows, carried through the promo-type aggregation.
    """
    rel = _reliable_by_article(prepared, min_days)
    rel = rel.withColumn("_regions", F.size(F.collect_set(S.REGION).over(Window.partitionBy(S.ARTICLE))))
    types = promo_types_from(rel, F.max("_regions").alias("_regions"))
    aggs = [C.exact_avg("Uplift_Numeric").alias("avg_uplift_pct"),
            F.count(F.lit(1)).alias("num_types"),
            (F.avg((F.col("Uplift_Pct") > 0).cast("double")) * 100).alias("success_rate"),
            C.exact_avg("Avg_PromoDays").alias("avg_duration")]
    if "Forecast_Accuracy" in types.columns:
        aggs.append((C.exact_avg("Forecast_Accuracy") * 100).alias("forecast_accuracy_pct"))
    aggs.append(F.max("_regions").cast("long").alias("reliable_regions"))
    return (types.groupBy(S.ARTICLE).agg(*aggs)
            .withColumn("verdict", L.effectiveness(F.col("avg_uplift_pct"))))


def quartiles(prepared: DataFrame, min_days: int = S.ARTICLE_MIN_DAYS) -> DataFrame:
    """Per article over promo types: median and 25/75 % quantiles (interpolated) of sales and quantity.

    Exact ``percentile`` keeps a value -> count map per group; groups here are
    the promo types of one article.
    """
    types = promo_types_from(_reliable_by_article(prepared, min_days))
    ps = F.percentile(F.col("Total_Sales"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    pq = F.percentile(F.col("Total_Quantity"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (types.groupBy(S.ARTICLE).agg(ps.alias("_s"), pq.alias("_q"))
            .select(S.ARTICLE,
                    F.col("_s")[0].alias("sales_q25"), F.col("_s")[1].alias("median_sales"),
                    F.col("_s")[2].alias("sales_q75"),
                    F.col("_q")[0].alias("qty_q25"), F.col("_q")[1].alias("median_quantity"),
                    F.col("_q")[2].alias("qty_q75")))


def quadrants(prepared: DataFrame, min_days: int = S.ARTICLE_MIN_DAYS) -> DataFrame:
    """Each promo type placed by its article's median sales (value) and quantity (volume).

    The medians are window aggregates over the article's promo types, on the
    partitioning the types already have: one pass, no join back.
    """
    types = promo_types_from(_reliable_by_article(prepared, min_days))
    w = Window.partitionBy(S.ARTICLE)
    df = types.select(S.ARTICLE, S.BONUS_BUY, "Total_Sales", "Total_Quantity", "Uplift_Pct",
                      F.percentile(F.col("Total_Sales"), F.lit(0.5)).over(w).alias("median_sales"),
                      F.percentile(F.col("Total_Quantity"), F.lit(0.5)).over(w).alias("median_quantity"))
    name = L.quadrant(F.col("Total_Sales"), F.col("Total_Quantity"), F.col("median_sales"), F.col("median_quantity"))
    return df.withColumn("Quadrant", name).withColumn("Advice", L.quadrant_advice(F.col("Quadrant")))
