"""Clean non-promotion baselines.

A *clean day* of an article is a date on which it has a NON-PROMO row and no
promo row in any region of the (filtered) data. The baseline of an article is
its NON-PROMO sales on clean days divided by the number of clean days, given
at least three clean days; only articles that have a promotion get one.

Plan: two aggregations and no join. ``groupBy(Article, Sales Date)`` marks
each article-day (any promo row?) and sums its NON-PROMO sales; a second
``groupBy(Article)`` keeps the unmarked days. Both run partial before their
shuffle, so an article holding a third of all rows is combined map-side and
never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolift import schema as S
from promolift.functions import clean as C


def article_days(sales: DataFrame) -> DataFrame:
    """One row per (Article, Sales Date): promo flag, NON-PROMO rows and the parts of their sales (``clean.sum_parts``)."""
    promo = S.is_promo()
    return (sales.where(F.col(S.ARTICLE).isNotNull())
            .groupBy(S.ARTICLE, S.SALES_DATE)
            .agg(F.bool_or(promo).alias("has_promo"),
                 F.count_if(~promo).alias("nonpromo_rows"),
                 *C.sum_parts(F.when(~promo, F.col(S.NET_SALES)), "nonpromo_sales")))


def stats_from_days(days: DataFrame) -> DataFrame:
    """``baseline_stats`` from article-days."""
    clean = ~F.col("has_promo") & (F.col("nonpromo_rows") > 0)
    return (days.groupBy(S.ARTICLE)
            .agg(F.bool_or("has_promo").alias("any_promo"),
                 F.count_if(clean).alias("Clean_Days"),
                 C.merged_sum("nonpromo_sales", clean).alias("clean_sales"))
            .where(F.col("any_promo"))
            .drop("any_promo"))


def baseline_stats(sales: DataFrame) -> DataFrame:
    """Per promoted article: clean days and clean-day sales (no threshold)."""
    return stats_from_days(article_days(sales))


def baselines_from(stats: DataFrame, min_clean_days: int = S.MIN_CLEAN_DAYS) -> DataFrame:
    return (stats.where(F.col("Clean_Days") >= min_clean_days)
            .select(S.ARTICLE, (F.col("clean_sales") / F.col("Clean_Days")).alias("Daily_Avg"), F.col("Clean_Days")))


def baselines(sales: DataFrame, min_clean_days: int = S.MIN_CLEAN_DAYS) -> DataFrame:
    """Article, Daily_Avg, Clean_Days for articles with enough clean days."""
    return baselines_from(baseline_stats(sales), min_clean_days)


def baseline_totals(sales: DataFrame, min_clean_days: int = S.MIN_CLEAN_DAYS) -> DataFrame:
    """One row: clean days summed over all promoted articles, articles with a baseline.

    Both are 0 when no article reaches ``min_clean_days``.
    """
    st = baseline_stats(sales)
    valid = F.count_if(F.col("Clean_Days") >= min_clean_days)
    total = F.coalesce(F.sum("Clean_Days"), F.lit(0)).cast("long")
    return st.agg(F.when(valid > 0, total).otherwise(F.lit(0).cast("long")).alias("total_clean_days"),
                  valid.cast("long").alias("valid_articles"))


# Days of one bitmap: the bits of a long.
DAYS = 64


def _bitmap(date) -> tuple:
    """Number of the bitmap that a date lies in, and its bit there."""
    day = F.unix_date(date)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(DAYS)).cast("int"))
    return F.floor(day / DAYS).cast("int"), bit


def promo_days(sales: DataFrame) -> DataFrame:
    """Promo days of each article as bitmaps: (Article, ``span``, ``days``), one row for 64 days.

    ``bit_or`` on longs is a hash aggregate with a map-side part; a row stands for up to 64 dates.
    """
    span, bit = _bitmap(F.col(S.SALES_DATE))
    return (sales.where(S.is_promo() & F.col(S.ARTICLE).isNotNull() & F.col(S.SALES_DATE).isNotNull())
            .groupBy(S.ARTICLE, span.alias("span")).agg(F.bit_or(bit).alias("days")))


def clean_rows(sales: DataFrame) -> DataFrame:
    """NON-PROMO rows on dates without any promo row of the same article.

    The promo days' bitmaps are saved and measured. Small (``store.BROADCAST_BYTES``), they are sent to the
    rows, of which none is shuffled; else both meet by (Article, span), and AQE splits a hot article's rows.
    """
    from promolift.sources.store import saved_measured
    found, small = saved_measured(promo_days(sales), "promo_days")
    found = found.select(F.col(S.ARTICLE).alias("_article"), F.col("span").alias("_span"), F.col("days").alias("_days"))
    span, bit = _bitmap(F.col(S.SALES_DATE))
    nonpromo = sales.where(~S.is_promo())
    same = (F.col(S.ARTICLE) == F.col("_article")) & (span == F.col("_span")) & (F.col("_days").bitwiseAND(bit) != 0)
    return nonpromo.join(F.broadcast(found) if small else found, same, "left_anti")


def region_days(sales: DataFrame) -> DataFrame:
    """One row per (Article, Region, Sales Date): promo flag, NON-PROMO rows and the parts of their sales and quantity."""
    promo = S.is_promo()
    return (sales.where(F.col(S.ARTICLE).isNotNull())
            .groupBy(S.ARTICLE, S.REGION, S.SALES_DATE)
            .agg(F.bool_or(promo).alias("has_promo"),
                 F.count_if(~promo).alias("nonpromo_rows"),
                 *C.sum_parts(F.when(~promo, F.col(S.NET_SALES)), "nonpromo_sales"),
                 *C.sum_parts(F.when(~promo, F.col(S.QUANTITY)), "nonpromo_qty")))


def clean_region_days(sales: DataFrame) -> DataFrame:
    """Region-days with NON-PROMO rows on a date the article has no promo row in any region.

    The article-wide promo flag is a window over (Article, Sales Date) on
    region-day rows (at most one per region), so no raw rows are joined or
    shuffled: the rows were combined map-side in ``region_days``.
    """
    day = Window.partitionBy(S.ARTICLE, S.SALES_DATE)
    rd = region_days(sales).withColumn("_day_promo", F.bool_or("has_promo").over(day))
    return rd.where(~F.col("_day_promo") & (F.col("nonpromo_rows") > 0)).drop("_day_promo")


def region_baselines(sales: DataFrame) -> DataFrame:
    """Per article and region, over clean rows: sales, days, mean quantity, daily average."""
    return (clean_region_days(sales)
            .where(F.col(S.REGION).isNotNull())
            .groupBy(S.ARTICLE, S.REGION)
            .agg(C.merged_sum("nonpromo_sales").alias("NonPromoSales"),
                 F.count(F.lit(1)).alias("NonPromoDays"),
                 (C.merged_sum("nonpromo_qty") / F.sum("nonpromo_rows")).alias("AvgQuantity"))
            .withColumn("Daily_NonPromo_Avg", F.col("NonPromoSales") / F.col("NonPromoDays")))


def article_daily_avg(sales: DataFrame) -> DataFrame:
    """Per article with clean days: clean sales / max(clean days, 1)."""
    clean = ~F.col("has_promo") & (F.col("nonpromo_rows") > 0)
    return (article_days(sales).groupBy(S.ARTICLE)
            .agg(C.merged_sum("nonpromo_sales", clean).alias("clean_sales"),
                 F.count_if(clean).alias("clean_days"))
            .where(F.col("clean_days") > 0)
            .select(S.ARTICLE,
                    (F.col("clean_sales") / F.greatest(F.col("clean_days"), F.lit(1))).alias("overall_daily_avg")))
