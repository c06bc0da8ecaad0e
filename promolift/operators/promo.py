"""Promotion filters, the promotion summary, uplift and the roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift import schema as S
from promolift.functions import clean as C
from promolift.functions import labels as L

# ---------------------------------------------------------------- filters


def promo_rows(sales: DataFrame) -> DataFrame:
    return sales.where(S.is_promo())


def nonpromo_rows(sales: DataFrame) -> DataFrame:
    return sales.where(~S.is_promo())


def promo_split(sales: DataFrame) -> DataFrame:
    """Rows and sales on each side of the promo test."""
    return (sales.groupBy(S.is_promo().alias("is_promo"))
            .agg(F.count(F.lit(1)).alias("records"), C.exact_sum(S.NET_SALES).alias("sales")))


def promo_data(sales: DataFrame) -> DataFrame:
    """The eight-column promo view."""
    return promo_rows(sales).select(S.ARTICLE, S.BONUS_BUY, S.REGION, S.SALES_DATE, S.NET_SALES,
                                    S.QUANTITY, S.STATUS, S.SUBCAT)


def nonpromo_data(sales: DataFrame) -> DataFrame:
    """The four-column non-promo view (status equal to NON-PROMO)."""
    return (sales.where(F.col(S.STATUS) == S.NON_PROMO)
            .select(S.ARTICLE, S.REGION, S.SALES_DATE, S.NET_SALES))


def filter_sales(prepared: DataFrame, filters: S.Filters) -> DataFrame:
    """Conjunction of equalities; ``"All"`` (or a missing optional column) means no filter."""
    cond = F.lit(True)
    cols = set(prepared.columns)
    for value, name in ((filters.year, S.YEAR), (filters.month, S.MONTH), (filters.subcat, S.SUBCAT),
                        (filters.psa, S.PSA), (filters.region, S.REGION)):
        if value != S.ALL and name in cols:
            cond = cond & (F.col(name) == F.lit(value))
    return prepared.where(cond)


def promo_regions(sales: DataFrame) -> DataFrame:
    """Distinct regions that have promo rows, with their number of them."""
    return (promo_rows(sales).where(F.col(S.REGION).isNotNull())
            .groupBy(S.REGION).agg(F.count(F.lit(1)).alias("promo_rows")))


def region_scope(sales: DataFrame, region: str = S.ALL) -> DataFrame:
    """Promo rows of the chosen region, or of every region that has promos.

    With ``"All"`` every promo row already lies in a region with promos, so
    the restriction is the promo test itself and needs no join.
    """
    rows = promo_rows(sales)
    if region != S.ALL:
        rows = rows.where(F.col(S.REGION) == F.lit(region))
    return rows


# ---------------------------------------------------------------- summary


def forecast_maxima(columns: list[str]) -> list:
    """Aggregates of the forecast columns, where there are any."""
    if S.HAS_FORECAST not in columns:
        return []
    return [F.bool_or(S.HAS_FORECAST).alias(S.HAS_FORECAST), F.max(S.FORECAST_QTY).alias(S.FORECAST_QTY),
            F.max(S.FORECAST_DAILY).alias(S.FORECAST_DAILY)]


# The days of a year as bits of so many longs.
_YEAR_OF_DAYS = ["_year", *(f"_days{i}" for i in range(6))]


def day_bits(date=S.SALES_DATE) -> list:
    """Aggregates of the days that occur in one year, as the bits of six longs."""
    day = F.dayofyear(date) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), day % 64)
    return [F.bit_or(F.when(F.shiftright(day, 6) == i, bit)).alias(name) for i, name in enumerate(_YEAR_OF_DAYS[1:])]


def summed_years(rows: DataFrame, keys: list[str], sales: list, quantity: list) -> DataFrame:
    """Promotion facts of rows; ``sales`` and ``quantity`` are aggregates of parts of sums, of these names.

    Rows are summed by year first, their dates set as bits: the saved table is sorted by year and article, so the
    map side leaves a row for each promotion and year, where distinct dates would send on about as many as it read.
    """
    maxima = forecast_maxima(rows.columns)
    years = (rows.dropna(subset=keys).groupBy(*keys, F.year(S.SALES_DATE).alias(_YEAR_OF_DAYS[0]))
             .agg(*sales, *quantity, *day_bits(), *maxima))
    days = [F.coalesce(F.bit_count(name), F.lit(0)) for name in _YEAR_OF_DAYS[1:]]
    return years.groupBy(*keys).agg(
        C.merged_sum("sales").alias("PromoSales"), C.merged_sum("qty").alias("PromoQuantity"),
        F.sum(reduce(lambda a, b: a + b, days)).alias("PromoDays"), *maxima)


def promo_summary(sales: DataFrame, region: str = S.ALL) -> DataFrame:
    """Promotion facts by Article, Bonus Buy, Region (+ Sub Category, PSA).

    Forecast maxima are taken in the same aggregation (same keys), so no
    second pass and no join is needed. Rows with a NULL key are left out.
    """
    return summed_years(region_scope(sales, region), S.promo_keys(sales.columns),
                        C.sum_parts(S.NET_SALES, "sales"), C.sum_parts(S.QUANTITY, "qty"))


def region_daily_baselines(sales: DataFrame, min_clean_days: int = S.MIN_CLEAN_DAYS) -> DataFrame:
    """Article, Region, Daily_Avg from each region's own clean days (``baseline_by="region"``)."""
    from promolift.operators.baseline import region_baselines
    return (region_baselines(sales).where(F.col("NonPromoDays") >= min_clean_days)
            .select(S.ARTICLE, S.REGION, F.col("Daily_NonPromo_Avg").alias("Daily_Avg")))


def analyze_promotions(sales: DataFrame, baselines: DataFrame, min_days: int = S.DEFAULT_MIN_DAYS,
                       region: str = S.ALL, min_baseline: float = S.MIN_BASELINE_SALES,
                       apply_thresholds: bool = True, baseline_by: str = "article") -> DataFrame:
    """Valid promotions with uplift, forecast accuracy, verdict and confidence.

    The summary is joined to the per-article baselines (one row per article;
    AQE broadcasts it when it is measured small, else a shuffle join). The
    default compares each region's promotion with the article's all-region
    baseline, as the reference does; ``baseline_by="region"`` uses the
    region's own baseline (``region_daily_baselines``) instead.
    With ``apply_thresholds=False`` the facts come back unfiltered and
    unlabelled, for materialising once and thresholding late.
    """
    facts = with_baselines(promo_summary(sales, region), baselines, baseline_by)
    if not apply_thresholds:
        return facts
    return label_promotions(valid_filter(facts, min_days, min_baseline), S.promo_keys(sales.columns), S.FORECAST_QTY in facts.columns)


def with_baselines(summary: DataFrame, baselines: DataFrame, baseline_by: str = "article") -> DataFrame:
    """Promotion facts: the summary with baseline sales, uplift and forecast accuracy, no threshold applied."""
    if baseline_by == "region":
        df = summary.join(baselines.select(S.ARTICLE, S.REGION, "Daily_Avg"), [S.ARTICLE, S.REGION], "inner")
    elif baseline_by == "article":
        df = summary.join(baselines.select(S.ARTICLE, "Daily_Avg"), S.ARTICLE, "inner")
    else:
        raise ValueError(f"baseline_by must be 'article' or 'region', not {baseline_by!r}")
    df = df.withColumn("BaselineSales", F.col("Daily_Avg") * F.col("PromoDays"))
    df = df.withColumn("Uplift_Pct", C.uplift(F.col("PromoSales"), F.col("BaselineSales")))
    if S.FORECAST_QTY in df.columns:
        acc = C.forecast_accuracy(F.col("PromoQuantity"), F.col(S.FORECAST_QTY))
        df = df.withColumn("Forecast_Accuracy", acc) \
               .withColumn("Forecast_Interpretation", L.forecast_verdict(F.col("Forecast_Accuracy")))
    return df


def valid_filter(df: DataFrame, min_days: int, min_baseline: float = S.MIN_BASELINE_SALES) -> DataFrame:
    return df.where((F.col("PromoDays") >= min_days) & (F.col("BaselineSales") >= min_baseline)
                    & F.col("Uplift_Pct").isNotNull())


def label_promotions(df: DataFrame, keys: list[str], has_fc: bool = True) -> DataFrame:
    cols = keys + ["PromoSales", "PromoQuantity", "PromoDays", "Daily_Avg", "BaselineSales", "Uplift_Pct"]
    if has_fc:
        cols += [S.HAS_FORECAST, S.FORECAST_QTY, S.FORECAST_DAILY, "Forecast_Accuracy", "Forecast_Interpretation"]
    return df.select(
        *cols,
        L.uplift_verdict(F.col("Uplift_Pct")).alias("Interpretation"),
        L.confidence(F.col("PromoDays"), F.col("BaselineSales") / F.col("PromoDays")).alias("Confidence"),
        L.pct_text(F.col("Uplift_Pct")).alias("Uplift_Display"),
        F.col("PromoDays").alias("Duration"),
    )


def forecast_coverage(valid: DataFrame) -> DataFrame:
    """Share of valid promotions with a forecast; NULL when there is none."""
    return valid.agg(F.count(F.lit(1)).alias("valid_promos"),
                     F.avg(F.col(S.HAS_FORECAST).cast("double")).alias("forecast_coverage"))


def min_days_refilter(valid: DataFrame, min_days: int) -> DataFrame:
    return valid.where(F.col("Duration") >= min_days)


def duration_filter_counts(valid: DataFrame, min_days: int) -> DataFrame:
    """Promotions kept and removed by the duration filter, in one pass."""
    keep = F.col("Duration") >= min_days
    return valid.agg(F.count_if(keep).cast("long").alias("kept"),
                     F.count_if(~keep).cast("long").alias("removed"))


# ---------------------------------------------------------------- roll-up


def promo_rollup(valid: DataFrame, include_region_count: bool = True) -> DataFrame:
    """Valid promotions summed over regions, by Article and Bonus Buy.

    Uplift is recomputed from the sums; Duration is a mean, Forecast_Qty a max.
    """
    aggs = [C.exact_sum("PromoSales").alias("PromoSales"),
            C.exact_sum("PromoQuantity").alias("PromoQuantity"),
            C.exact_sum("BaselineSales").alias("BaselineSales"),
            F.avg("Duration").alias("Duration")]
    has_fc = S.FORECAST_QTY in valid.columns
    if has_fc:
        aggs.append(F.max(S.FORECAST_QTY).alias(S.FORECAST_QTY))
    if include_region_count:
        aggs.append(F.countDistinct(S.REGION).alias(S.REGION))
    df = valid.dropna(subset=[S.ARTICLE, S.BONUS_BUY]).groupBy(S.ARTICLE, S.BONUS_BUY).agg(*aggs)
    df = df.withColumn("Uplift_Pct", C.uplift(F.col("PromoSales"), F.col("BaselineSales"))) \
           .withColumn("Uplift_Display", L.pct_text(F.col("Uplift_Pct")))
    if has_fc:
        df = df.withColumn("Forecast_Accuracy", C.forecast_accuracy(F.col("PromoQuantity"), F.col(S.FORECAST_QTY))) \
               .withColumn("Forecast_Accuracy_Display", L.pct_text(F.col("Forecast_Accuracy")))
    return df
