"""End-to-end plans: prepared table -> baselines -> valid promotions -> roll-up -> reports.

Each function returns lazy DataFrames; nothing runs until the caller acts.
Callers that use one roll-up for several reports (top, bottom, strategy)
should persist it or write it out once (see ``sources.store``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from promolift import schema as S
from promolift.operators import baseline as B
from promolift.operators import forecast as FC
from promolift.operators import promo as P
from promolift.operators import summary as SM
from promolift.sources import fixtures as FX


def prepared_sales(spark: SparkSession, sf_dir: str, with_forecast: bool = True,
                   mode: str = "contains", save_rows: bool = False) -> DataFrame:
    """Sales adapter over the given tables, prepared and matched to forecasts.

    With ``save_rows`` the joined rows are written first, once per input: the promoted articles, the ranges of a
    sorted write and the write itself then read them, where else each would join the tables again.
    """
    sales = FX.saved_sales(spark, sf_dir) if save_rows else FX.sales_table(spark, sf_dir)
    fc = FX.forecast_table(spark, sf_dir) if with_forecast else None
    return FC.prepare(sales, fc, mode)


@dataclass
class SummaryReport:
    filtered: DataFrame
    baselines: DataFrame
    valid: DataFrame
    rollup: DataFrame

    def top(self, n: int = S.DEFAULT_TOP_N) -> DataFrame:
        return SM.top_promos(self.rollup, n)

    def bottom(self, n: int = S.DEFAULT_TOP_N) -> DataFrame:
        return SM.bottom_promos(self.rollup, n)

    def strategy(self) -> DataFrame:
        return SM.strategy(self.rollup)


def summary_report(prepared: DataFrame, filters: S.Filters = S.Filters()) -> SummaryReport:
    """Filter -> baselines -> valid promotions (min_days) -> roll-up over regions."""
    filtered = P.filter_sales(prepared, filters)
    base = B.baselines(filtered)
    valid = P.analyze_promotions(filtered, base, filters.min_days, filters.region)
    valid = P.min_days_refilter(valid, filters.min_days)
    rollup = P.promo_rollup(valid, include_region_count=True)
    return SummaryReport(filtered, base, valid, rollup)


def summary_report_reusing_facts(prepared: DataFrame, filters: S.Filters, key: str) -> SummaryReport:
    """As ``summary_report``, but the baselines and the un-thresholded promotion facts are
    saved once per filter set without ``min_days`` (``key`` names the input and its
    version), so another ``min_days`` is a filter on the saved facts."""
    from promolift.sources import store as ST
    spark, saved_key = prepared.sparkSession, f"{key}|{filters.baseline_key()}"
    filtered = P.filter_sales(prepared, filters)
    base = ST.materialized(spark, "baselines", saved_key, lambda: B.baselines(filtered),
                           writer=lambda df, path: df.write.mode("overwrite").parquet(path))
    facts = P.analyze_promotions(filtered, base, region=filters.region, apply_thresholds=False)
    stored = ST.materialize_promotions(spark, facts, saved_key)
    valid = ST.min_days_view(stored, filters.min_days)
    return SummaryReport(filtered, base, valid, P.promo_rollup(valid, include_region_count=True))


def summary_report_from_cells(found: DataFrame, filters: S.Filters, key: str) -> SummaryReport:
    """As ``summary_report``, from saved cells (``operators.partials``) in place of sales rows.

    Baselines and un-thresholded facts are saved once per filter set without ``min_days`` and state of
    the cells (``key``): another ``min_days`` is a filter on them, an appended batch costs its own rows and the cells.
    """
    from promolift.operators import partials as PT
    from promolift.sources import store as ST
    spark, saved_key = found.sparkSession, f"{key}|{filters.baseline_key()}"
    filtered = P.filter_sales(found, filters)
    base = ST.materialized(spark, "cell_baselines", saved_key, lambda: B.baselines_from(B.stats_from_days(PT.article_days(filtered))),
                           writer=lambda df, path: df.write.mode("overwrite").parquet(path))
    stored = ST.materialize_promotions(spark, P.with_baselines(PT.promo_summary(filtered, filters.region), base), f"cells|{saved_key}")
    valid = ST.min_days_view(stored, filters.min_days)
    return SummaryReport(filtered, base, valid, P.promo_rollup(valid, include_region_count=True))


@dataclass
class ArticleReport:
    kpis: DataFrame
    info: DataFrame
    region_baselines: DataFrame
    uplift: DataFrame
    promo_types: DataFrame
    effectiveness: DataFrame
    quartiles: DataFrame
    quadrants: DataFrame


def article_report(prepared: DataFrame, article: str | None = None,
                   min_days: int = S.ARTICLE_MIN_DAYS) -> ArticleReport:
    """The article view for every article, or for one (its filter reaches the Parquet scan)."""
    from promolift.operators import article as A
    df = A.article_rows(prepared, article) if article is not None else prepared
    return ArticleReport(
        kpis=A.article_kpis(df), info=A.article_info(df), region_baselines=B.region_baselines(df),
        uplift=A.article_uplift(df, min_days), promo_types=A.rank_promo_types(A.promo_types(df, min_days)),
        effectiveness=A.effectiveness(df, min_days), quartiles=A.quartiles(df, min_days),
        quadrants=A.quadrants(df, min_days))
