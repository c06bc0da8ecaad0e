"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

All of them read the given tables whole (through the adapters of
``sources.fixtures``). Sums round no addend (``functions.clean.exact_sum``), so the
results do not depend on the order of rows and are returned as they are;
the load order, a struct, is shown as its four columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolift import schema as S
from promolift.functions import clean as C
from promolift.functions import labels as L
from promolift.operators import article as A
from promolift.operators import baseline as B
from promolift.operators import forecast as FC
from promolift.operators import ingest as I
from promolift.operators import partials as PT
from promolift.operators import promo as P
from promolift.operators import summary as SM
from promolift.plans import report as R
from promolift.sources import csv as CSV
from promolift.sources import fixtures as FX
from promolift.sources import store as ST
from promolift.streaming import ingest as STREAM

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
# Filter set used by the registered filter query: one year, every region.
YEAR_FILTER = S.Filters(year=1996)
ONE_ARTICLE = "Brand#1-1"


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


LOAD_ORDER = ["order", "line", "part", "supp"]


def finish(df: DataFrame) -> DataFrame:
    """The load order of sales rows as plain columns."""
    if S.ROW_ORDER not in df.columns or not df.schema[S.ROW_ORDER].dataType.simpleString().startswith("struct<order"):
        return df
    return df.select(*[c for c in (f"`{x}`" for x in df.columns if x != S.ROW_ORDER)],
                     *[F.col(f"{S.ROW_ORDER}.{f}").alias(f"load_{f}") for f in LOAD_ORDER])


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(QUERIES[name](spark, sf_dir))


def _prep(spark, sf_dir):
    """The prepared table, saved once per input folder and read back (as the
    reference analyses its saved table); ``prepare`` measures building it."""
    return ST.materialized(spark, "prepared", FX.data_key(spark, sf_dir),
                           lambda: R.prepared_sales(spark, sf_dir, save_rows=True),
                           writer=lambda df, path: ST.write_sales_table(df, path, ST.tasks_for(FX.saved_sales(spark, sf_dir)), mode="overwrite"))


def _articles(spark, sf_dir):
    """The promoted articles, saved once per input."""
    return ST.materialized(spark, "promo_articles", FX.data_key(spark, sf_dir), lambda: FC.promo_articles(_prep(spark, sf_dir)),
                           writer=lambda df, path: df.write.mode("overwrite").parquet(path))


def _report(spark, sf_dir):
    return R.summary_report(_prep(spark, sf_dir))


# ---------------------------------------------------------------- filters and splits


@register("overview")
def q_overview(spark, sf_dir):
    return SM.overview(_prep(spark, sf_dir))


@register("promo_split")
def q_promo_split(spark, sf_dir):
    return P.promo_split(_prep(spark, sf_dir))


@register("promo_data")
def q_promo_data(spark, sf_dir):
    return P.promo_data(_prep(spark, sf_dir))


@register("nonpromo_data")
def q_nonpromo_data(spark, sf_dir):
    return P.nonpromo_data(_prep(spark, sf_dir))


@register("filter_sales")
def q_filter_sales(spark, sf_dir):
    f = P.filter_sales(_prep(spark, sf_dir), YEAR_FILTER)
    return SM.overview(f).withColumn("year", F.lit(YEAR_FILTER.year))


@register("region_scope")
def q_region_scope(spark, sf_dir):
    rows = P.region_scope(_prep(spark, sf_dir), "EUROPE")
    return rows.groupBy(S.REGION).agg(F.count(F.lit(1)).alias("promo_rows"),
                                      C.exact_sum(S.NET_SALES).alias("PromoSales"))


@register("promo_regions")
def q_promo_regions(spark, sf_dir):
    return P.promo_regions(_prep(spark, sf_dir))


@register("prepare")
def q_prepare(spark, sf_dir):
    return R.prepared_sales(spark, sf_dir)


@register("no_forecast")
def q_no_forecast(spark, sf_dir):
    df = R.prepared_sales(spark, sf_dir, with_forecast=False)
    return df.select(S.ROW_ORDER, S.ARTICLE, S.NET_SALES, S.YEAR, S.MONTH, S.HAS_FORECAST, S.FORECAST_QTY,
                     S.FORECAST_DAILY)


@register("norm_status")
def q_norm_status(spark, sf_dir):
    od = FX.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    # Raw status text: missing for status 'P', lower-case 'non-promo' for
    # low priority, else the lower-cased priority; then normalised.
    raw = (F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
           .when(F.col("o_orderpriority").startswith("5"), F.lit("non-promo"))
           .otherwise(F.lower("o_orderpriority")))
    return (od.select(C.norm_status(raw).alias("status"))
            .groupBy("status").agg(F.count(F.lit(1)).alias("rows"),
                                   F.count_if(S.is_promo(F.col("status"))).cast("long").alias("promo_rows")))

# ---------------------------------------------------------------- baselines


@register("baselines")
def q_baselines(spark, sf_dir):
    return B.baselines(_prep(spark, sf_dir))


@register("baseline_totals")
def q_baseline_totals(spark, sf_dir):
    return B.baseline_totals(_prep(spark, sf_dir))


@register("clean_days")
def q_clean_days(spark, sf_dir):
    return B.clean_rows(_prep(spark, sf_dir)).select(S.ROW_ORDER, S.ARTICLE, S.REGION, S.SALES_DATE, S.NET_SALES)


@register("region_baselines")
def q_region_baselines(spark, sf_dir):
    return B.region_baselines(_prep(spark, sf_dir))


@register("article_daily_avg")
def q_article_daily_avg(spark, sf_dir):
    return B.article_daily_avg(_prep(spark, sf_dir))

# ---------------------------------------------------------------- promotions


@register("promo_summary")
def q_promo_summary(spark, sf_dir):
    return P.promo_summary(_prep(spark, sf_dir)).drop(S.HAS_FORECAST, S.FORECAST_QTY, S.FORECAST_DAILY)


@register("promo_forecast")
def q_promo_forecast(spark, sf_dir):
    df = P.promo_summary(_prep(spark, sf_dir))
    return df.select(*S.promo_keys(df.columns), S.HAS_FORECAST, S.FORECAST_QTY, S.FORECAST_DAILY)


@register("analyze_promotions")
def q_analyze(spark, sf_dir):
    return _report(spark, sf_dir).valid


@register("forecast_coverage")
def q_coverage(spark, sf_dir):
    return P.forecast_coverage(_report(spark, sf_dir).valid)


@register("min_days_refilter")
def q_min_days(spark, sf_dir):
    valid = _report(spark, sf_dir).valid
    return P.duration_filter_counts(valid, 7).withColumn("min_days", F.lit(7))


@register("promo_rollup")
def q_rollup(spark, sf_dir):
    return _report(spark, sf_dir).rollup


@register("top_promos")
def q_top(spark, sf_dir):
    return _report(spark, sf_dir).top(S.DEFAULT_TOP_N)


@register("bottom_promos")
def q_bottom(spark, sf_dir):
    return _report(spark, sf_dir).bottom(S.DEFAULT_TOP_N)


@register("top_kpis")
def q_top_kpis(spark, sf_dir):
    return SM.top_kpis(_report(spark, sf_dir).rollup, S.DEFAULT_TOP_N)


@register("bottom_kpis")
def q_bottom_kpis(spark, sf_dir):
    return SM.bottom_kpis(_report(spark, sf_dir).rollup, S.DEFAULT_TOP_N)


@register("strategy")
def q_strategy(spark, sf_dir):
    return _report(spark, sf_dir).strategy()


@register("verdict_detail")
def q_verdict_detail(spark, sf_dir):
    """Roll-up rows of every verdict with their place in its list."""
    return SM.verdict_details(_report(spark, sf_dir).rollup)


@register("display_table")
def q_display(spark, sf_dir):
    return SM.display_table(_report(spark, sf_dir).rollup)


@register("display_lowest")
def q_display_lowest(spark, sf_dir):
    """The bottom promotions, lowest uplift first, with their rank."""
    rows = SM.bottom_promos(_report(spark, sf_dir).rollup, S.DEFAULT_TOP_N)  # a top-k of fixed size
    order = Window.orderBy(F.col("uplift_sort").asc_nulls_last(), "Article", "Promotion")
    return SM.display_table(rows, lowest_first=True).withColumn("Rank", F.row_number().over(order))


@register("uplift_verdict")
def q_uplift_verdict(spark, sf_dir):
    """Verdict of every summary row that has a baseline (no thresholds)."""
    prep = _prep(spark, sf_dir)
    facts = P.analyze_promotions(prep, B.baselines(prep), apply_thresholds=False)
    return (facts.select(L.uplift_verdict(F.col("Uplift_Pct")).alias("Interpretation"))
            .groupBy("Interpretation").agg(F.count(F.lit(1)).alias("promotions")))


@register("confidence")
def q_confidence(spark, sf_dir):
    prep = _prep(spark, sf_dir)
    facts = P.analyze_promotions(prep, B.baselines(prep), apply_thresholds=False)
    conf = L.confidence(F.col("PromoDays"), F.col("BaselineSales") / F.col("PromoDays"))
    return facts.groupBy(conf.alias("Confidence")).agg(F.count(F.lit(1)).alias("promotions"))


@register("forecast_verdict")
def q_forecast_verdict(spark, sf_dir):
    prep = _prep(spark, sf_dir)
    facts = P.analyze_promotions(prep, B.baselines(prep), apply_thresholds=False)
    return facts.groupBy("Forecast_Interpretation").agg(F.count(F.lit(1)).alias("promotions"))


@register("forecast_accuracy")
def q_forecast_accuracy(spark, sf_dir):
    df = P.promo_summary(_prep(spark, sf_dir))
    return df.select(*S.promo_keys(df.columns), "PromoQuantity", S.FORECAST_QTY,
                     C.forecast_accuracy(F.col("PromoQuantity"), F.col(S.FORECAST_QTY)).alias("Forecast_Accuracy"))

# ---------------------------------------------------------------- forecasts


@register("forecast_match")
def q_forecast_match(spark, sf_dir):
    return FC.forecast_match(_articles(spark, sf_dir), FX.forecast_table(spark, sf_dir), "contains")


@register("forecast_match_token")
def q_forecast_match_token(spark, sf_dir):
    return FC.forecast_match(_articles(spark, sf_dir), FX.forecast_table(spark, sf_dir), "token")


@register("forecast_match_regex")
def q_forecast_match_regex(spark, sf_dir):
    """Articles as patterns: those of size 7 with a pattern in place of the dash, the others as they are."""
    articles = _articles(spark, sf_dir)
    stem = F.substring_index(S.ARTICLE, "-", 1)
    patterns = articles.select(F.when(F.col(S.ARTICLE).endswith("-7"), F.concat(stem, F.lit("-[7]( |$)")))
                               .otherwise(F.col(S.ARTICLE)).alias(S.ARTICLE))
    return FC.forecast_match(patterns, FX.forecast_table(spark, sf_dir), "regex")


@register("forecast_stats")
def q_forecast_stats(spark, sf_dir):
    return FC.forecast_stats(FX.forecast_table(spark, sf_dir))

# ---------------------------------------------------------------- summary tables


@register("profile")
def q_profile(spark, sf_dir):
    return SM.profile(_prep(spark, sf_dir))


@register("filter_options")
def q_filter_options(spark, sf_dir):
    return SM.filter_options(_prep(spark, sf_dir))

# ---------------------------------------------------------------- article view


@register("article_metrics")
def q_article_metrics(spark, sf_dir):
    return A.article_metrics(_prep(spark, sf_dir))


@register("valid_articles")
def q_valid_articles(spark, sf_dir):
    return A.valid_articles(_prep(spark, sf_dir), limit=S.VALID_ARTICLE_LIMIT)


@register("article_list")
def q_article_list(spark, sf_dir):
    return A.article_list(_prep(spark, sf_dir))


@register("article_rows")
def q_article_rows(spark, sf_dir):
    return A.article_rows(_prep(spark, sf_dir), ONE_ARTICLE)


@register("article_kpis")
def q_article_kpis(spark, sf_dir):
    return A.article_kpis(_prep(spark, sf_dir))


@register("article_promos")
def q_article_promos(spark, sf_dir):
    return A.article_promos(_prep(spark, sf_dir))


@register("article_uplift")
def q_article_uplift(spark, sf_dir):
    return A.article_uplift(_prep(spark, sf_dir))


@register("article_info")
def q_article_info(spark, sf_dir):
    return A.article_info(_prep(spark, sf_dir))


@register("promo_types")
def q_promo_types(spark, sf_dir):
    return A.promo_types(_prep(spark, sf_dir))


@register("promo_details")
def q_promo_details(spark, sf_dir):
    return A.promo_details(A.promo_types(_prep(spark, sf_dir)))


@register("effectiveness")
def q_effectiveness(spark, sf_dir):
    return A.effectiveness(_prep(spark, sf_dir))


def _plain_round(df: DataFrame, *columns: str) -> DataFrame:
    """Interpolated quantiles to six decimals: engines interpolate in different ways."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("quartiles")
def q_quartiles(spark, sf_dir):
    return _plain_round(A.quartiles(_prep(spark, sf_dir)), "sales_q25", "median_sales", "sales_q75", "qty_q25",
                        "median_quantity", "qty_q75")


@register("quadrants")
def q_quadrants(spark, sf_dir):
    return _plain_round(A.quadrants(_prep(spark, sf_dir)), "median_sales", "median_quantity")

# ---------------------------------------------------------------- ingest (raw delimited files)


_SALES_OUT = [S.REGION, S.PSA, S.SUBCAT, S.BONUS_BUY, S.SALES_DATE, S.STATUS, S.ARTICLE, S.NET_SALES, S.QUANTITY]


def _raw(spark, sf_dir, *names):
    return [FX.raw_files(spark, sf_dir, name) for name in names]


def _loaded(spark, sf_dir):
    return CSV.load_many(spark, _raw(spark, sf_dir, "sales_a", "sales_b", "sales_c"))


def _sales_texts(spark, sf_dir):
    """Both kinds of sales files as text, one scan a kind."""
    a, b = (CSV.with_lineage(CSV.scan_csv(spark, path)) for path in _raw(spark, sf_dir, "sales_a", "sales_b"))
    return a.unionByName(b, allowMissingColumns=True)


def _orders_text(spark, sf_dir):
    df = CSV.scan_csv(spark, _raw(spark, sf_dir, "orders"))
    return df.withColumn("Order", F.col("Order").cast("long"))


@register("scan_csv")
def q_scan_csv(spark, sf_dir):
    return _sales_texts(spark, sf_dir).drop(S.SOURCE_FILE)


@register("load_many")
def q_load_many(spark, sf_dir):
    return I.clean_sales(_loaded(spark, sf_dir).data.drop(S.SOURCE_FILE)).select(*_SALES_OUT)


@register("required_columns")
def q_required(spark, sf_dir):
    rejected = _loaded(spark, sf_dir).rejected
    return rejected.select(FX.raw_kind(F.col("file")).alias("kind"), "missing").distinct()


@register("lineage")
def q_lineage(spark, sf_dir):
    """Rows by kind of raw file; every row names a file that exists."""
    parts = [CSV.with_lineage(CSV.scan_csv(spark, path)).select(S.SOURCE_FILE, FX.raw_kind(F.col("_metadata.file_path")).alias("kind"))
             for path in _raw(spark, sf_dir, "sales_a", "sales_b")]
    rows = parts[0].unionByName(parts[1])
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"),
                                    F.count_if(F.col(S.SOURCE_FILE).endswith(".csv")).cast("long").alias("with_file"))


@register("drop_empty_rows")
def q_drop_empty(spark, sf_dir):
    return I.empty_row_counts(_sales_texts(spark, sf_dir))


@register("dedup_rows")
def q_dedup(spark, sf_dir):
    """All sales, those of quantity 1 twice, without the copies."""
    rows = _prep(spark, sf_dir).select(*_SALES_OUT)
    again = F.when(F.col(S.QUANTITY) == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return I.dedup_rows(rows.withColumn("_n", F.explode(again)).drop("_n"))


@register("append_dedup")
def q_append(spark, sf_dir):
    """The first kind of files is stored; both kinds (one with a further column) are appended to the indexed table."""
    a, b = _raw(spark, sf_dir, "sales_a", "sales_b")
    base = ST.table_path(spark, "appended_sales", FX.data_key(spark, sf_dir))
    with ST._LOCK:
        if not ST.path_exists(spark, f"{base}/_SUCCESS"):  # batches replace themselves, so both are written again
            ST.append_indexed(I.clean_sales(CSV.scan_csv(spark, a)), f"{base}/table", "first")
            ST.append_indexed(I.clean_sales(CSV.load_many(spark, [a, b]).data.drop(S.SOURCE_FILE)), f"{base}/table", "second")
            spark.range(0).write.mode("append").parquet(base)
    return ST.read_indexed(spark, f"{base}/table").select(*_SALES_OUT, "Note")


@register("sink_csv")
def q_sink_csv(spark, sf_dir):
    path = ST.table_path(spark, "export_rollup", FX.data_key(spark, sf_dir))
    ST.materialized_files(spark, path, lambda: SM.display_table(_report(spark, sf_dir).rollup), fmt="csv")
    return CSV.scan_csv(spark, path)


@register("map_headers")
def q_map_headers(spark, sf_dir):
    """Both kinds of forecast files with their free-form headers mapped to the target names (values as read)."""
    a, b = (FC.map_headers(CSV.scan_csv(spark, path)) for path in _raw(spark, sf_dir, "forecast_a", "forecast_b"))
    return a.unionByName(b, allowMissingColumns=True)


@register("clean_forecast")
def q_clean_forecast(spark, sf_dir):
    """Both kinds cleaned (bad dates and quantities dropped); the second has no end date."""
    a, b = (FC.clean_forecast(CSV.with_load_order(CSV.scan_csv(spark, path))) for path in _raw(spark, sf_dir, "forecast_a", "forecast_b"))
    return a.unionByName(b, allowMissingColumns=True).select(*_FORECAST_OUT, "Store")


_FORECAST_OUT = [S.DESCRIPTION, S.START_DATE, S.END_DATE, S.FORECAST_QTY, S.DURATION_DAYS]


@register("load_forecasts")
def q_load_forecasts(spark, sf_dir):
    """Three kinds of forecast files: two loaded without duplicates, one rejected."""
    loaded, _ = FC.load_forecasts(spark, _raw(spark, sf_dir, "forecast_a", "forecast_b", "forecast_c"))
    return loaded.select(*_FORECAST_OUT, "Store")


@register("forecast_rejects")
def q_forecast_rejects(spark, sf_dir):
    _, rejected = FC.load_forecasts(spark, _raw(spark, sf_dir, "forecast_a", "forecast_b", "forecast_c"))
    return rejected.select(FX.raw_kind(F.col("file")).alias("kind"), "missing").distinct()


@register("preview")
def q_preview(spark, sf_dir):
    return I.preview(_prep(spark, sf_dir), S.ROW_ORDER, 100)


@register("bad_dates")
def q_bad_dates(spark, sf_dir):
    return I.bad_dates(_orders_text(spark, sf_dir), "Order", 3).select("Order", S.SALES_DATE)


@register("parse_dates")
def q_parse_dates(spark, sf_dir):
    df = _orders_text(spark, sf_dir)
    return df.select("Order", F.col(S.SALES_DATE).alias("date_text"), C.parse_date(F.col(S.SALES_DATE)).alias("parsed"))


@register("num_or_zero")
def q_num_or_zero(spark, sf_dir):
    df = _orders_text(spark, sf_dir)
    return df.select("Order", C.num_or_zero(F.col(S.NET_SALES)).alias("value"))


@register("num_or_null")
def q_num_or_null(spark, sf_dir):
    df = _orders_text(spark, sf_dir)
    return df.select("Order", C.num_or_null(F.col(S.NET_SALES)).alias("value"))


@register("date_quality")
def q_date_quality(spark, sf_dir):
    return I.date_quality(_orders_text(spark, sf_dir))


@register("materialize")
def q_materialize(spark, sf_dir):
    """Valid promotions from saved baselines and facts, made from the cells of one batch for each year of sales."""
    prep, key = _prep(spark, sf_dir), FX.data_key(spark, sf_dir)
    base = ST.table_path(spark, "cells", key)
    with ST._LOCK:
        for row in prep.select(S.YEAR).distinct().orderBy(S.YEAR).collect():  # the folders of the saved table
            year = row[S.YEAR]
            if not ST.path_exists(spark, f"{base}/batch={year}/_SUCCESS"):
                PT.append_cells(prep.where(F.col(S.YEAR) == year), base, str(year))
    return R.summary_report_from_cells(PT.read_cells(spark, base), S.Filters(), key).valid


# ---------------------------------------------------------------- streaming ingest


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Three kinds of files with different headers ingested by the stream (run to completion), read back."""
    key = FX.data_key(spark, sf_dir)
    table = ST.table_path(spark, "stream_sales", key)
    with ST._LOCK:
        if not ST.path_exists(spark, f"{table}_done"):
            for n, src in enumerate(_raw(spark, sf_dir, "sales_a", "sales_b", "sales_c")):
                STREAM.start_sales_ingest(spark, src, f"{table}/kind={n}", f"{table}_ckpt/{n}").awaitTermination()
            spark.createDataFrame([("ok",)], "s string").write.mode("overwrite").text(f"{table}_done")
    a, b = (STREAM.read_ingested(spark, f"{table}/kind={n}") for n in (0, 1))
    return a.unionByName(b, allowMissingColumns=True).select(*_SALES_OUT).distinct()
