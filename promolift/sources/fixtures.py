"""Adapters that turn the given TPC-H-like Parquet tables into this library's inputs.

* ``sales_table``: one sales record per line item (region, segment as PSA, part
  type as sub category, discount band as the promotion, brand-size as article).
* ``forecast_table``: one forecast per part, its description naming the
  article for most part types, so a forecast is found by text search.
* ``dirty_orders``: order dates and prices written as text in mixed layouts,
  the raw material of the cleaning rules.

Only the needed columns are read, so the Parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def article_of(brand, size):
    """Article id of a part: ``<brand>-<size>``."""
    return F.concat(brand, F.lit("-"), size.cast("string"))


# Version of the adapters; part of the key of every table saved from them.
ADAPTER_VERSION = "4"


def row_order_of(order, line, part, supp):
    """Load order of a line item: (order, line, part, supplier), unique together.

    A struct compares field by field, so keys of any size keep their order.
    """
    return F.struct(order.cast("long").alias("order"), line.cast("long").alias("line"),
                    part.cast("long").alias("part"), supp.cast("long").alias("supp"))


def sales_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales records in the cleaned sales schema, plus ``row_order`` (load order).

    Line items are shuffled twice, by order and by part; customers meet the orders, which are fewer. Tables that
    grow with the input are merged and never sent through the driver, whatever their estimated size.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    buyers = (cu.join(na, cu.c_nationkey == na.n_nationkey).join(rg, F.col("n_regionkey") == rg.r_regionkey)
              .select("c_custkey", "c_mktsegment", "r_name"))
    ordered = (od.join(buyers.hint("merge"), od.o_custkey == F.col("c_custkey"))
               .select("o_orderkey", "c_mktsegment", "r_name"))
    joined = (li.join(ordered.hint("merge"), li.l_orderkey == F.col("o_orderkey"))
              .join(pt.hint("merge"), F.col("l_partkey") == pt.p_partkey))
    disc = F.col("l_discount")
    return joined.select(
        F.col("r_name").alias(S.REGION),
        F.col("c_mktsegment").alias(S.PSA),
        F.col("p_type").alias(S.SUBCAT),
        F.when(disc >= 0.08, F.lit("BB-DEEP")).when(disc >= 0.06, F.lit("BB-STD")).alias(S.BONUS_BUY),
        F.to_date("l_shipdate").alias(S.SALES_DATE),
        F.when(disc >= 0.06, F.lit("PROMO")).otherwise(F.lit(S.NON_PROMO)).alias(S.STATUS),
        article_of(F.col("p_brand"), F.col("p_size")).alias(S.ARTICLE),
        (F.col("l_extendedprice") * (1 - disc)).cast("double").alias(S.NET_SALES),
        F.col("l_quantity").cast("double").alias(S.QUANTITY),
        row_order_of(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
                     F.col("l_suppkey")).alias(S.ROW_ORDER),
    )


def saved_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales_table``, joined once per input for all that is made of it (prepared table, raw files) and read back."""
    from promolift.sources import store
    return store.materialized(spark, "sales_rows", data_key(spark, sf_dir), lambda: sales_table(spark, sf_dir),
                              writer=lambda df, path: store.write_parquet(df, path, mode="overwrite"))


def forecast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned forecasts: one per part, ``row_order`` = part key (load order).

    STANDARD parts carry a description without an article; PROMO parts a
    zero quantity; a size that is a multiple of 14 ends the day before it
    starts (duration 0).
    """
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_type", "p_retailprice")
    start = F.date_add(F.lit("1997-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int"))
    end = F.date_add(start, (F.col("p_size") % 14 - 1).cast("int"))
    desc = F.when(F.col("p_type") == "STANDARD", F.concat(F.lit("Item "), F.col("p_name"))) \
        .otherwise(F.concat(F.lit("Item "), article_of(F.col("p_brand"), F.col("p_size")),
                            F.lit(" "), F.col("p_name")))
    qty = F.when(F.col("p_type") == "PROMO", F.lit(0.0)).otherwise(F.col("p_retailprice") / 10)
    return pt.select(
        F.col("p_partkey").cast("long").alias(S.ROW_ORDER),
        desc.alias(S.DESCRIPTION),
        start.alias(S.START_DATE),
        end.alias(S.END_DATE),
        qty.cast("double").alias(S.FORECAST_QTY),
        (F.datediff(end, start) + 1).cast("int").alias(S.DURATION_DAYS),
    )


# Text layouts of the dirty-date adapter, chosen by key % 9.
DIRTY_DATE_LAYOUTS = [
    "d/M/yyyy", "dd-MM-yyyy", "dd.MM.yyyy' 00:00:00'", "yyyy-MM-dd", "MM/dd/yyyy",
    "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd",
]
BAD_DATE_TEXT = "unknown"


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with ``date_text`` and ``price_text`` as a raw file would have them."""
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey") % (len(DIRTY_DATE_LAYOUTS) + 1)
    date_text = F.lit(BAD_DATE_TEXT)
    for i in reversed(range(len(DIRTY_DATE_LAYOUTS))):
        date_text = F.when(k == i, F.date_format("o_orderdate", DIRTY_DATE_LAYOUTS[i])).otherwise(date_text)
    price_text = (F.when(F.col("o_orderkey") % 11 == 0, F.lit("n/a"))
                  .when(F.col("o_orderkey") % 13 == 0, F.format_string("%,.2f", "o_totalprice"))
                  .otherwise(F.col("o_totalprice").cast("string")))
    return od.select(
        F.col("o_orderkey"),
        date_text.alias("date_text"),
        price_text.alias("price_text"),
        F.col("o_orderstatus").alias("status_text"),
    )


# ---------------------------------------------------------------- raw files

# Free-form forecast headers, as two kinds of forecast files carry
# them. The first kind also has a store; the second has no end date.
FORECAST_HEADERS_A = {S.DESCRIPTION: "Item Desc.", S.START_DATE: "Start Date", S.END_DATE: "End Date",
                      S.FORECAST_QTY: "Revised Ttl Fcst Qty"}
FORECAST_HEADERS_B = {S.DESCRIPTION: "Description", S.START_DATE: "Promo-Date", S.FORECAST_QTY: "Total Forecast"}

# Regions before this name are in the first kind of sales files, all others in the second.
SECOND_KIND_FROM = "ASIA"


def _raw_sales_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text dates day first; rows of quantity 1 twice; one empty line per pending order."""
    rows = saved_sales(spark, sf_dir).where(F.col(S.REGION) < SECOND_KIND_FROM)
    text = rows.select(*[F.date_format(S.SALES_DATE, "dd/MM/yyyy").alias(c) if c == S.SALES_DATE
                         else F.col(f"`{c}`").cast("string").alias(c) for c in S.REQUIRED_SALES])
    again = F.when(F.col(S.QUANTITY) == "1.0", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    twice = text.withColumn("_n", F.explode(again)).drop("_n")
    pending = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    empty = pending.select(*[F.lit(None).cast("string").alias(c) for c in S.REQUIRED_SALES])
    return twice.unionByName(empty)


def _raw_sales_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other column order, blanks around the headers, lower-case status, ISO dates, an extra column."""
    rows = saved_sales(spark, sf_dir).where(F.col(S.REGION) >= SECOND_KIND_FROM)
    order = [S.ARTICLE, S.SALES_DATE, S.REGION, S.STATUS, S.BONUS_BUY, S.NET_SALES, S.QUANTITY, S.SUBCAT, S.PSA]
    return rows.select(*[
        (F.date_format(S.SALES_DATE, "yyyy-MM-dd") if c == S.SALES_DATE
         else F.lower(S.STATUS) if c == S.STATUS
         else F.col(f"`{c}`").cast("string")).alias(f" {c} ") for c in order], F.lit("x").alias("Note"))


def _raw_sales_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No PSA column, so these files are rejected (their rows are in the other files too)."""
    rows = saved_sales(spark, sf_dir).where(F.col(S.QUANTITY) == 50)
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in S.REQUIRED_SALES if c != S.PSA])


def _forecast_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts as text; every 10th start date and every 17th quantity is no date and no number."""
    fc = forecast_table(spark, sf_dir)
    key = F.col(S.ROW_ORDER)
    return fc.select(
        key.alias("key"), F.col(S.DESCRIPTION),
        F.when(key % 10 == 7, F.lit("soon")).otherwise(F.date_format(S.START_DATE, "dd/MM/yyyy")).alias(S.START_DATE),
        F.date_format(S.END_DATE, "dd/MM/yyyy").alias(S.END_DATE),
        F.when(key % 17 == 3, F.lit("n/a")).otherwise(F.col(S.FORECAST_QTY).cast("string")).alias(S.FORECAST_QTY))


def _raw_forecast_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per store 1 and 2: rows that differ in the store alone."""
    rows = _forecast_text(spark, sf_dir).where(F.col("key") % 5 != 0)
    return rows.select(*[F.col(c).alias(h) for c, h in FORECAST_HEADERS_A.items()],
                       F.explode(F.array(F.lit("1"), F.lit("2"))).alias("Store"))


def _raw_forecast_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row twice, without an end date."""
    rows = _forecast_text(spark, sf_dir).where(F.col("key") % 5 == 0)
    return rows.select(*[F.col(c).alias(h) for c, h in FORECAST_HEADERS_B.items()],
                       F.explode(F.array(F.lit(1), F.lit(2))).alias("_n")).drop("_n")


def _raw_forecast_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No quantity, so these files are rejected."""
    rows = _forecast_text(spark, sf_dir).where(F.col("key") % 9 == 0)
    return rows.select(F.col(S.DESCRIPTION).alias("Desc"), F.col(S.START_DATE).alias("Start Date"))


def _raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("Order"), F.col("date_text").alias(S.SALES_DATE),
        F.col("price_text").alias(S.NET_SALES), F.col("status_text").alias(S.STATUS))


RAW = {"sales_a": _raw_sales_a, "sales_b": _raw_sales_b, "sales_c": _raw_sales_c, "forecast_a": _raw_forecast_a,
       "forecast_b": _raw_forecast_b, "forecast_c": _raw_forecast_c, "orders": _raw_orders}


def data_key(spark: SparkSession, sf_dir: str) -> str:
    """Key of tables saved from ``sf_dir``: the folder, the adapters' version, and its files' names, sizes and times."""
    from promolift.sources.store import files_version
    return f"{sf_dir.rstrip('/')}|v{ADAPTER_VERSION}|{files_version(spark, sf_dir)}"


def raw_files(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of raw CSV files of one kind, written once per input (shared work folder) by parallel tasks."""
    from promolift.sources import store
    path = store.table_path(spark, f"raw_{name}", data_key(spark, sf_dir))
    return store.materialized_files(spark, path, lambda: RAW[name](spark, sf_dir), fmt="csv")


def raw_kind(file):
    """Kind of raw file (``sales_a``, ...) from a file's path."""
    return F.regexp_extract(file, r"raw_([a-z]+_?[a-z]?)-[0-9a-f]+/[^/]*$", 1)
