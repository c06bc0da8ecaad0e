"""Independent SQL (DuckDB dialect) for every registered query, for checking.

Written from the rules, not from the Spark code: clean days by NOT EXISTS,
the first forecast by ``row_number()``, quantiles by ``quantile_cont``. The
views ``region nation customer supplier part orders lineitem ...`` are the
given Parquet tables. Sums of money, quantities and ratios round no addend
and do not depend on the order of rows (``_plain``).
"""

from __future__ import annotations

import re

from promolift.plans import catalog


def _plain(sql: str) -> str:
    """Spell out ``sum`` and ``avg`` of measured columns: whole parts as integers plus the rest as decimals, no addend rounded."""
    measured = ("Net Sales|Sales Quantity|PromoSales|PromoQuantity|BaselineSales|Total_Sales|Baseline|Uplift|Forecast_Qty"
                "|Uplift_Pct|Forecast_Accuracy|Uplift_Numeric|Avg_PromoDays|Duration")

    def total(x: str, rest: str = "") -> str:
        return (f"(CAST(sum(CAST(trunc({x}) AS HUGEINT)){rest} AS DOUBLE)"
                f" + CAST(sum(CAST({x} - trunc({x}) AS DECIMAL(38, 20))){rest} AS DOUBLE))")
    column = rf'((?:[a-z]+\.)?"(?:{measured})")'
    sql = re.sub(rf"\bavg\({column}\)", lambda m: f"({total(m[1])} / nullif(count({m[1]}), 0))", sql)
    return re.sub(rf"\bsum\({column}\)( FILTER \([^)]*\))?", lambda m: total(m[1], m[2] or ""), sql)


PROMO = "\"Promotion Status\" <> 'NON-PROMO'"

UPLIFT_VERDICT = """CASE WHEN {u} IS NULL OR isnan({u}) THEN 'Insufficient Data'
  WHEN {u} > 0.3 THEN 'Strong Success' WHEN {u} > 0.1 THEN 'Positive Impact'
  WHEN {u} > -0.05 THEN 'Neutral/Breakeven' WHEN {u} > -0.2 THEN 'Needs Adjustment'
  ELSE 'Significant Loss' END"""

FORECAST_VERDICT = """CASE WHEN {a} IS NULL OR isnan({a}) THEN 'No Forecast'
  WHEN abs({a}) <= 0.1 THEN 'Excellent Forecast' WHEN abs({a}) <= 0.25 THEN 'Good Forecast'
  WHEN abs({a}) <= 0.5 THEN 'Fair Forecast' WHEN {a} > 0.5 THEN 'Over-Forecast'
  ELSE 'Under-Forecast' END"""

CONFIDENCE = """CASE WHEN {d} >= 7 AND {b} / {d} >= 20 THEN 'High'
  WHEN {d} >= 3 AND {b} / {d} >= 10 THEN 'Medium' ELSE 'Low' END"""


def pct(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' ELSE printf('%+.1f%%', round({x} * 100.0, 1)) END"


def money(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' ELSE '$' || format('{{:,.0f}}', round({x})) END"


def qty(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' ELSE format('{{:,.0f}}', round({x})) END"


CTES = f"""
sales AS (
  SELECT r_name AS "Region", c_mktsegment AS "PSA", p_type AS "Sub Category",
         CASE WHEN l_discount >= 0.08 THEN 'BB-DEEP' WHEN l_discount >= 0.06 THEN 'BB-STD' END AS "Bonus Buy",
         CAST(l_shipdate AS DATE) AS "Sales Date",
         CASE WHEN l_discount >= 0.06 THEN 'PROMO' ELSE 'NON-PROMO' END AS "Promotion Status",
         p_brand || '-' || CAST(p_size AS VARCHAR) AS "Article",
         CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) AS "Net Sales",
         CAST(l_quantity AS DOUBLE) AS "Sales Quantity",
         CAST(l_orderkey AS BIGINT) AS load_order, CAST(l_linenumber AS BIGINT) AS load_line,
         CAST(l_partkey AS BIGINT) AS load_part, CAST(l_suppkey AS BIGINT) AS load_supp
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey),
fc AS (
  SELECT CAST(p_partkey AS BIGINT) AS row_order,
         CASE WHEN p_type = 'STANDARD' THEN 'Item ' || p_name
              ELSE 'Item ' || p_brand || '-' || CAST(p_size AS VARCHAR) || ' ' || p_name END AS "Description",
         CAST(DATE '1997-01-01' + CAST(p_partkey % 365 AS INTEGER) AS DATE) AS "Start_Date",
         CAST(DATE '1997-01-01' + CAST(p_partkey % 365 AS INTEGER) + CAST(p_size % 14 - 1 AS INTEGER) AS DATE)
           AS "End_Date",
         CAST(CASE WHEN p_type = 'PROMO' THEN 0 ELSE p_retailprice / 10 END AS DOUBLE) AS "Forecast_Qty",
         CAST(p_size % 14 AS INTEGER) AS "Duration_Days"
  FROM part),
pa AS (SELECT DISTINCT "Article" FROM sales WHERE {PROMO}),
fm AS (
  SELECT "Article", "Forecast_Qty", "Forecast_Daily_Qty", forecast_order FROM (
    SELECT pa."Article", fc."Forecast_Qty",
           CASE WHEN fc."Duration_Days" <> 0 THEN fc."Forecast_Qty" / fc."Duration_Days" END AS "Forecast_Daily_Qty",
           fc.row_order AS forecast_order,
           row_number() OVER (PARTITION BY pa."Article" ORDER BY fc.row_order) AS rn
    FROM pa JOIN fc ON position(pa."Article" IN fc."Description") > 0) t
  WHERE rn = 1),
prep AS (
  SELECT s.*, CAST(year(s."Sales Date") AS INTEGER) AS "Year", CAST(month(s."Sales Date") AS INTEGER) AS "Month",
         (s.{PROMO} AND fm."Article" IS NOT NULL) AS "Has_Forecast",
         CASE WHEN s.{PROMO} THEN fm."Forecast_Qty" END AS "Forecast_Qty",
         CASE WHEN s.{PROMO} THEN fm."Forecast_Daily_Qty" END AS "Forecast_Daily_Qty"
  FROM sales s LEFT JOIN fm ON s."Article" = fm."Article"),
pdates AS (SELECT DISTINCT "Article", "Sales Date" FROM prep WHERE {PROMO}),
clean AS (
  SELECT p.* FROM prep p
  WHERE p."Promotion Status" = 'NON-PROMO'
    AND NOT EXISTS (SELECT 1 FROM pdates d WHERE d."Article" = p."Article" AND d."Sales Date" = p."Sales Date")),
stats AS (
  SELECT a."Article", count(DISTINCT c."Sales Date") AS clean_days, sum(c."Net Sales") AS clean_sales
  FROM (SELECT DISTINCT "Article" FROM pdates) a LEFT JOIN clean c ON c."Article" = a."Article"
  GROUP BY a."Article"),
bl AS (
  SELECT "Article", clean_sales / clean_days AS "Daily_Avg", CAST(clean_days AS BIGINT) AS "Clean_Days"
  FROM stats WHERE clean_days >= 3),
ps AS (
  SELECT "Article", "Bonus Buy", "Region", "Sub Category", "PSA",
         sum("Net Sales") AS "PromoSales", sum("Sales Quantity") AS "PromoQuantity",
         count(DISTINCT "Sales Date") AS "PromoDays",
         bool_or("Has_Forecast") AS "Has_Forecast", max("Forecast_Qty") AS "Forecast_Qty",
         max("Forecast_Daily_Qty") AS "Forecast_Daily_Qty"
  FROM prep
  WHERE {PROMO} AND "Article" IS NOT NULL AND "Bonus Buy" IS NOT NULL AND "Region" IS NOT NULL
    AND "Sub Category" IS NOT NULL AND "PSA" IS NOT NULL
  GROUP BY "Article", "Bonus Buy", "Region", "Sub Category", "PSA"),
facts AS (
  SELECT ps.*, bl."Daily_Avg", bl."Daily_Avg" * ps."PromoDays" AS "BaselineSales",
         (ps."PromoSales" - bl."Daily_Avg" * ps."PromoDays") / NULLIF(bl."Daily_Avg" * ps."PromoDays", 0)
           AS "Uplift_Pct",
         CASE WHEN ps."Forecast_Qty" > 0 THEN (ps."PromoQuantity" - ps."Forecast_Qty") / ps."Forecast_Qty" END
           AS "Forecast_Accuracy"
  FROM ps JOIN bl ON ps."Article" = bl."Article"),
vp AS (
  SELECT f.*, {FORECAST_VERDICT.format(a='"Forecast_Accuracy"')} AS "Forecast_Interpretation",
         {UPLIFT_VERDICT.format(u='"Uplift_Pct"')} AS "Interpretation",
         {CONFIDENCE.format(d='"PromoDays"', b='"BaselineSales"')} AS "Confidence",
         {pct('"Uplift_Pct"')} AS "Uplift_Display",
         "PromoDays" AS "Duration"
  FROM facts f
  WHERE "PromoDays" >= 3 AND "BaselineSales" >= 100 AND "Uplift_Pct" IS NOT NULL),
ru0 AS (
  SELECT "Article", "Bonus Buy", sum("PromoSales") AS "PromoSales", sum("PromoQuantity") AS "PromoQuantity",
         sum("BaselineSales") AS "BaselineSales", avg("Duration") AS "Duration",
         max("Forecast_Qty") AS "Forecast_Qty", count(DISTINCT "Region") AS "Region"
  FROM vp GROUP BY "Article", "Bonus Buy"),
ru1 AS (
  SELECT *, ("PromoSales" - "BaselineSales") / NULLIF("BaselineSales", 0) AS "Uplift_Pct",
         CASE WHEN "Forecast_Qty" > 0 THEN ("PromoQuantity" - "Forecast_Qty") / "Forecast_Qty" END
           AS "Forecast_Accuracy"
  FROM ru0),
ru AS (
  SELECT *, {pct('"Uplift_Pct"')} AS "Uplift_Display",
         {pct('"Forecast_Accuracy"')} AS "Forecast_Accuracy_Display"
  FROM ru1),
ap AS (
  SELECT "Article", "Bonus Buy", "Region", sum("Net Sales") AS "PromoSales",
         sum("Sales Quantity") AS "PromoQuantity", count(DISTINCT "Sales Date") AS "PromoDays",
         avg("Net Sales") AS "AvgDailySales", avg("Sales Quantity") AS "AvgDailyQuantity",
         bool_or("Has_Forecast") AS "Has_Forecast", max("Forecast_Qty") AS "Forecast_Qty",
         max("Forecast_Daily_Qty") AS "Forecast_Daily_Qty"
  FROM prep
  WHERE {PROMO} AND "Article" IS NOT NULL AND "Bonus Buy" IS NOT NULL AND "Region" IS NOT NULL
  GROUP BY "Article", "Bonus Buy", "Region"),
rb AS (
  SELECT "Article", "Region", sum("Net Sales") AS "NonPromoSales",
         count(DISTINCT "Sales Date") AS "NonPromoDays", avg("Sales Quantity") AS "AvgQuantity",
         sum("Net Sales") / count(DISTINCT "Sales Date") AS "Daily_NonPromo_Avg"
  FROM clean WHERE "Article" IS NOT NULL AND "Region" IS NOT NULL
  GROUP BY "Article", "Region"),
au0 AS (
  SELECT ap.*, rb."Daily_NonPromo_Avg", rb."Daily_NonPromo_Avg" * ap."PromoDays" AS "Baseline"
  FROM ap LEFT JOIN rb ON ap."Article" = rb."Article" AND ap."Region" = rb."Region"
  WHERE ap."PromoDays" >= 2),
au AS (
  SELECT *, "PromoSales" - "Baseline" AS "Uplift",
         ("PromoSales" - "Baseline") / NULLIF("Baseline", 0) AS "Uplift_Pct",
         CASE WHEN "Forecast_Qty" > 0 THEN ("PromoQuantity" - "Forecast_Qty") / "Forecast_Qty" END
           AS "Forecast_Accuracy",
         {FORECAST_VERDICT.format(a='(CASE WHEN "Forecast_Qty" > 0 THEN ("PromoQuantity" - "Forecast_Qty") / "Forecast_Qty" END)')}
           AS "Forecast_Interpretation"
  FROM au0 WHERE "Baseline" >= 10),
pt0 AS (
  SELECT "Article", "Bonus Buy", sum("PromoSales") AS "Total_Sales", sum("PromoQuantity") AS "Total_Quantity",
         avg("PromoDays") AS "Avg_PromoDays", count(DISTINCT "Region") AS "Region_Count",
         sum("Baseline") AS "Baseline", sum("Uplift") AS "Uplift",
         max("Forecast_Qty") AS "Total_Forecast", avg("Forecast_Accuracy") AS "Forecast_Accuracy"
  FROM au GROUP BY "Article", "Bonus Buy"),
pt AS (
  SELECT *, "Uplift" / NULLIF("Baseline", 0) AS "Uplift_Pct",
         "Uplift" / NULLIF("Baseline", 0) * 100 AS "Uplift_Numeric",
         CASE WHEN "Baseline" = 0 THEN 'N/A' ELSE printf('%+.1f%%', round("Uplift" / "Baseline" * 100, 1)) END
           AS "Uplift_Display"
  FROM pt0),
med AS (
  SELECT "Article",
         quantile_cont("Total_Sales", 0.25) AS sales_q25, quantile_cont("Total_Sales", 0.5) AS median_sales,
         quantile_cont("Total_Sales", 0.75) AS sales_q75,
         quantile_cont("Total_Quantity", 0.25) AS qty_q25, quantile_cont("Total_Quantity", 0.5) AS median_quantity,
         quantile_cont("Total_Quantity", 0.75) AS qty_q75
  FROM pt GROUP BY "Article"),
dtext AS (
  SELECT o_orderkey AS "Order",
         CASE o_orderkey % 9
           WHEN 0 THEN strftime(o_orderdate, '%-d/%-m/%Y')
           WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y')
           WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') || ' 00:00:00'
           WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d')
           WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y')
           WHEN 5 THEN strftime(o_orderdate, '%Y/%m/%d')
           WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
           WHEN 7 THEN strftime(o_orderdate, '%Y%m%d')
           ELSE 'unknown' END AS date_text,
         CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price
  FROM orders),
dp AS (
  SELECT "Order", date_text, price, CAST(CASE
      WHEN regexp_full_match(s, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')
        THEN coalesce(try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%m/%d/%Y'))
      WHEN regexp_full_match(s, '[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}') THEN try_strptime(s, '%d-%m-%Y')
      WHEN regexp_full_match(s, '[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}') THEN try_strptime(s, '%d.%m.%Y')
      WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime(s, '%Y-%m-%d')
      WHEN regexp_full_match(s, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') THEN try_strptime(s, '%Y/%m/%d')
      WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?') THEN try_strptime(substr(s, 1, 10), '%Y-%m-%d')
      WHEN regexp_full_match(s, '[0-9]{{8}}') THEN try_strptime(s, '%Y%m%d')
    END AS DATE) AS parsed
  FROM (SELECT *, split_part(trim(date_text), ' ', 1) AS s FROM dtext) t),
loaded AS (
  SELECT DISTINCT "Region", "PSA", "Sub Category", "Bonus Buy", "Sales Date", "Promotion Status", "Article",
         "Net Sales", "Sales Quantity"
  FROM sales),
rawf AS (
  SELECT row_order AS k, "Description",
         CASE WHEN row_order % 10 = 7 THEN NULL ELSE "Start_Date" END AS s, "End_Date" AS e,
         CASE WHEN row_order % 17 = 3 THEN NULL ELSE "Forecast_Qty" END AS q
  FROM fc),
cleanf AS (
  SELECT "Description", s AS "Start_Date", e AS "End_Date", q AS "Forecast_Qty",
         CAST(e - s + 1 AS INTEGER) AS "Duration_Days", unnest(['1', '2']) AS "Store"
  FROM rawf WHERE k % 5 <> 0 AND s IS NOT NULL AND q IS NOT NULL
  UNION ALL
  SELECT "Description", s, s, q, CAST(1 AS INTEGER), unnest([NULL::VARCHAR, NULL])
  FROM rawf WHERE k % 5 = 0 AND s IS NOT NULL AND q IS NOT NULL)
"""

BODIES: dict[str, str] = {}

BODIES["overview"] = f"""
SELECT count(*) AS total_records,
       CAST(count(*) FILTER (WHERE {PROMO}) AS BIGINT) AS promo_records,
       CAST(count(*) FILTER (WHERE "Promotion Status" = 'NON-PROMO') AS BIGINT) AS nonpromo_records,
       count(DISTINCT "Article") AS unique_articles,
       CAST(count(*) FILTER (WHERE "Has_Forecast") AS BIGINT) AS forecast_matches
FROM prep"""

BODIES["promo_split"] = f"""
SELECT ({PROMO}) AS is_promo, count(*) AS records, sum("Net Sales") AS sales
FROM prep GROUP BY 1"""

_PROMO_VIEW = """SELECT "Article", "Bonus Buy", "Region", "Sales Date", "Net Sales", "Sales Quantity", "Promotion Status",
       "Sub Category" FROM prep"""
# Promo rows are what is left of all rows without the others.
BODIES["promo_data"] = f"""{_PROMO_VIEW} EXCEPT ALL {_PROMO_VIEW} WHERE "Promotion Status" = 'NON-PROMO'"""

BODIES["nonpromo_data"] = """
SELECT "Article", "Region", "Sales Date", "Net Sales" FROM prep WHERE "Promotion Status" = 'NON-PROMO'"""

BODIES["filter_sales"] = f"""
SELECT count(*) AS total_records,
       CAST(count(*) FILTER (WHERE {PROMO}) AS BIGINT) AS promo_records,
       CAST(count(*) FILTER (WHERE "Promotion Status" = 'NON-PROMO') AS BIGINT) AS nonpromo_records,
       count(DISTINCT "Article") AS unique_articles,
       CAST(count(*) FILTER (WHERE "Has_Forecast") AS BIGINT) AS forecast_matches,
       CAST(1996 AS INTEGER) AS year
FROM prep WHERE "Year" = 1996"""

BODIES["region_scope"] = f"""
SELECT "Region", count(*) AS promo_rows, sum("Net Sales") AS "PromoSales"
FROM prep WHERE {PROMO} AND "Region" = 'EUROPE' GROUP BY "Region" """

BODIES["promo_regions"] = f"""
SELECT "Region", count(*) AS promo_rows FROM prep WHERE {PROMO} AND "Region" IS NOT NULL GROUP BY "Region" """

BODIES["prepare"] = "SELECT * FROM prep"

BODIES["no_forecast"] = """
SELECT load_order, load_line, load_part, load_supp, "Article", "Net Sales", CAST(year("Sales Date") AS INTEGER) AS "Year",
       CAST(month("Sales Date") AS INTEGER) AS "Month", false AS "Has_Forecast",
       CAST(NULL AS DOUBLE) AS "Forecast_Qty", CAST(NULL AS DOUBLE) AS "Forecast_Daily_Qty"
FROM sales"""

BODIES["norm_status"] = """
SELECT status, count(*) AS rows, CAST(count(*) FILTER (WHERE status <> 'NON-PROMO') AS BIGINT) AS promo_rows
FROM (SELECT coalesce(upper(CASE WHEN o_orderstatus = 'P' THEN NULL
                                 WHEN o_orderpriority LIKE '5%' THEN 'non-promo'
                                 ELSE lower(o_orderpriority) END), 'NAN') AS status
      FROM orders) t
GROUP BY status"""

BODIES["baselines"] = "SELECT * FROM bl"

BODIES["baseline_totals"] = """
SELECT CAST(CASE WHEN count(*) FILTER (WHERE clean_days >= 3) > 0 THEN sum(clean_days) ELSE 0 END AS BIGINT)
         AS total_clean_days,
       CAST(count(*) FILTER (WHERE clean_days >= 3) AS BIGINT) AS valid_articles
FROM stats"""

BODIES["clean_days"] = """
SELECT load_order, load_line, load_part, load_supp, "Article", "Region", "Sales Date", "Net Sales" FROM clean"""

BODIES["region_baselines"] = "SELECT * FROM rb"

BODIES["article_daily_avg"] = """
SELECT "Article", sum("Net Sales") / greatest(count(DISTINCT "Sales Date"), 1) AS overall_daily_avg
FROM clean WHERE "Article" IS NOT NULL GROUP BY "Article" """

BODIES["promo_summary"] = """
SELECT "Article", "Bonus Buy", "Region", "Sub Category", "PSA", "PromoSales", "PromoQuantity", "PromoDays" FROM ps"""

BODIES["promo_forecast"] = """
SELECT "Article", "Bonus Buy", "Region", "Sub Category", "PSA", "Has_Forecast", "Forecast_Qty",
       "Forecast_Daily_Qty" FROM ps"""

BODIES["analyze_promotions"] = "SELECT * FROM vp"

BODIES["forecast_coverage"] = """
SELECT count(*) AS valid_promos, avg(CASE WHEN "Has_Forecast" THEN 1.0 ELSE 0.0 END) AS forecast_coverage FROM vp"""

BODIES["min_days_refilter"] = """
SELECT CAST(count(*) FILTER (WHERE "Duration" >= 7) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE "Duration" < 7) AS BIGINT) AS removed,
       CAST(7 AS INTEGER) AS min_days
FROM vp"""

BODIES["promo_rollup"] = "SELECT * FROM ru"

BODIES["top_promos"] = """SELECT * FROM ru ORDER BY "Uplift_Pct" DESC, "Article", "Bonus Buy" LIMIT 20"""

BODIES["bottom_promos"] = """SELECT * FROM ru ORDER BY "Uplift_Pct" ASC, "Article" DESC, "Bonus Buy" DESC LIMIT 20"""

_KPI = """
SELECT avg("Uplift_Pct") * 100 AS avg_uplift_pct,
       (sum("PromoSales") - sum("BaselineSales")) / 1000 AS total_uplift_k,
       avg("Duration") AS avg_duration, sum("PromoSales") AS total_sales, count(*) AS promotions,
       avg("Forecast_Accuracy") * 100 AS forecast_accuracy_pct,
       printf('%+.1f%%', round(avg("Uplift_Pct") * 100, 1)) AS avg_uplift_display,
       '$' || format('{{:,.0f}}', round((sum("PromoSales") - sum("BaselineSales")) / 1000)) || 'K'
         AS total_uplift_display,
       printf('%.1f days', round(avg("Duration"), 1)) AS avg_duration_display,
       CASE WHEN avg("Forecast_Accuracy") IS NULL THEN 'N/A'
            ELSE printf('%+.1f%%', round(avg("Forecast_Accuracy") * 100, 1)) END AS forecast_accuracy_display
FROM ({inner}) t"""
BODIES["top_kpis"] = _KPI.format(inner=BODIES["top_promos"])
BODIES["bottom_kpis"] = _KPI.format(inner=BODIES["bottom_promos"])

BODIES["strategy"] = f"""
SELECT "Interpretation", count("Bonus Buy") AS "Count", avg("Uplift_Pct") AS "Avg_Uplift",
       sum("PromoSales") AS "Total_Sales", sum("BaselineSales") AS "Total_Baseline",
       CAST(sum("Region") AS BIGINT) AS "Total_Regions", avg("Duration") AS "Avg_Duration",
       sum("PromoSales") - sum("BaselineSales") AS "Total_Uplift",
       CASE "Interpretation" WHEN 'Strong Success' THEN 'Scale mechanics, repeat in similar articles'
                             WHEN 'Significant Loss' THEN 'Stop immediately, analyze root causes' END AS "Action"
FROM (SELECT *, {UPLIFT_VERDICT.format(u='"Uplift_Pct"')} AS "Interpretation" FROM ru) t
GROUP BY "Interpretation" ORDER BY "Count" DESC, "Interpretation" """

BODIES["verdict_detail"] = f"""
SELECT *, row_number() OVER (PARTITION BY "Interpretation" ORDER BY
         CASE "Interpretation" WHEN 'Significant Loss' THEN -"Uplift_Pct" ELSE "Uplift_Pct" END DESC NULLS LAST,
         CASE WHEN "Interpretation" <> 'Significant Loss' THEN "Article" END, CASE WHEN "Interpretation" <> 'Significant Loss' THEN "Bonus Buy" END,
         "Article" DESC, "Bonus Buy" DESC) AS "Rank"
FROM (SELECT *, {UPLIFT_VERDICT.format(u='"Uplift_Pct"')} AS "Interpretation" FROM ru) t"""

BODIES["display_table"] = f"""
SELECT "Article" AS "Article", "Bonus Buy" AS "Promotion", {money('"PromoSales"')} AS "Promo Sales",
       {money('"BaselineSales"')} AS "Baseline", {qty('"PromoQuantity"')} AS "Promo Qty",
       {qty('"Forecast_Qty"')} AS "Forecast Qty", "Uplift_Display" AS "Uplift %", "Duration" AS "Duration (Days)",
       "Region" AS "Regions Count", "Forecast_Accuracy_Display" AS "Forecast Accuracy",
       round("Uplift_Pct" * 100, 1) AS uplift_sort
FROM ru"""

BODIES["display_lowest"] = f"""
SELECT *, CAST(row_number() OVER (ORDER BY uplift_sort NULLS LAST, "Article", "Promotion") AS INTEGER) AS "Rank"
FROM ({BODIES["display_table"].replace("FROM ru", "FROM (" + BODIES["bottom_promos"] + ") low")}) d"""

BODIES["uplift_verdict"] = f"""
SELECT {UPLIFT_VERDICT.format(u='"Uplift_Pct"')} AS "Interpretation", count(*) AS promotions FROM facts GROUP BY 1"""

BODIES["confidence"] = f"""
SELECT {CONFIDENCE.format(d='"PromoDays"', b='"BaselineSales"')} AS "Confidence", count(*) AS promotions
FROM facts GROUP BY 1"""

BODIES["forecast_verdict"] = f"""
SELECT {FORECAST_VERDICT.format(a='"Forecast_Accuracy"')} AS "Forecast_Interpretation", count(*) AS promotions
FROM facts GROUP BY 1"""

BODIES["forecast_accuracy"] = """
SELECT "Article", "Bonus Buy", "Region", "Sub Category", "PSA", "PromoQuantity", "Forecast_Qty",
       CASE WHEN "Forecast_Qty" > 0 THEN ("PromoQuantity" - "Forecast_Qty") / "Forecast_Qty" END AS "Forecast_Accuracy"
FROM ps"""

BODIES["forecast_match"] = "SELECT * FROM fm"

BODIES["forecast_match_token"] = """
SELECT "Article", "Forecast_Qty", "Forecast_Daily_Qty", forecast_order FROM (
  SELECT pa."Article", t."Forecast_Qty",
         CASE WHEN t."Duration_Days" <> 0 THEN t."Forecast_Qty" / t."Duration_Days" END AS "Forecast_Daily_Qty",
         t.row_order AS forecast_order,
         row_number() OVER (PARTITION BY pa."Article" ORDER BY t.row_order) AS rn
  FROM pa JOIN (SELECT DISTINCT row_order, "Forecast_Qty", "Duration_Days",
                       unnest(string_split_regex("Description", '\\s+')) AS tok FROM fc) t
    ON t.tok = pa."Article") x
WHERE rn = 1"""

BODIES["forecast_match_regex"] = """
SELECT "Article", "Forecast_Qty", "Forecast_Daily_Qty", forecast_order FROM (
  SELECT a."Article", fc."Forecast_Qty",
         CASE WHEN fc."Duration_Days" <> 0 THEN fc."Forecast_Qty" / fc."Duration_Days" END AS "Forecast_Daily_Qty",
         fc.row_order AS forecast_order, row_number() OVER (PARTITION BY a."Article" ORDER BY fc.row_order) AS rn
  FROM (SELECT regexp_replace("Article", '-7$', '-[7]( |$)') AS "Article" FROM pa) a
  JOIN fc ON regexp_matches(fc."Description", a."Article")) t
WHERE rn = 1"""

BODIES["forecast_stats"] = """
SELECT count(*) AS total_forecasts, count(DISTINCT "Description") AS unique_descriptions,
       min("Start_Date") AS min_start_date, max("Start_Date") AS max_start_date,
       avg("Forecast_Qty") AS avg_forecast_qty, sum("Forecast_Qty") AS total_forecast_qty
FROM fc"""

BODIES["profile"] = """
SELECT count(*) AS rows, CAST(15 AS INTEGER) AS columns, count(DISTINCT "Article") AS articles,
       count(DISTINCT "Region") AS regions, min("Sales Date") AS min_date, max("Sales Date") AS max_date,
       count("Sales Date") AS valid_dates, CAST(count(*) FILTER (WHERE "Sales Date" IS NULL) AS BIGINT) AS invalid_dates
FROM prep"""

BODIES["filter_options"] = """
SELECT DISTINCT * FROM (
  SELECT 'Year' AS filter, CAST("Year" AS VARCHAR) AS value FROM prep
  UNION ALL SELECT 'Month', CAST("Month" AS VARCHAR) FROM prep
  UNION ALL SELECT 'Sub Category', "Sub Category" FROM prep
  UNION ALL SELECT 'PSA', "PSA" FROM prep
  UNION ALL SELECT 'Region', "Region" FROM prep) t
WHERE value IS NOT NULL"""

_SIDES = f"""(SELECT "Article", count(*) AS n, count(*) FILTER ({PROMO}) AS n_promo, count(DISTINCT "Sales Date") AS days,
   min("Sales Date") AS d0, max("Sales Date") AS d1 FROM prep GROUP BY ALL)"""

BODIES["article_metrics"] = f"""
SELECT "Article", n AS total_rows, days AS unique_days, n_promo AS promo_count, n - n_promo AS nonpromo_count,
       d0 AS first_date, d1 AS last_date FROM {_SIDES}"""

BODIES["valid_articles"] = f"""
SELECT "Article", n AS total_rows FROM {_SIDES}
WHERE n_promo >= 2 AND n - n_promo >= 2
QUALIFY row_number() OVER (ORDER BY n DESC, "Article") <= 500"""

BODIES["article_list"] = f"""
SELECT "Article" FROM {_SIDES} WHERE n_promo >= 2 AND n - n_promo >= 2"""

BODIES["article_rows"] = """SELECT * FROM prep WHERE "Article" = 'Brand#1-1'"""

BODIES["article_kpis"] = f"""
SELECT k.*, CAST(coalesce(c.clean_days, 0) AS BIGINT) AS clean_days FROM (
  SELECT "Article",
         CAST(count(DISTINCT CASE WHEN {PROMO} THEN "Sales Date" END) AS BIGINT) AS promo_days,
         CAST(count(*) FILTER (WHERE {PROMO}) AS BIGINT) AS promo_records,
         coalesce(sum("Net Sales") FILTER (WHERE {PROMO}), 0) AS promo_sales,
         CAST(count(DISTINCT CASE WHEN "Promotion Status" = 'NON-PROMO' THEN "Sales Date" END) AS BIGINT)
           AS nonpromo_days,
         count(DISTINCT CASE WHEN {PROMO} THEN "Bonus Buy" END) AS promo_types
  FROM prep WHERE "Article" IS NOT NULL GROUP BY "Article"
  HAVING count(*) FILTER (WHERE {PROMO}) > 0) k
LEFT JOIN (SELECT "Article", count(DISTINCT "Sales Date") AS clean_days FROM clean GROUP BY "Article") c
  ON k."Article" = c."Article" """

BODIES["article_promos"] = "SELECT * FROM ap"

BODIES["article_uplift"] = "SELECT * FROM au"

BODIES["article_info"] = """
SELECT "Article", first("Sub Category" ORDER BY load_order, load_line, load_part, load_supp) AS "Sub Category",
       first("PSA" ORDER BY load_order, load_line, load_part, load_supp) AS "PSA",
       bool_or("Has_Forecast") AS "Has_Forecast"
FROM prep GROUP BY "Article" """

BODIES["promo_types"] = "SELECT * FROM pt"

BODIES["promo_details"] = f"""
SELECT "Article", "Bonus Buy" AS "Promotion", {money('"Total_Sales"')} AS "Promo Sales", "Total_Quantity" AS "Promo Quantity",
       "Avg_PromoDays" AS "Avg Duration", "Region_Count" AS "Regions", {money('"Baseline"')} AS "Expected Baseline",
       {money('"Uplift"')} AS "Uplift Amount", "Uplift_Display" AS "Uplift %", {qty('"Total_Forecast"')} AS "Forecast Qty",
       {pct('"Forecast_Accuracy"')} AS "Forecast Accuracy %",
       CAST(row_number() OVER (PARTITION BY "Article" ORDER BY "Uplift_Numeric" DESC NULLS LAST, "Bonus Buy") AS INTEGER) AS "Rank"
FROM pt"""

BODIES["effectiveness"] = """
SELECT t."Article", avg("Uplift_Numeric") AS avg_uplift_pct, count(*) AS num_types,
       avg(CASE WHEN "Uplift_Pct" > 0 THEN 1.0 ELSE 0.0 END) * 100 AS success_rate,
       avg("Avg_PromoDays") AS avg_duration, avg(t."Forecast_Accuracy") * 100 AS forecast_accuracy_pct,
       r.reliable_regions,
       CASE WHEN avg("Uplift_Numeric") >= 10 THEN 'PROMOTIONS ARE EFFECTIVE'
            WHEN avg("Uplift_Numeric") >= 0 THEN 'MIXED RESULTS' ELSE 'PROMOTIONS ARE INEFFECTIVE' END AS verdict
FROM pt t
LEFT JOIN (SELECT "Article", count(DISTINCT "Region") AS reliable_regions FROM au GROUP BY "Article") r
  ON t."Article" = r."Article"
GROUP BY t."Article", r.reliable_regions"""

BODIES["quartiles"] = """
SELECT "Article", round(sales_q25, 6) AS sales_q25, round(median_sales, 6) AS median_sales, round(sales_q75, 6) AS sales_q75,
       round(qty_q25, 6) AS qty_q25, round(median_quantity, 6) AS median_quantity, round(qty_q75, 6) AS qty_q75 FROM med"""

BODIES["quadrants"] = """
SELECT pt."Article", pt."Bonus Buy", "Total_Sales", "Total_Quantity", "Uplift_Pct",
       round(median_sales, 6) AS median_sales, round(median_quantity, 6) AS median_quantity,
       q || '' AS "Quadrant",
       CASE q WHEN 'High Volume, Low Value' THEN 'High quantity but low revenue - consider price optimization'
              WHEN 'High Volume, High Value' THEN 'Best performers - maximize distribution and repeat'
              WHEN 'Low Volume, Low Value' THEN 'Limited impact - consider discontinuing or testing new mechanics'
              WHEN 'Low Volume, High Value' THEN 'High value per unit - focus on premium positioning or targeting'
       END AS "Advice"
FROM (SELECT pt.*, med.median_sales, med.median_quantity,
             CASE WHEN "Total_Quantity" >= median_quantity THEN 'High Volume' ELSE 'Low Volume' END || ', ' ||
             CASE WHEN "Total_Sales" >= median_sales THEN 'High Value' ELSE 'Low Value' END AS q
      FROM pt JOIN med ON pt."Article" = med."Article") pt"""


BODIES["load_many"] = "SELECT * FROM loaded"

BODIES["append_dedup"] = """SELECT *, CASE WHEN "Region" >= 'ASIA' THEN 'x' END AS "Note" FROM loaded"""

BODIES["dedup_rows"] = """
SELECT DISTINCT "Region", "PSA", "Sub Category", "Bonus Buy", "Sales Date", "Promotion Status", "Article",
       "Net Sales", "Sales Quantity" FROM prep"""

_TEXTS = """
SELECT "Region", "PSA", "Sub Category", "Bonus Buy",
       CASE WHEN "Region" < 'ASIA' THEN strftime("Sales Date", '%d/%m/%Y') ELSE strftime("Sales Date", '%Y-%m-%d') END AS "Sales Date",
       CASE WHEN "Region" < 'ASIA' THEN "Promotion Status" ELSE lower("Promotion Status") END AS "Promotion Status",
       "Article", CAST("Net Sales" AS VARCHAR) AS "Net Sales", CAST("Sales Quantity" AS VARCHAR) AS "Sales Quantity",
       CASE WHEN "Region" >= 'ASIA' THEN 'x' END AS "Note"
FROM (SELECT * FROM sales UNION ALL SELECT * FROM sales WHERE "Region" < 'ASIA' AND "Sales Quantity" = 1) s
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'P'"""

BODIES["scan_csv"] = _TEXTS

BODIES["drop_empty_rows"] = f"""SELECT count(*) AS rows_read, count("Region") AS rows_kept FROM ({_TEXTS}) t"""

BODIES["lineage"] = f"""
SELECT CASE WHEN "Note" = 'x' THEN 'sales_b' ELSE 'sales_a' END AS kind, count(*) AS rows, count(*) AS with_file
FROM ({_TEXTS}) t GROUP BY 1"""

BODIES["required_columns"] = """
SELECT DISTINCT 'sales_c' AS kind, 'PSA' AS missing FROM sales WHERE "Sales Quantity" = 50"""

BODIES["sink_csv"] = "SELECT " + ", ".join(
    f"""nullif(CAST("{c}" AS VARCHAR), 'N/A') AS "{c}\"""" for c in (
        "Article", "Promotion", "Promo Sales", "Baseline", "Promo Qty", "Forecast Qty", "Uplift %", "Duration (Days)",
        "Regions Count", "Forecast Accuracy", "uplift_sort")) + f" FROM ({BODIES['display_table']}) d"

BODIES["map_headers"] = """
SELECT "Description", coalesce(strftime(s, '%d/%m/%Y'), 'soon') AS "Start_Date", strftime(e, '%d/%m/%Y') AS "End_Date",
       CAST(q AS VARCHAR) AS "Forecast_Qty", unnest(['1', '2']) AS "Store" FROM rawf WHERE k % 5 <> 0
UNION ALL
SELECT "Description", coalesce(strftime(s, '%d/%m/%Y'), 'soon'), NULL, CAST(q AS VARCHAR), unnest([NULL::VARCHAR, NULL])
FROM rawf WHERE k % 5 = 0"""

BODIES["clean_forecast"] = "SELECT * FROM cleanf"

BODIES["load_forecasts"] = "SELECT DISTINCT * FROM cleanf"

BODIES["forecast_rejects"] = "SELECT DISTINCT 'forecast_c' AS kind, 'Forecast_Qty' AS missing FROM rawf WHERE k % 9 = 0"

BODIES["preview"] = "SELECT * FROM prep ORDER BY load_order, load_line, load_part, load_supp LIMIT 100"

BODIES["bad_dates"] = """
SELECT "Order", date_text AS "Sales Date" FROM dp WHERE parsed IS NULL ORDER BY "Order" LIMIT 3"""

BODIES["parse_dates"] = """SELECT "Order", date_text, parsed FROM dp"""

BODIES["num_or_zero"] = """SELECT "Order", coalesce(price, 0.0) AS value FROM dp"""

BODIES["num_or_null"] = """SELECT "Order", price AS value FROM dp"""

BODIES["date_quality"] = """
SELECT count(*) AS rows, count(parsed) AS valid_dates,
       CAST(count(*) FILTER (WHERE parsed IS NULL) AS BIGINT) AS invalid_dates
FROM dp"""

BODIES["materialize"] = "SELECT * FROM vp"


BODIES["stream_ingest"] = "SELECT * FROM loaded"


def sql(name: str) -> str:
    return _plain(f"WITH {CTES}\n{BODIES[name]}")


def oracle_sql() -> dict[str, str]:
    return {name: sql(name) for name in BODIES if name in catalog.QUERIES}
