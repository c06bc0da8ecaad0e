import datetime as dt

from pyspark.sql import functions as F

from promolift import schema as S
from promolift.operators import baseline as B
from promolift.operators import forecast as FC
from promolift.operators import promo as P

D = [dt.date(2025, 1, i) for i in range(1, 10)]
COLS = [S.REGION, S.PSA, S.SUBCAT, S.BONUS_BUY, S.SALES_DATE, S.STATUS, S.ARTICLE, S.NET_SALES, S.QUANTITY]
SCHEMA = ("`Region` string, `PSA` string, `Sub Category` string, `Bonus Buy` string, `Sales Date` date, "
          "`Promotion Status` string, `Article` string, `Net Sales` double, `Sales Quantity` double")


def sales(spark, rows):
    """rows: (region, article, day, status, bonus buy, sales)"""
    data = [(r, "P1", "SC", bb, D[d], st, a, float(v), 1.0) for r, a, d, st, bb, v in rows]
    return spark.createDataFrame(data, SCHEMA)


NON, PRO = S.NON_PROMO, "PROMO"


def test_mixed_day_is_not_clean(spark):
    df = sales(spark, [("R1", "A", 0, NON, None, 10), ("R2", "A", 0, PRO, "BB", 99),
                       ("R1", "A", 1, NON, None, 20), ("R2", "A", 1, NON, None, 4),
                       ("R1", "A", 2, NON, None, 6), ("R1", "A", 3, NON, None, 30)])
    rows = B.baselines(df).collect()
    assert [(r.Article, r.Clean_Days, r.Daily_Avg) for r in rows] == [("A", 3, 20.0)]


def test_totals_and_too_few_days(spark):
    rows = [("R1", "A", d, NON, None, 10) for d in (1, 2, 3)] + [("R1", "A", 0, PRO, "BB", 5)]
    rows += [("R1", "B", 0, PRO, "BB", 5), ("R1", "B", 1, NON, None, 1), ("R1", "B", 2, NON, None, 1)]
    rows += [("R1", "C", d, NON, None, 1) for d in range(5)]  # never promoted
    df = sales(spark, rows)
    assert [r.Article for r in B.baselines(df).collect()] == ["A"]
    t = B.baseline_totals(df).collect()[0]
    assert (t.total_clean_days, t.valid_articles) == (5, 1)


def test_no_article_qualifies(spark):
    df = sales(spark, [("R1", "B", 0, PRO, "BB", 5), ("R1", "B", 1, NON, None, 1)])
    assert B.baselines(df).count() == 0
    t = B.baseline_totals(df).collect()[0]
    assert (t.total_clean_days, t.valid_articles) == (0, 0)


def test_null_bonus_buy_and_region_promo(spark):
    rows = [("R1", "A", d, NON, None, 10) for d in (0, 1, 2, 3)]
    rows += [("R1", "A", 1, PRO, None, 50), (None, "A", 2, PRO, "BB", 50), ("R1", "A", 5, PRO, "BB", 70)]
    df = sales(spark, rows)
    # Promo dates d1 (no Bonus Buy) and d2 (no Region) still block those days.
    assert B.baselines(df).count() == 0
    assert [r.Clean_Days for r in B.baseline_stats(df).collect()] == [2]
    summary = P.promo_summary(df).collect()
    assert [(r[S.BONUS_BUY], r[S.REGION], r.PromoDays) for r in summary] == [("BB", "R1", 1)]


def test_analyze_thresholds_and_labels(spark):
    rows = [("R1", "A", d, NON, None, 100) for d in (0, 1, 2, 3)]
    rows += [("R1", "A", d, PRO, "BB", 150) for d in (4, 5, 6)]
    prep = FC.prepare(sales(spark, rows))
    valid = P.analyze_promotions(prep, B.baselines(prep), min_days=3).collect()
    assert len(valid) == 1
    v = valid[0]
    assert (v.PromoDays, v.BaselineSales, v.Uplift_Pct, v.Interpretation, v.Uplift_Display) == \
        (3, 300.0, 0.5, "Strong Success", "+50.0%")
    assert v.Confidence == "Medium" and v.Forecast_Interpretation == "No Forecast"
    assert P.analyze_promotions(prep, B.baselines(prep), min_days=4).count() == 0
    roll = P.promo_rollup(P.analyze_promotions(prep, B.baselines(prep), 3)).collect()[0]
    assert (roll.PromoSales, roll.BaselineSales, roll.Region) == (450.0, 300.0, 1)


def test_clean_rows_anti_join(spark):
    df = sales(spark, [("R1", "A", 0, NON, None, 1), ("R2", "A", 0, PRO, "BB", 1), ("R1", "A", 1, NON, None, 2)])
    got = [r[S.NET_SALES] for r in B.clean_rows(df).collect()]
    assert got == [2.0]


def test_region_filter(spark):
    df = sales(spark, [("R1", "A", 0, PRO, "BB", 1), ("R2", "A", 0, PRO, "BB", 1)])
    f = P.filter_sales(df, S.Filters(region="R2"))
    assert [r[S.REGION] for r in f.collect()] == ["R2"]
    assert P.filter_sales(df.withColumn(S.YEAR, F.lit(2025)), S.Filters(year=2024)).count() == 0


def test_article_list_and_type_order(spark):
    from promolift.operators import article as A
    from promolift.operators import summary as SM
    rows = [("R1", a, d, NON, None, 10) for a in ("B", "A") for d in (0, 1, 2, 3)]
    rows += [("R1", a, d, PRO, bb, v) for a, bb, v in (("B", "X", 40), ("B", "Y", 5), ("A", "X", 30)) for d in (4, 5)]
    prep = FC.prepare(sales(spark, rows))
    assert [r.Article for r in A.article_list(prep).collect()] == ["A", "B"]
    ranked = A.rank_promo_types(A.promo_types(prep)).collect()
    assert [(r.Article, r[S.BONUS_BUY]) for r in ranked] == [("A", "X"), ("B", "X"), ("B", "Y")]
    prof = SM.profile(prep, approximate=True).collect()[0]
    assert prof.rows == prep.count() and prof.articles == 2 and prof.invalid_dates == 0
    roll = P.promo_rollup(P.analyze_promotions(prep, B.baselines(prep), min_days=2, min_baseline=0))
    worst = SM.verdict_detail(roll, "Significant Loss").collect()
    assert [(r.Article, r[S.BONUS_BUY]) for r in worst] == [("B", "Y")]


def test_region_baseline_option(spark):
    rows = [("R1", "A", d, NON, None, 100) for d in (0, 1, 2, 3)]
    rows += [("R2", "A", d, NON, None, 300) for d in (0, 1, 2, 3)]
    rows += [("R1", "A", d, PRO, "BB", 150) for d in (4, 5, 6)]
    prep = FC.prepare(sales(spark, rows))
    by_article = P.analyze_promotions(prep, B.baselines(prep), 3).collect()[0]
    assert by_article.BaselineSales == 3 * 400.0  # all regions: 400 a day
    by_region = P.analyze_promotions(prep, P.region_daily_baselines(prep), 3, baseline_by="region").collect()[0]
    assert (by_region.BaselineSales, by_region.Uplift_Pct) == (300.0, 0.5)


def test_detail_order_and_lowest_first(spark):
    from promolift.functions import labels as L
    from promolift.operators import summary as SM
    rows = [(f"a{i}", "BB", u, 100.0, 90.0, 1.0, "t") for i, u in enumerate([-0.06, -0.19, -0.1, -0.5, -0.3, 0.4])]
    rollup = spark.createDataFrame(rows, "Article string, `Bonus Buy` string, Uplift_Pct double, PromoSales double, "
                                         "BaselineSales double, PromoQuantity double, Uplift_Display string").withColumn("Duration", F.lit(3))
    order = lambda v: [r.Uplift_Pct for r in SM.verdict_detail(rollup, v).collect()]
    assert order(L.ADJUST) == [-0.06, -0.1, -0.19] and order(L.LOSS) == [-0.5, -0.3]
    shown = [r.uplift_sort for r in SM.display_table(rollup, lowest_first=True).collect()]
    assert shown == sorted(shown)
