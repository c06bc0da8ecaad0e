"""A hot article holding a third of all rows: results equal a brute-force computation."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from promolift import schema as S
from promolift.operators import baseline as B
from promolift.operators import promo as P
from promolift.sources import fixtures as FX

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="test data missing")


def _skewed(spark):
    sales = FX.sales_table(spark, SMALL)
    hot = (F.col(f"{S.ROW_ORDER}.order") % 3) == 0
    return sales.withColumn(S.ARTICLE, F.when(hot, F.lit("HOT")).otherwise(F.col(S.ARTICLE)))


def _brute_baselines(pdf):
    out = {}
    for art, g in pdf.groupby(S.ARTICLE):
        promo = g[g[S.STATUS] != S.NON_PROMO]
        if promo.empty:
            continue
        pdates = set(promo[S.SALES_DATE])
        clean = g[(g[S.STATUS] == S.NON_PROMO) & ~g[S.SALES_DATE].isin(pdates)]
        days = clean[S.SALES_DATE].nunique()
        if days >= 3:
            out[art] = (clean[S.NET_SALES].sum() / days, days)
    return out


def test_hot_article(spark):
    sales = _skewed(spark).repartition(5)
    pdf = sales.toPandas()
    assert (pdf[S.ARTICLE] == "HOT").mean() > 0.3
    got = {r.Article: (r.Daily_Avg, r.Clean_Days) for r in B.baselines(sales).collect()}
    want = _brute_baselines(pdf)
    assert set(got) == set(want)
    for k, (avg, days) in want.items():
        assert got[k][1] == days and abs(got[k][0] - avg) < 1e-6 * max(1.0, abs(avg))
    summ = P.promo_summary(sales).where(F.col(S.ARTICLE) == "HOT").toPandas()
    promo = pdf[(pdf[S.STATUS] != S.NON_PROMO) & (pdf[S.ARTICLE] == "HOT")]
    keys = [S.ARTICLE, S.BONUS_BUY, S.REGION, S.SUBCAT, S.PSA]
    brute = promo.groupby(keys).agg(PromoDays=(S.SALES_DATE, "nunique"), PromoSales=(S.NET_SALES, "sum"))
    merged = summ.merge(brute.reset_index(), on=keys, suffixes=("", "_b"))
    assert len(merged) == len(brute) == len(summ)
    assert (merged.PromoDays == merged.PromoDays_b).all()
    assert ((merged.PromoSales - merged.PromoSales_b).abs() < 1e-6 * merged.PromoSales_b.abs().clip(lower=1)).all()


def test_hot_article_write_is_split(spark, tmpdir_path):
    from promolift.operators import forecast as FC
    from promolift.sources import store as ST
    prep = FC.prepare(_skewed(spark))
    path = os.path.join(tmpdir_path, "saved")
    ST.write_sales_table(prep, path, partitions=8)
    files = (spark.read.parquet(path).where(F.col(S.ARTICLE) == "HOT")
             .select(F.input_file_name().alias("f")).distinct().count())
    assert files > 1
