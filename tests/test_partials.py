"""Reports from saved cells equal reports from rows, whatever the batches."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from promolift import schema as S
from promolift.operators import baseline as B
from promolift.operators import partials as PT
from promolift.operators import promo as P
from promolift.plans import catalog, report

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="test data missing")


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def prepared(spark):
    return catalog._prep(spark, SMALL)


def appended(prepared, base, n):
    for i in range(n):
        PT.append_cells(prepared.where(F.pmod(F.xxhash64(S.ROW_ORDER), F.lit(n)) == i), base, f"b{i}")
    return PT.read_cells(prepared.sparkSession, base)


@pytest.mark.parametrize("filters", [S.Filters(), S.Filters(year=1996, min_days=2), S.Filters(region="EUROPE", min_days=2),
                                     S.Filters(psa="BUILDING", month=5, min_days=1)])
def test_equal_to_a_full_build(spark, prepared, tmpdir_path, filters):
    found = appended(prepared, f"{tmpdir_path}/cells", 3)
    want = report.summary_report(prepared, filters)
    got = report.summary_report_from_cells(found, filters, f"{tmpdir_path}")
    assert rows(got.baselines) == rows(want.baselines)
    assert rows(got.valid) == rows(want.valid)
    assert rows(got.rollup) == rows(want.rollup)


def test_an_append_changes_what_it_holds(spark, prepared, tmpdir_path):
    base = f"{tmpdir_path}/cells"
    first, second = (prepared.where(F.col(S.YEAR) < 1996), prepared.where(F.col(S.YEAR) >= 1996))
    PT.append_cells(first, base, "first")
    assert rows(B.baselines_from(B.stats_from_days(PT.article_days(PT.read_cells(spark, base))))) == rows(B.baselines(first))
    PT.append_cells(second, base, "second")
    PT.append_cells(second, base, "second")  # replayed: replaces itself
    found = PT.read_cells(spark, base)
    assert rows(B.baselines_from(B.stats_from_days(PT.article_days(found)))) == rows(B.baselines(prepared))
    assert rows(PT.promo_summary(found)) == rows(P.promo_summary(prepared))


def test_cells_have_no_sort_of_rows(spark, prepared):
    assert "SortAggregate" not in PT.cells(prepared)._jdf.queryExecution().executedPlan().toString()


def test_without_forecasts_and_optional_columns(spark, tmpdir_path):
    data = [("A", "BB", "R1", "PROMO", 1, 10.0, 1.0), ("A", None, "R1", S.NON_PROMO, 2, 5.0, 1.0), ("A", None, "R2", S.NON_PROMO, 3, 5.5, 2.0),
            (None, "BB", "R1", "PROMO", 2, 1.0, 1.0), ("A", None, "R1", S.NON_PROMO, 4, 6.0, 1.0), ("A", None, None, S.NON_PROMO, 1, 6.0, 1.0)]
    df = spark.createDataFrame(data, "`Article` string, `Bonus Buy` string, `Region` string, `Promotion Status` string, d int, "
                                     "`Net Sales` double, `Sales Quantity` double") \
        .withColumn(S.SALES_DATE, F.date_add(F.lit("2025-01-01").cast("date"), F.col("d"))).drop("d")
    PT.append_cells(df, f"{tmpdir_path}/cells", "one")
    found = PT.read_cells(spark, f"{tmpdir_path}/cells")
    assert rows(PT.promo_summary(found)) == rows(P.promo_summary(df))
    assert rows(B.baselines_from(B.stats_from_days(PT.article_days(found)))) == rows(B.baselines(df)) == [("A", 3, 5.5)]
