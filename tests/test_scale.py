"""What must not grow faster than the input: plans of the steps that many queries share, and their results."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from promolift import schema as S
from promolift.operators import partials as PT
from promolift.operators import promo as P
from promolift.sources import fixtures as FX
from promolift.sources import store as ST

with_data = pytest.mark.skipif(not os.path.exists(SMALL), reason="test data missing")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_promo_days_are_bits_of_years(spark):
    """dates are counted without a row for each promotion and date."""
    days = [dt.date(1995, 12, 31), dt.date(1996, 1, 1), dt.date(1996, 2, 29), dt.date(1996, 12, 31), dt.date(1996, 12, 31),
            dt.date(1996, 3, 4), dt.date(1996, 3, 5), dt.date(1997, 1, 1), dt.date(1997, 12, 31), None]
    rows = [("A", "B", "R", "PROMO", d, 2.5, 1.0) for d in days] + [("N", "B", "R", "PROMO", None, 1.0, 1.0)]
    sales = spark.createDataFrame(rows, "Article string, `Bonus Buy` string, Region string, `Promotion Status` string, "
                                        "`Sales Date` date, `Net Sales` double, `Sales Quantity` double")
    found = P.promo_summary(sales)
    assert {r.Article: (r.PromoDays, r.PromoSales, r.PromoQuantity) for r in found.collect()} == {"A": (8, 25.0, 10.0), "N": (0, 1.0, 1.0)}
    assert found.schema["PromoDays"].dataType.typeName() == "long"
    assert "count(distinct" not in plan_of(found)


@with_data
def test_raw_files_share_the_joined_rows(spark):
    """raw files are made from the rows that were joined once."""
    for kind in ("sales_a", "sales_b", "sales_c"):
        assert "Join" not in plan_of(FX.RAW[kind](spark, SMALL))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, FX.saved_sales(spark, SMALL).collect())) == sorted(map(key, FX.sales_table(spark, SMALL).collect()))


@with_data
def test_growing_tables_do_not_pass_the_driver(spark):
    """only nations and regions are broadcast."""
    plan = plan_of(FX.sales_table(spark, SMALL))
    assert (plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")) == (3, 2)


def test_tasks_of_a_write_follow_its_rows(spark, monkeypatch):
    """a large table is sorted in more tasks, a small one in as many as the session says."""
    monkeypatch.setattr(ST, "TASK_ROWS", 10)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ST.tasks_for(spark.range(5)) == n
    assert ST.tasks_for(spark.range(10 * n + 1)) == n + 1


def test_rows_alike_are_compared_whole(spark):
    """rows meet by their digest alone; equal digests of different rows, NULLs and columns of one side count."""
    fresh = spark.createDataFrame([("a", None, 1, 7), ("b", 1.0, 1, 7), ("c", 2.0, 2, 7), ("d", None, 3, 7)],
                                  "v string, x double, _digest long, _month int")
    stored = spark.createDataFrame([("a", None, None, 1), ("z", 1.0, None, 1), ("c", 2.0, "note", 2)],
                                   "v string, x double, Note string, _digest long")
    got = ST._not_alike(fresh, stored, ["v", "x"])
    assert sorted(r.v for r in got.collect()) == ["b", "c", "d"]
    assert got.columns == fresh.columns
    joined = ST._not_alike(fresh.hint("merge"), stored, ["v", "x"])
    line = next(x for x in plan_of(joined).splitlines() if "SortMergeJoin" in x)
    assert line.count("_digest#") == 1 and "], [_stored#" in line


def test_cells_move_rows_once(spark):
    """rows move once, by ranges of the keys, and not as partial cells; a cell of many rows is one row."""
    rows = [("A", "B", "R", "PROMO", dt.date(1996, 1, 1), 0.1, 1.0)] * 50 + [("A", None, "R", "NON-PROMO", None, 2.0, 1.0)]
    sales = spark.createDataFrame(rows, "Article string, `Bonus Buy` string, Region string, `Promotion Status` string, "
                                        "`Sales Date` date, `Net Sales` double, `Sales Quantity` double").repartition(4)
    found = PT.cells(sales)
    assert {(r.promo, r.rows) for r in found.collect()} == {(True, 50), (False, 1)} and found.count() == 2
    plan = plan_of(PT.cells(spark.createDataFrame(rows, sales.schema)))
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
