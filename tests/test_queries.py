"""Registered queries: smoke at sf0.001, properties, and the SQL oracle on a subset."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
import __spark_entry__ as E
from promolift import schema as S
from promolift.operators import article as A
from promolift.operators import promo as P
from promolift.plans import catalog, report

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="test data missing")


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "Uplift_Pct" in df.columns


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def _norm(df):
    out = []
    for rec in df[sorted(df.columns)].itertuples(index=False, name=None):
        out.append(tuple(None if (x is None or x != x) else str(x)[:10] if hasattr(x, "isoformat") else
                         round(x, 6) if isinstance(x, float) else x for x in rec))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["baselines", "analyze_promotions", "promo_rollup", "strategy", "forecast_match",
                                  "article_uplift", "promo_types", "quartiles", "load_many", "parse_dates",
                                  "article_kpis", "overview", "append_dedup", "load_forecasts", "forecast_match_regex",
                                  "scan_csv", "map_headers", "profile", "promo_details", "display_lowest"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = E.queries()[name](spark, SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got) == _norm(want)


def test_properties(spark):
    prep = catalog._prep(spark, SMALL)
    ov = P.promo_split(prep).collect()
    assert sum(r.records for r in ov) == prep.count()
    rep = report.summary_report(prep)
    v = rep.valid.agg(F.sum("PromoSales").alias("s")).collect()[0].s
    r = rep.rollup.agg(F.sum("PromoSales").alias("s")).collect()[0].s
    assert abs(v - r) < 1e-6 * max(1.0, abs(v))
    k = A.article_kpis(prep)
    assert k.where(F.col("clean_days") > F.col("nonpromo_days")).count() == 0
    counts = [report.summary_report(prep, S.Filters(min_days=m)).valid.count() for m in (1, 3, 7)]
    assert counts[0] >= counts[1] >= counts[2]
    shuffled = prep.repartition(7, F.rand(1))
    a = sorted(tuple(x) for x in report.summary_report(shuffled).rollup.select(
        S.ARTICLE, S.BONUS_BUY, "PromoSales", "BaselineSales", "Uplift_Pct").collect())
    b = sorted(tuple(x) for x in rep.rollup.select(S.ARTICLE, S.BONUS_BUY, "PromoSales", "BaselineSales", "Uplift_Pct").collect())
    assert a == b  # sums are exact: the order of rows changes no bit


def test_reports(spark):
    prep = catalog._prep(spark, SMALL)
    full = report.summary_report(prep, S.Filters(min_days=4))
    reused = report.summary_report_reusing_facts(prep, S.Filters(min_days=4), SMALL)
    cols = [S.ARTICLE, S.BONUS_BUY, "PromoSales"]
    a = sorted(tuple(r) for r in full.rollup.select(*cols).collect())
    b = sorted(tuple(r) for r in reused.rollup.select(*cols).collect())
    assert a == b and len(a) > 0
    art = A.valid_articles(prep).first().Article
    one = report.article_report(prep, art)
    assert set(r.Article for r in one.uplift.collect()) <= {art}
    assert one.kpis.count() == 1


def test_types_equal_the_oracle(spark):
    """Names and types of every query and its SQL, DATE columns included."""
    types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name in sorted(set(catalog.QUERIES) - {"stream_ingest"}):
        got = {f.name: types.get(f.dataType.simpleString()) for f in catalog.run(name, spark, SMALL).schema.fields}
        want = {c: t for c, t, *_ in con.execute(f"DESCRIBE {E.oracle_sql()[name]}").fetchall()}
        assert got == want, name


def test_verdict_ranks_follow_the_lists(spark):
    """Ranks over many partitions, ties and hot verdicts: the same as sorting each verdict by itself."""
    rows = [(f"A{i % 5}", f"B{i}", [0.5, 0.4, -0.5, -0.5, 0.0, None][i % 6] if i % 6 != 2 else -0.3 - (i % 4) / 10) for i in range(300)]
    rollup = spark.createDataFrame(rows, "`Article` string, `Bonus Buy` string, Uplift_Pct double").repartition(7)
    from promolift.operators import summary as SM
    got = SM.verdict_details(rollup).collect()
    assert len(got) == 300
    for verdict in {r.Interpretation for r in got}:
        want = [(r["Article"], r["Bonus Buy"]) for r in SM.verdict_detail(rollup, verdict).collect()]
        assert [(r["Article"], r["Bonus Buy"]) for r in sorted((r for r in got if r.Interpretation == verdict), key=lambda r: r.Rank)] == want
