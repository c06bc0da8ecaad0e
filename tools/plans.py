"""Write PLANS.md: the physical plan tree of key queries (explain "formatted", tree part)."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from promolift.plans import catalog  # noqa: E402
from promolift.session import build_session  # noqa: E402

KEYS = {
    "baselines": "two partial aggregations, no join",
    "analyze_promotions": "promo summary (distinct days, forecast maxima in one aggregation) joined to baselines",
    "forecast_match": "articles found by their rarest piece; repeated descriptions and short keys reduced first; no nested loop",
    "forecast_match_regex": "patterns found by their required piece; no pass of all descriptions over all patterns",
    "clean_days": "promo days as bitmaps, broadcast when measured small; no sales row is shuffled",
    "article_info": "least leading number by hash aggregation, then only rows that have it; no sort of all rows",
    "filter_options": "distinct combinations first",
    "prepare": "sales adapter, forecast match, left join on Article",
    "region_baselines": "region-day aggregate, article-day window, no raw-row join",
    "quadrants": "one Article partitioning, medians as a window",
    "top_promos": "per-partition top-k",
    "filter_sales": "year filter prunes partition folders",
    "article_rows": "article equality pushed to the Parquet scan",
    "article_kpis": "one scan, two grouping sets of one hash aggregation, no join",
    "profile": "one row per article and region first, distinct counts on those",
    "promo_regions": "one scan, one aggregation",
}


def tree(df) -> str:
    text = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    head = text.split("\n\n(1)")[0]
    scans = [line for line in text.splitlines() if line.startswith(("PushedFilters", "PartitionFilters", "ReadSchema"))]
    return head + "\n\n" + "\n".join(scans)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    out = ["# Physical plans", "",
           f"`tools/plans.py` at {os.path.basename(sf_dir)}, local[8], AQE on (initial plans; AQE may",
           "turn a shuffle join into a broadcast join at run time when a side is measured small).", ""]
    for key, why in KEYS.items():
        df = catalog.run(key, spark, sf_dir)
        out += [f"## {key}", "", why, "", "```", tree(df), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
