import datetime as dt

from pyspark.sql import functions as F

from promolift import schema as S
from promolift.operators import forecast as FC

SALES = ("`Article` string, `Promotion Status` string")
FC_SCHEMA = "row_order long, Description string, Start_Date date, End_Date date, Forecast_Qty double, Duration_Days int"


def _fc(spark, rows):
    d = dt.date(2025, 1, 1)
    return spark.createDataFrame([(i, t, d, d, q, 1) for i, (t, q) in enumerate(rows)], FC_SCHEMA)


def test_contains_first_wins(spark):
    sales = spark.createDataFrame([("12", "PROMO"), ("34", "PROMO"), ("56", "NON-PROMO")], SALES)
    fc = _fc(spark, [("x 1234 y", 5.0), ("12 z", 7.0)])
    for mode in ("contains", "regex"):
        got = {r.Article: r.Forecast_Qty for r in FC.forecast_match(sales, fc, mode).collect()}
        assert got == {"12": 5.0, "34": 5.0}, mode
    tok = {r.Article: r.Forecast_Qty for r in FC.forecast_match(sales, fc, "token").collect()}
    assert tok == {"12": 7.0}


def test_only_promo_rows_get_forecast(spark):
    sales = spark.createDataFrame([("12", "PROMO"), ("12", "NON-PROMO")], SALES)
    out = FC.attach_forecast(sales, _fc(spark, [("item 12", 4.0)])).orderBy(S.STATUS).collect()
    assert [(r[S.STATUS], r.Has_Forecast, r.Forecast_Qty) for r in out] == \
        [("NON-PROMO", False, None), ("PROMO", True, 4.0)]


def test_clean_forecast_durations(spark):
    raw = spark.createDataFrame([("A 1", "02/01/2025", "01/01/2025", "10"), ("B 2", "01/01/2025", None, "6"),
                                 ("C", "bad", "01/01/2025", "3"), ("D", "01/01/2025", "03/01/2025", "x")],
                                "`Item Desc.` string, DATE string, END string, `TTL Forecast Qty` string")
    out = FC.clean_forecast(raw).orderBy(S.DESCRIPTION).collect()
    assert [(r.Description, r.Duration_Days) for r in out] == [("A 1", 0), ("B 2", 1)]
    fc = FC.clean_forecast(raw).withColumn(S.ROW_ORDER, F.monotonically_increasing_id())
    sales = spark.createDataFrame([("A", "PROMO")], SALES)
    m = FC.forecast_match(sales, fc).collect()[0]
    assert m.Forecast_Qty == 10.0 and m.Forecast_Daily_Qty is None


def test_no_end_column_means_one_day(spark):
    raw = spark.createDataFrame([("A", "01/01/2025", "3")], "Description string, `Start Date` string, `Fcst Qty` string")
    out = FC.clean_forecast(raw).collect()[0]
    assert out.End_Date == out.Start_Date and out.Duration_Days == 1


def test_header_mapping_rules():
    m = FC.header_mapping(["Description", "DATE", "END", "TTL Forecast Qty"])
    assert set(m.values()) == {S.DESCRIPTION, S.START_DATE, S.END_DATE, S.FORECAST_QTY}
    norm = [FC.normalise_header(h) for h in ["Item Desc.", "Start Date", "End Date", "Revised Ttl Fcst Qty"]]
    assert set(FC.header_mapping(norm).values()) == {S.DESCRIPTION, S.START_DATE, S.END_DATE, S.FORECAST_QTY}
    m = FC.header_mapping(["Description", "END DATE", "DATE", "TTL Forecast Qty"])
    assert m["END DATE"] == S.START_DATE and "DATE" not in m
    assert FC.header_mapping(["Vendor", "End"]).get("Vendor") == S.END_DATE


def test_large_article_side_is_not_broadcast(spark, monkeypatch):
    sales = spark.createDataFrame([("12", "PROMO"), ("34", "PROMO")], SALES)
    fc = _fc(spark, [("x 1234 y", 5.0), ("12 z", 7.0)])
    small = {r.Article: r.Forecast_Qty for r in FC.forecast_match(sales, fc).collect()}
    monkeypatch.setattr(FC, "BROADCAST_MAX_BYTES", 0)
    df = FC.forecast_match(sales, fc)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan.split("AdaptiveSparkPlan")[-1] or "isFinalPlan=false" in plan
    assert {r.Article: r.Forecast_Qty for r in df.collect()} == small
    out = FC.attach_forecast(sales, fc).collect()
    assert sorted((r.Article, r.Forecast_Qty) for r in out) == [("12", 5.0), ("34", 5.0)]


def test_load_forecasts_many_files(spark, tmpdir_path):
    import os
    d = os.path.join(tmpdir_path, "fc")
    os.makedirs(d)
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write("Description,DATE,END,TTL Forecast Qty\nitem 12,01/01/2025,03/01/2025,9\nitem 34,01/01/2025,,4\n")
    with open(os.path.join(d, "b.csv"), "w") as fh:
        fh.write("Item Desc.,Start Date,End Date,Revised Ttl Fcst Qty\nitem 12,01/01/2025,03/01/2025,9\n"
                 "item 56,02/01/2025,02/01/2025,x\n")
    with open(os.path.join(d, "c.csv"), "w") as fh:
        fh.write("Note,Qty\nnothing,1\n")
    fc, rej = FC.load_forecasts(spark, d)
    rows = sorted((r.Description, r.Duration_Days, r.Forecast_Qty) for r in fc.collect())
    # duplicate across files kept once; bad quantity dropped; missing end -> 1 day
    assert rows == [("item 12", 3, 9.0), ("item 34", 1, 4.0)]
    assert [r.file.endswith("c.csv") for r in rej.collect()] == [True]
    first = [r for r in fc.collect() if r.Description == "item 12"][0]
    assert first.row_order.file.endswith("a.csv")


def test_load_forecasts_keeps_further_columns(spark, tmpdir_path):
    import os
    d = os.path.join(tmpdir_path, "fc2")
    os.makedirs(d)
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write("Description,DATE,TTL Forecast Qty,Store\nitem 1,01/01/2025,9,s1\nitem 1,01/01/2025,9,s2\nitem 1,01/01/2025,9,s2\n")
    with open(os.path.join(d, "b.csv"), "w") as fh:
        fh.write("Description,DATE,TTL Forecast Qty\nitem 1,01/01/2025,9\n")
    fc, _ = FC.load_forecasts(spark, d)
    assert sorted(str(r.Store) for r in fc.collect()) == ["None", "s1", "s2"]


def test_regex_patterns_and_literals(spark, monkeypatch):
    monkeypatch.setattr(FC, "PATTERN_BATCH", 2)
    articles = spark.createDataFrame([("12",), ("1[23]x",), ("^z",), ("a.c",), ("q$",)], "Article string")
    fc = _fc(spark, [("abc 13x", 1.0), ("z 12", 2.0), ("y q", 3.0), ("^z", 4.0)])
    got = {r.Article: r.Forecast_Qty for r in FC.forecast_match(articles, fc, "regex").collect()}
    assert got == {"12": 2.0, "1[23]x": 1.0, "^z": 2.0, "a.c": 1.0, "q$": 3.0}
    assert FC.forecast_match(articles.limit(0), fc, "regex").count() == 0


def test_normalised_headers():
    cases = {" Item Desc. ": "Item Desc", "a  b": "a b", "a   b": "a  b", "a    b": "a  b", "Qty .": "Qty ", "..x..": "x", "": "", "a.b c": "ab c",
             "a . b": "a b", "TTL  Fcst   Qty": "TTL Fcst  Qty"}
    assert {h: FC.normalise_header(h) for h in cases} == cases


def test_required_pieces(spark):
    cases = {"1[23]x": "1", "abc.*de": "abc", "a?bcd": "bcd", "xy{0,2}zzz": "zzz", "xy{2}z": "xy", "a\\.b": "a.b", "a\\db": "a", "(ab|c)def": "def", "(abc)": None,
             "ab|cd": None, "(?i)abc": None, "\\Qab\\E": None, "\\x41bc": None, "^abc$": "abc", "Brand#1-[7]( |$)": "Brand#1-", "a+bb+": "bb", "ab*?cde": "cde",
             "((ab)c)de": None, "[]a]bc": None, "[^a]bc": "bc", "a(?:x|y)bcd": "bcd", ".*": None, "a\\+b?": "a+", "ab[c": None, "a||b": None}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", FC.required_piece(F.col("p")).alias("piece"))
    assert {r.p: r.piece for r in df.collect()} == cases


def test_modes_equal_brute_force(spark, monkeypatch):
    """Random articles, patterns and descriptions, repeated and hot, against plain Python."""
    import random
    import re
    rng = random.Random(5)
    for bound in (FC.BROADCAST_MAX_BYTES, 0):
        monkeypatch.setattr(FC, "BROADCAST_MAX_BYTES", bound)
        words = ["Item", "ab", "abc", "x1", "Brand#1-1", "Brand#1-12", "Brand", "q", "long article name", ""]
        desc = [" ".join(["Item", *rng.choices(words, k=rng.randrange(0, 4))]) for _ in range(120)] + ["", "q", "abab", "Brand#1-123"]
        literal = ["Item", "q", "ab", "aba", "Brand#1-1", "Brand#1-12", "Brand#1-123", "long article name", "no such article", "Item Item", "nog", "zz"]
        patterns = ["Brand#1-[12]+", "^q$", "a.c", "(ab|x1) Item", "b{2}", "(?i)ITEM x", "ab|zz", "[xq]1?$", "Item \\S+$", "no.such"]
        fc = _fc(spark, [(d, float(i)) for i, d in enumerate(desc)])

        def first(test):
            return next((float(i) for i, d in enumerate(desc) if test(d)), None)
        for mode, texts, test in (("contains", literal, lambda a, d: a in d), ("token", literal, lambda a, d: a in re.split(r"\s+", d)),
                                  ("regex", literal + patterns, lambda a, d: re.search(a, d) is not None)):
            got = {r.Article: r.Forecast_Qty for r in FC.forecast_match(spark.createDataFrame([(a,) for a in texts], "Article string"), fc, mode).collect()}
            assert got == {a: q for a in texts if (q := first(lambda d, a=a: test(a, d))) is not None}, (mode, bound)


def test_a_piece_in_every_description_is_one_row_before_the_join(spark):
    fc = _fc(spark, [(f"Item {i % 50} q", float(i)) for i in range(2000)])
    desc = FC._descriptions(fc)
    assert desc.count() == 50  # repeated descriptions are one
    keys = FC._first(FC._with_grams(desc, [1, 4]), "_key")
    hot = keys.where("_key IN ('Item', 'q')").collect()
    assert sorted((r._key, r._order) for r in hot) == [("Item", 0), ("q", 0)]
    plan = FC.forecast_match(spark.createDataFrame([("Item",), ("q",)], "Article string"), fc)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("BroadcastHashJoin"):]
    assert join.index("HashAggregate") < join.index("Generate")  # the join's input is aggregated after it is cut up
    assert "SortAggregate" not in plan


def test_patterns_with_a_piece_are_not_tried_on_every_description(spark):
    fc = _fc(spark, [("abc 13x", 1.0), ("z 12", 2.0)])
    def plan(patterns):
        articles = spark.createDataFrame([(p,) for p in patterns], "Article string")
        return FC.forecast_match(articles, fc, "regex")._jdf.queryExecution().analyzed().toString()
    assert "_batch" not in plan(["1[23]x", "z.1", "12"])
    assert "_batch" in plan(["1[23]x", ".*"])
