import os

from pyspark.sql import functions as F

from promolift import schema as S
from promolift.operators import ingest as I
from promolift.sources import csv as CSV
from promolift.sources import store as ST

HEADER = " Region ,PSA,Sub Category,Bonus Buy,Sales Date,Promotion Status,Article,Net Sales,Sales Quantity\n"


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(text)


def test_load_clean_dedup(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "a")
    _write(a, "one.csv", HEADER +
           "NA,P,S,BB1,01/10/2025,promo,12,\"1,234\",2\n"
           "R1,P,S,,02/10/2025,non-promo,12,5.5,1\n"
           "R1,P,S,,02/10/2025,non-promo,12,5.5,1\n"
           ",,,,,,,,\n"
           "R1,P,S,BB1,31/02/2025,promo,12,1,1\n")
    _write(a, "two.csv", "Article,Sales Date,Region,PSA,Sub Category,Bonus Buy,Promotion Status,Net Sales,"
                         "Sales Quantity,Extra\n13,2025-10-03,R2,P,S,BB2,PROMO,7,1.0d,x\n")
    _write(a, "bad.csv", "Region,Article\nR1,12\n")
    loaded = CSV.load_many(spark, a)
    rej = loaded.rejected.collect()
    assert len(rej) == 1 and rej[0].file.endswith("bad.csv") and "PSA" in rej[0].missing
    raw = loaded.data
    assert I.empty_row_counts(raw).collect()[0].asDict() == {"rows_read": 6, "rows_kept": 5}
    clean = I.clean_sales(raw)
    rows = sorted(((r[S.REGION], r[S.ARTICLE], str(r[S.SALES_DATE]), r[S.STATUS], r[S.NET_SALES], r[S.QUANTITY])
                   for r in clean.collect()), key=str)
    # NA region -> NULL; 1,234 -> 0; duplicate kept once; bad date dropped; 1.0d -> 0.
    assert rows == sorted([(None, "12", "2025-10-01", "PROMO", 0.0, 2.0),
                           ("R1", "12", "2025-10-02", "NON-PROMO", 5.5, 1.0),
                           ("R2", "13", "2025-10-03", "PROMO", 7.0, 0.0)], key=str)
    assert set(r[S.SOURCE_FILE] for r in clean.collect()) == {"one.csv", "two.csv"}
    dq = I.date_quality(raw.where(F.col(S.ARTICLE).isNotNull())).collect()[0]
    assert (dq.rows, dq.valid_dates, dq.invalid_dates) == (5, 4, 1)


def test_append_and_sink(spark, tmpdir_path):
    df1 = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    df2 = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    out = os.path.join(tmpdir_path, "out")
    ST.write_parquet(ST.append_dedup(df1, df2), out)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    csv_out = os.path.join(tmpdir_path, "csv")
    ST.write_csv(df1, csv_out)
    assert CSV.scan_csv(spark, csv_out).count() == 2


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([("x", 5), ("x", 2), ("y", 9)], "v string, row_order long")
    assert sorted(tuple(r) for r in I.dedup_rows(df, "row_order").collect()) == [("x", 2), ("y", 9)]


def test_work_dir_uses_session_checkpoint_dir(spark):
    from promolift.session import work_dir
    assert work_dir(spark).rstrip("/") == spark.sparkContext.getCheckpointDir().rstrip("/")


def test_append_compares_all_columns(spark):
    """A row that differs in a column only one side has is new; both ways of appending agree."""
    old = spark.createDataFrame([("A", 1.0), (None, 2.0)], "v string, x double")
    new = spark.createDataFrame([("A", 1.0, "x"), ("A", 1.0, None), (None, 2.0, None), ("B", 3.0, None)], "v string, x double, Note string")
    want = [("A", 1.0, None), ("A", 1.0, "x"), ("B", 3.0, None), (None, 2.0, None)]
    for distinct in (True, False):
        assert sorted((tuple(r) for r in ST.append_dedup(old, new, distinct).collect()), key=str) == sorted(want, key=str)
    wide = spark.createDataFrame([("A", 1.0, "x")], "v string, x double, Old string")
    assert ST.append_dedup(wide, old).count() == 3


def test_headers_are_found_by_tasks(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "many files")
    _write(folder, "a%20b.csv", "x , y\n1,2\n")
    _write(folder, "b.csv", "x , y\n")
    _write(folder, "c.csv", "")
    _write(folder, "d.csv", "\ufeffy,\"x,z\"\n1,2\n")
    groups = CSV.header_groups(spark, CSV.list_files(spark, folder))
    assert {h: [f.rsplit("/", 1)[-1] for f in m] for h, m in groups.items()} == {
        (): ["c.csv"], ("x ", " y"): ["a%20b.csv", "b.csv"], ("y", "x,z"): ["d.csv"]}
    assert CSV.header_groups(spark, []) == {}


def test_load_order_of_rows_not_from_files(spark):
    df = CSV.with_load_order(spark.range(3).toDF("v"))
    assert sorted(r.row_order for r in df.collect()) == sorted(r.row_order for r in df.collect())


def test_saved_tables_follow_the_input(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "in")
    _write(folder, "t.csv", "a\n1\n")
    one = ST.files_version(spark, folder)
    assert one == ST.files_version(spark, folder)
    _write(folder, "t.csv", "a\n1\n2\n")
    assert one != ST.files_version(spark, folder)


def test_load_order_of_large_keys(spark):
    from promolift.sources import fixtures as FX
    rows = [(2 ** 40 + 1, 1, 1, 1), (2 ** 40, 7, 2 ** 33, 2 ** 20), (2 ** 40, 7, 2 ** 33, 2 ** 20 + 1), (5, 2 ** 20, 9, 9)]
    df = spark.createDataFrame(rows, "o long, l long, p long, s long")
    got = df.withColumn("row_order", FX.row_order_of(*[F.col(c) for c in "olps"])).orderBy("row_order").drop("row_order")
    assert [tuple(r) for r in got.collect()] == sorted(rows)


def test_missing_article_stays(spark):
    from promolift.functions import clean as C
    got = spark.createDataFrame([(" 12 ",), (None,)], "a string").select(C.article_text("a").alias("a")).collect()
    assert [r.a for r in got] == ["12", "nan"]


def test_headers_cost_one_buffer_a_file(spark, tmpdir_path):
    """A large file of many splits is read up to the first line."""
    folder = os.path.join(tmpdir_path, "large")
    line = "1," + "x" * 200 + "\n"
    _write(folder, "large.csv", "a,b\n" + line * 200_000)  # 40 MB
    _write(folder, "small.csv", "a,b\n1,2\n")
    size = os.path.getsize(os.path.join(folder, "large.csv"))
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics()

    def read():
        return int(files.get("file").getLong("bytesRead"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        before = read()
        table = CSV.header_table(spark, CSV.list_files(spark, folder))
        assert read() - before < 1 << 20 < size
        assert sorted(tuple(r.columns) for r in table.collect()) == [("a", "b"), ("a", "b")]
        assert table.inputFiles()  # the headers are a saved table, from which rejected files are read
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rejected_files_come_from_the_saved_headers(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "some")
    _write(folder, "ok.csv", "a , b\n1,2\n")
    _write(folder, "bad.csv", "a\n1\n")
    _write(folder, "empty.csv", "")
    loaded = CSV.load_many(spark, folder, required=["a", "b"])
    assert sorted((r.file.rsplit("/", 1)[-1], r.missing) for r in loaded.rejected.collect()) == [("bad.csv", "b"), ("empty.csv", "a, b")]
    assert "FileScan" in loaded.rejected._jdf.queryExecution().executedPlan().toString() and loaded.data.count() == 1
    assert CSV.load_many(spark, os.path.join(tmpdir_path, "none"), required=["a"]).data.count() == 0


def test_headers_of_odd_file_names(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "odd")
    names = ["a,b.csv", "{x}.csv", "[1]*.csv", "q?.csv", "back\\slash.csv", "ümlaut 1.csv"]
    for n, name in enumerate(names):
        _write(folder, name, f"c{n},d\n1,2\n")
    files = [f"file:{folder}/{name}" for name in names if name != "back\\slash.csv"]
    got = {r.file.rsplit("/", 1)[-1]: list(r.columns) for r in CSV.header_table(spark, files).collect()}
    assert got == {name: [f"c{n}", "d"] for n, name in enumerate(names) if name != "back\\slash.csv"}


def test_indexed_appends(spark, tmpdir_path):
    """Appends equal appends by comparing everything, with new columns, NULLs, replays and months of their own."""
    import datetime as dt
    base = os.path.join(tmpdir_path, "table")
    d = [dt.date(2025, m, 1) for m in range(1, 5)]
    schema = "`Sales Date` date, v string, x double"
    one = spark.createDataFrame([(d[0], "A", 1.0), (d[0], "A", 1.0), (d[1], None, 2.0), (None, "N", None)], schema)
    two = spark.createDataFrame([(d[0], "A", 1.0, None), (d[0], "A", 1.0, "x"), (d[1], None, 2.0, None), (d[2], "C", 3.0, None), (None, "N", None, None)],
                                schema + ", Note string")
    want = ST.append_dedup(one.dropDuplicates(), two)
    ST.append_indexed(one, base, "one")
    ST.append_indexed(two, base, "two")
    ST.append_indexed(two, base, "two")
    ST.append_indexed(one.limit(0), base, "none")
    got = ST.read_indexed(spark, base)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect()))


def test_an_append_opens_only_the_months_it_touches(spark, tmpdir_path, monkeypatch):
    import datetime as dt
    base, asked = os.path.join(tmpdir_path, "table"), []
    months = ST._months
    monkeypatch.setattr(ST, "_months", lambda *args: asked.append(months(*args)) or asked[-1])
    for m in range(1, 10):
        rows = spark.createDataFrame([(dt.date(2025, m, 1 + i), str(i)) for i in range(5)], "`Sales Date` date, v string")
        ST.append_indexed(rows, base, f"b{m}")
    assert asked == [[]] * 9  # a month that is new: nothing of the table is read
    ST.append_indexed(spark.createDataFrame([(dt.date(2025, 3, 1), "0"), (dt.date(2025, 3, 9), "new")], "`Sales Date` date, v string"), base, "late")
    assert [[p.rsplit("=", 1)[-1] for p in a] for a in asked[9:]] == [["202503"]]
    assert ST.read_indexed(spark, base).count() == 46


def test_headers_of_compressed_files(spark, tmpdir_path):
    import gzip
    path = os.path.join(tmpdir_path, "x.csv.gz")
    with gzip.open(path, "wt") as fh:
        fh.write("a,b\n1,2\n")
    assert [list(r.columns) for r in CSV.header_table(spark, [path]).collect()] == [["a", "b"]]
    assert CSV.load_many(spark, path, required=["a"]).data.count() == 1
