import os

from promolift import schema as S
from promolift.streaming import ingest as STREAM

HEADER = "Region,PSA,Sub Category,Bonus Buy,Sales Date,Promotion Status,Article,Net Sales,Sales Quantity\n"
ROW1 = "R1,P,S,,02/10/2025,non-promo,12,5.5,1\n"
ROW2 = "R1,P,S,BB,03/10/2025,promo,12,7,2\n"
ROW3 = "R2,P,S,BB,04/10/2025,promo,13,1,1\n"


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w") as fh:
        fh.write(HEADER + text)


def test_stream_appends_without_duplicates(spark, tmpdir_path):
    src, table, ckpt = (os.path.join(tmpdir_path, x) for x in ("in", "table", "ckpt"))
    os.makedirs(src)
    _write(src, "day1.csv", ROW1 + ROW1 + ROW2 + "R1,P,S,,31/02/2025,promo,12,1,1\n")
    STREAM.start_sales_ingest(spark, src, table, ckpt).awaitTermination()
    first = STREAM.read_ingested(spark, table)
    assert first.count() == 2  # duplicate and bad date dropped
    # A second file arrives later: its duplicate row is kept once.
    _write(src, "day2.csv", ROW3 + ROW3)
    STREAM.start_sales_ingest(spark, src, table, ckpt).awaitTermination()
    rows = STREAM.read_ingested(spark, table).collect()
    assert sorted((r[S.ARTICLE], r[S.STATUS], r[S.SOURCE_FILE]) for r in rows) == [
        ("12", "NON-PROMO", "day1.csv"), ("12", "PROMO", "day1.csv"), ("13", "PROMO", "day2.csv")]
    # Restarting with nothing new leaves the table as it is.
    STREAM.start_sales_ingest(spark, src, table, ckpt).awaitTermination()
    assert STREAM.read_ingested(spark, table).count() == 3


def test_stream_maps_columns_by_header(spark, tmpdir_path):
    src, table, ckpt = (os.path.join(tmpdir_path, x) for x in ("in2", "table2", "ckpt2"))
    os.makedirs(src)
    _write(src, "plain.csv", ROW2)
    with open(os.path.join(src, "moved.csv"), "w") as fh:  # article first, region and PSA exchanged, one more column
        fh.write("Article,PSA,Region,Sub Category,Bonus Buy,Sales Date,Promotion Status,Net Sales,Sales Quantity,Note\n"
                 "14,P9,R9,S,BB,05/10/2025,promo,3,1,hello\n")
    with open(os.path.join(src, "bad.csv"), "w") as fh:
        fh.write("Article,Region\n1,R1\n")
    STREAM.start_sales_ingest(spark, src, table, ckpt).awaitTermination()
    rows = {r[S.ARTICLE]: r for r in STREAM.read_ingested(spark, table).collect()}
    assert (rows["14"][S.REGION], rows["14"][S.PSA], rows["14"]["Note"]) == ("R9", "P9", "hello")
    assert rows["12"][S.REGION] == "R1" and rows["12"]["Note"] is None and len(rows) == 2
    rejected = STREAM.read_rejected(spark, table).collect()
    assert [r.file.endswith("bad.csv") for r in rejected] == [True] and S.PSA in rejected[0].missing


def test_a_batch_opens_only_batches_with_its_files(spark, tmpdir_path, monkeypatch):
    """Batches of new files read nothing of the table; a file that comes again reads the batches that hold it."""
    table, opened = os.path.join(tmpdir_path, "table"), []
    read = STREAM.read_batches
    monkeypatch.setattr(STREAM, "read_batches", lambda spark, t, batches: opened.append(batches) or read(spark, t, batches))
    header = "Region,PSA,Sub Category,Bonus Buy,Sales Date,Promotion Status,Article,Net Sales,Sales Quantity\n"
    run = STREAM.append_batch(table)

    def deliver(batch_id, folder, files):
        paths = []
        for name, lines in files.items():
            os.makedirs(os.path.join(tmpdir_path, folder), exist_ok=True)
            path = os.path.join(tmpdir_path, folder, name)
            with open(path, "w") as fh:
                fh.write(header + "".join(f"R,P,S,BB,2025-01-0{n},PROMO,A{n},1,1\n" for n in lines))
            paths.append((f"file:{path}",))
        run(spark.createDataFrame(paths, "path string"), batch_id)
    for n in range(4):
        deliver(n, "in", {f"f{n}.csv": [1, 2]})
    assert opened == []
    deliver(4, "again", {"f1.csv": [1, 2, 3], "f9.csv": [1]})
    assert opened == [[1]]
    deliver(4, "again", {"f1.csv": [1, 2, 3], "f9.csv": [1]})  # replayed
    assert opened == [[1], [1]]
    deliver(5, "third", {"f1.csv": [2, 3, 4]})
    assert opened[-1] == [1, 4]
    rows = sorted((r[S.SOURCE_FILE], r[S.ARTICLE]) for r in STREAM.read_ingested(spark, table).collect())
    assert rows == sorted([(f"f{n}.csv", a) for n in range(4) for a in ("A1", "A2")] + [("f1.csv", "A3"), ("f9.csv", "A1"), ("f1.csv", "A4")])
