from helpers import RAW, raw

from shelfcast.streaming.ingest import ingest, read_panel, read_stream


def test_ingest_parts_good_and_bad(spark, tmp_path):
    source, good, bad = (str(tmp_path / x) for x in ("in", "good", "bad"))
    spark.createDataFrame([raw(), raw(), raw(dt="2024-01-16"), raw(dt="2024-01-17", sale_amount=1.0)], RAW).coalesce(1).write.parquet(source)
    query = ingest(read_stream(spark, source), "rev", good, bad, str(tmp_path / "check"))
    query.awaitTermination(120)
    assert query.exception() is None
    assert spark.read.parquet(good).count() == 2
    assert [r["error"] for r in spark.read.parquet(bad).collect()] == ["DailySumMismatchError"]


def bad_rows(spark, path):
    return [(r["error"], r["sale_amount"]) for r in spark.read.parquet(path).collect()]


def test_every_row_is_in_one_output(spark, tmp_path):
    """Three runs with bad dates, late rows and twins; nothing vanishes."""
    source, good, bad, check = (str(tmp_path / x) for x in ("in", "good", "bad", "check"))
    runs = [
        [raw(), raw(), raw(dt="2024-03-16"), raw(dt="not a day"), raw(dt="not a day"), raw(dt=None)],
        [raw(dt="2024-01-17", sale_amount=1.0), raw(), raw(product_id="7"), raw(dt="2024-06-01")],
        [raw(dt="2023-01-01"), raw(dt="2024-02-31"), raw(dt=None), raw(dt="2024-01-18", stock_hour6_22_cnt=3), raw(dt="2024-01-18", stock_hour6_22_cnt=3), raw(dt="2024-03-16")],
    ]
    for rows in runs:
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(source)
        query = ingest(read_stream(spark, source), "rev", good, bad, check)
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted((r["product_id"], r["dt"].isoformat()) for r in read_panel(spark, good).collect()) == [("7", "2024-01-15"), ("P0001", "2023-01-01"), ("P0001", "2024-01-15"), ("P0001", "2024-03-16"), ("P0001", "2024-06-01")]
    errors = sorted(e for e, _ in bad_rows(spark, bad))
    assert errors == ["DailySumMismatchError"] + ["RowValidationError"] * 5 + ["StockCounterError"] * 2
    assert spark.read.parquet(f"{bad}_repeats").count() == 3
    assert sum(map(len, runs)) == 5 + 8 + 3


def test_a_batch_that_is_tried_again_leaves_its_rows_once(spark, tmp_path):
    source, good, bad, check = (str(tmp_path / x) for x in ("in", "good", "bad", "check"))
    spark.createDataFrame([raw(), raw(), raw(dt="x"), raw(dt="2024-01-16")], RAW).coalesce(1).write.parquet(source)
    ingest(read_stream(spark, source), "rev", good, bad, check).awaitTermination(120)
    # The stream dies after its writes, before it notes that the batch is done.
    (tmp_path / "check" / "commits" / "0").unlink()
    (tmp_path / "check" / "commits" / ".0.crc").unlink(missing_ok=True)
    ingest(read_stream(spark, source), "rev", good, bad, check).awaitTermination(120)
    assert read_panel(spark, good).count() == 2 and len(bad_rows(spark, bad)) == 1 and spark.read.parquet(f"{bad}_repeats").count() == 1
