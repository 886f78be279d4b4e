import pytest
from helpers import RAW, raw

from shelfcast import errors
from shelfcast.functions.rows import checked, parse_daily_rows, quarantine, validate_revision
from shelfcast.operators import panel
from shelfcast.sources import daily

STATUS_22 = [0] * 22 + [1, 0]
BAD = {
    "HourlyVectorLengthError": [{"hours_sale": [1.0] * 23}, {"hours_stock_status": [0] * 25}],
    "StockStatusValueError": [{"hours_stock_status": [2] + [0] * 23}, {"hours_stock_status": [None] + [0] * 23, "stock_hour6_22_cnt": 0}],
    "StockCounterError": [{"stock_hour6_22_cnt": 5}],
    "DailySumMismatchError": [{"sale_amount": 25.0}, {"sale_amount": float("nan")}, {"hours_sale": [float("inf")] + [0.0] * 23, "sale_amount": 1.0}],
    "RowValidationError": [{"dt": None}, {"dt": "2024-1-5"}, {"dt": "2024-02-30"}, {"product_id": "  "}, {"product_id": None}, {"sale_amount": None}, {"stock_hour6_22_cnt": -1}, {"hours_sale": [None] + [1.0] * 23, "sale_amount": 24.0}],
}
GOOD = [{}, {"hours_stock_status": STATUS_22}, {"hours_sale": [0.1] * 24, "sale_amount": 2.4}, {"product_id": "38", "hours_stock_status": [0] * 21 + [1, 1, 1], "hours_sale": [float(h) for h in range(24)]}]


def test_first_broken_rule_names_the_error(spark):
    cases = [(k, raw(**c)) for k, cs in BAD.items() for c in cs] + [(None, raw(**c)) for c in GOOD]
    rows = checked(spark.createDataFrame([(i, *r) for i, (_, r) in enumerate(cases)], f"i int, {RAW}"), "rev")
    got = {r["i"]: r["error"] for r in rows.collect()}
    assert [got[i] for i in range(len(cases))] == [k for k, _ in cases]


def test_vector_length_goes_before_the_sum(spark):
    both = raw(hours_sale=[1.0] * 23, sale_amount=99.0)
    assert checked(spark.createDataFrame([both], RAW), "rev").first()["error"] == "HourlyVectorLengthError"


def test_parse_raises_the_first_by_ordinal_and_quarantine_parts(spark):
    rows = spark.createDataFrame([(2, *raw(stock_hour6_22_cnt=9)), (1, *raw(sale_amount=9.0)), (0, *raw())], f"ordinal int, {RAW}")
    with pytest.raises(errors.DailySumMismatchError):
        parse_daily_rows(rows, "rev", "ordinal")
    good, bad = quarantine(rows, "rev")
    assert good.count() == 1 and bad.count() == 2


def test_whole_number_ids_are_canonical_and_come_first(spark):
    ids = ["P0001", " 38 ", "+38", "4", "379", "-0", "007", "1_000", "99999999999999999999", "P 2"]
    rows = parse_daily_rows(spark.createDataFrame([raw(product_id=x) for x in ids], RAW), "rev")
    assert [r["product_id"] for r in rows.select("product_id", "product_is_int").distinct().orderBy(*panel.product_order()).collect()] == ["0", "1000", "379", "38", "4", "7", "99999999999999999999", "P 2", "P0001"]


def test_date_stands_in_for_dt(spark):
    rows = spark.createDataFrame([(*raw(dt=None), "2024-03-01"), (*raw(dt="2024-03-02"), "2024-03-09")], f"{RAW}, date string")
    assert sorted(r["dt"].isoformat() for r in parse_daily_rows(rows, "rev").collect()) == ["2024-03-01", "2024-03-02"]


def test_revision_and_limits():
    assert validate_revision(" r ") == "r"
    with pytest.raises(errors.UnpinnedRevisionError):
        validate_revision("  ")
    for limit in (0, 1001, True, 1.0):
        with pytest.raises(errors.InvalidStreamLimitError):
            daily.validate_stream_limit(limit)
    with pytest.raises(errors.NonPinnedRevisionError):
        daily.validate_stream_revision("other")
    with pytest.raises(errors.UnpinnedRevisionError):
        daily.validate_stream_revision("")


def test_bounded_stream_never_validates_past_its_limit(spark):
    rows = spark.createDataFrame([(0, *raw()), (1, *raw(dt="2024-01-16")), (2, *raw(sale_amount=1.0))], f"ordinal int, {RAW}")
    assert daily.stream_daily(spark, 2, lambda s, r, split: rows).count() == 2
    with pytest.raises(errors.DailySumMismatchError):
        daily.stream_daily(spark, 3, lambda s, r, split: rows)
    with pytest.raises(errors.FreshRetailDomainError):
        daily.acquire(spark, "rev")


def test_snapshot(spark):
    rows = parse_daily_rows(spark.createDataFrame([raw(product_id=x) for x in ("38", " 38", "P1")], RAW), "rev")
    assert panel.validate_global_snapshot(rows, context=panel.SnapshotContext.COMPLETE, expected_unique_products=2) == {"total_rows": 3, "unique_products": 2}
    with pytest.raises(errors.GlobalSnapshotError):
        panel.validate_global_snapshot(rows, context=panel.SnapshotContext.COMPLETE)
    with pytest.raises(errors.GlobalSnapshotError):
        panel.validate_global_snapshot(rows.limit(0), context=panel.SnapshotContext.BOUNDED)
    with pytest.raises(TypeError):
        panel.validate_global_snapshot(rows, context="complete")
    with pytest.raises(errors.DuplicateKeyError):
        panel.require_unique(rows)


def test_hourly_and_targets(spark):
    rows = parse_daily_rows(spark.createDataFrame([raw(hours_stock_status=STATUS_22)], RAW), "rev")
    hours = panel.expand_to_hourly(rows).orderBy("hour").collect()
    assert len(hours) == 24 and [h["hour"] for h in hours if h["stockout_flag"]] == [22]
    assert hours[22]["sales_qty_observed"] == 1.0 and hours[22]["sales_observation_state"] == "censored_or_partial" and hours[0]["latent_demand_estimate"] is None
    target = panel.project_targets(rows).first()
    assert target["stockout_hours_6_22"] == 0 and target["observation_state"] == "censored_or_partial"


def test_ids_lose_white_space_of_any_kind(spark):
    rows = checked(spark.createDataFrame([raw(product_id=x) for x in ("\t38", "38\n", " 38 ", " \x1cP1\r\n", "\t\n", "　")], RAW), "rev").collect()
    assert [r["product_id"] for r in rows] == ["38", "38", "38", "P1", "", ""] and [r["error"] for r in rows] == [None] * 4 + ["RowValidationError"] * 2


def test_product_places(spark):
    ids = ["379", "38", "4", "411", "-5", "0", "40000123", "40001", "P1", "P0001", "abc", "abcd", "abcde", "Ä"]
    df = spark.createDataFrame([(x, x.lstrip("-").isdigit()) for x in ids], "product_id string, product_is_int boolean")
    want = [r["product_id"] for r in df.orderBy(*panel.product_order()).collect()]
    assert {r["product_id"]: r["place"] for r in panel.product_places(df).collect()} == {x: i + 1 for i, x in enumerate(want)}
    assert panel.product_places(df.limit(0)).count() == 0
