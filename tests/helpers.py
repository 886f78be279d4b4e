from datetime import date, timedelta

from shelfcast import schema

RAW = "product_id string, dt string, sale_amount double, hours_sale array<double>, hours_stock_status array<int>, stock_hour6_22_cnt int"


def raw(**changed):
    """One valid raw row, with changes."""
    status = changed.get("hours_stock_status", [0] * 24)
    sales = changed.get("hours_sale", [1.0] * 24)
    row = {"product_id": "P0001", "dt": "2024-01-15", "sale_amount": float(sum(x or 0 for x in sales)), "hours_sale": sales, "hours_stock_status": status, "stock_hour6_22_cnt": sum(x == 1 for x in status[6:22])}
    return tuple((row | changed)[k] for k in ("product_id", "dt", "sale_amount", "hours_sale", "hours_stock_status", "stock_hour6_22_cnt"))


def day(product, dt, sale, stockouts=0, revision="test-rev"):
    """One panel row: the day's sales in hour 0, stockouts from hour 6 on."""
    status = [1 if 6 <= h < 6 + stockouts else 0 for h in range(24)]
    return (product, product.lstrip("-").isdigit(), dt, float(sale), [float(sale)] + [0.0] * 23, status, stockouts, stockouts, revision)


def panel(spark, rows):
    return spark.createDataFrame(rows, schema.PANEL)


def evaluation_rows():
    """A: 20 days, sale = day of month. C: six days of 5. Stockouts on some."""
    start = date(2024, 1, 1)
    a = {12: 1, 15: 2, 18: 2}
    c = {15: 3, 18: 3}
    rows = [day("A", start + timedelta(i), i + 1, a.get(i + 1, 0)) for i in range(20)]
    return rows + [day("C", date(2024, 1, d), 5, c.get(d, 0)) for d in range(14, 20)]
