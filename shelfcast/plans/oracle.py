"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple


class Ranges(NamedTuple):
    """The days of a fold as this file knows them: written out, not taken from the code that it checks."""

    fold: str
    train: tuple[str, str]
    validation: tuple[str, str]
    test: tuple[str, str]
    days: int = 1
    span: int = 1

    def parts(self) -> list[tuple[str, str, str]]:
        return [("train", *self.train), ("validation", *self.validation), ("test", *self.test)]


FOLDS = [
    Ranges("fold-1", ("2024-01-01", "2024-01-18"), ("2024-01-19", "2024-01-21"), ("2024-01-22", "2024-01-24")),
    Ranges("fold-2", ("2024-01-01", "2024-01-24"), ("2024-01-25", "2024-01-27"), ("2024-01-28", "2024-01-30")),
]
GAPPED = [Ranges("gapped", ("2024-01-03", "2024-01-15"), ("2024-01-18", "2024-01-20"), ("2024-01-24", "2024-01-28"), 12, 13)]
EXPANDING = [
    Ranges("1", ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-13"), ("2024-01-25", "2024-01-28")),
    Ranges("2", ("2024-01-01", "2024-01-13"), ("2024-01-14", "2024-01-16"), ("2024-01-25", "2024-01-28")),
    Ranges("3", ("2024-01-01", "2024-01-16"), ("2024-01-17", "2024-01-19"), ("2024-01-25", "2024-01-28")),
    Ranges("4", ("2024-01-01", "2024-01-19"), ("2024-01-20", "2024-01-22"), ("2024-01-25", "2024-01-28")),
]
EDGE = Ranges("edge", ("2023-12-28", "2024-01-20"), ("2024-01-21", "2024-01-25"), ("2024-01-26", "2024-02-05"))
OVERLAP = Ranges("overlap", ("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-22"), ("2024-01-15", "2024-01-25"))

PANEL = """h AS (SELECT user_id::VARCHAR product_id, ts::DATE dt, hour(ts) hr, CAST(sum(CAST(coalesce(value, 0) AS DECIMAL(18,2))) AS DOUBLE) v, sum(CAST(coalesce(value, 0) AS DECIMAL(18,2))) dv, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) s FROM events GROUP BY ALL),
p AS (SELECT product_id, dt, CAST(sum(dv) AS DOUBLE) y, coalesce(sum(s) FILTER (hr BETWEEN 6 AND 21), 0)::INTEGER so, max(s) anyso FROM h GROUP BY ALL)"""


def ranges(folds: Sequence[Ranges]) -> str:
    values = ", ".join(f"({i}, '{f.fold}', '{p}', DATE '{a}', DATE '{z}')" for i, f in enumerate(folds) for p, a, z in f.parts())
    return f"f(fold_rank, fold, part, a, z) AS (VALUES {values}), x AS (SELECT fold_rank, fold, part, p.* FROM p JOIN f ON dt BETWEEN a AND z)"


def forecasts(folds: Sequence[Ranges], partition: str, source: str = "x") -> str:
    fit = "part = 'train'" if partition == "validation" else "part IN ('train', 'validation')"
    return f"""hist AS (SELECT fold, product_id, list(y ORDER BY dt) q FROM {source} WHERE {fit} GROUP BY ALL),
t AS (SELECT * FROM {source} WHERE part = '{partition}'),
s AS (SELECT t.fold_rank, t.fold, t.product_id, t.dt, t.y, t.so, q, l.y lag7 FROM t LEFT JOIN hist USING (fold, product_id) LEFT JOIN (SELECT * FROM {source} WHERE {fit}) l ON l.fold = t.fold AND l.product_id = t.product_id AND l.dt + 7 = t.dt),
fc AS (SELECT 0 mr, 'naive' model, s.*, q[len(q)] pred FROM s
 UNION ALL SELECT 1, 'seasonal_naive', s.*, lag7 FROM s
 UNION ALL SELECT 2, 'moving_average', s.*, list_avg(q[greatest(len(q) - 6, 1):]) FROM s
 UNION ALL SELECT 3, 'ses', s.*, CASE WHEN len(q) > 0 THEN list_reduce(q, lambda a, b: 0.3 * b + 0.7 * a) END FROM s),
why AS (SELECT *, CASE WHEN pred IS NULL THEN CASE WHEN q IS NULL THEN 'no training history for product' ELSE 'no seasonal lag observation in training' END END reason FROM fc)"""


def grid(folds: Sequence[Ranges], partition: str) -> str:
    names = ", ".join(f"({i}, '{f.fold}')" for i, f in enumerate(folds))
    return f"""WITH {PANEL}, {ranges(folds)}, {forecasts(folds, partition)},
g AS (SELECT * FROM (VALUES {names}) a(fold_rank, fold), (VALUES (0, 'naive'), (1, 'seasonal_naive'), (2, 'moving_average'), (3, 'ses')) b(mr, model)),
e AS (SELECT fold, model, count(*) requested, count(pred) available, sum(CASE WHEN pred IS NOT NULL AND so > 0 THEN 1 ELSE 0 END) so, avg(abs(pred - y)) mae, sqrt(avg((pred - y) ** 2)) rmse, sum(abs(pred - y)) num, sum(abs(y)) FILTER (pred IS NOT NULL) den, avg(pred - y) bias FROM fc GROUP BY ALL),
m AS (SELECT g.fold_rank, g.fold, g.mr model_rank, g.model, coalesce(requested, 0)::BIGINT requested, coalesce(available, 0)::BIGINT available, (coalesce(requested, 0) - coalesce(available, 0))::BIGINT unavailable, coalesce(available, 0)::BIGINT evaluated,
 coalesce(available / requested, 0.0)::DOUBLE coverage, coalesce(so, 0)::BIGINT stockout_rows, mae, rmse, CASE WHEN den <> 0 THEN num / den END wmape, bias,
 CASE WHEN coalesce(available, 0) = 0 THEN 'no_evaluable_predictions' WHEN den = 0 THEN 'not_calculable_zero_actuals' ELSE 'calculable' END wmape_status FROM g LEFT JOIN e USING (fold, model)),
l AS (SELECT fold_rank, fold, model_rank, model, 0 metric_rank, 'mae' metric, mae value FROM m UNION ALL SELECT fold_rank, fold, model_rank, model, 1, 'rmse', rmse FROM m UNION ALL SELECT fold_rank, fold, model_rank, model, 2, 'wmape', wmape FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY fold, metric ORDER BY value, model_rank) r, max(value) OVER (PARTITION BY fold, metric) top FROM l WHERE value IS NOT NULL),
best AS (SELECT * FROM o WHERE r = 1),
won AS (SELECT coalesce(max(n) = 3 * (SELECT count(DISTINCT fold) FROM m), false) has_universal_winner FROM (SELECT model, count(*) n FROM best GROUP BY model)) """


MEASURES = "fold, model, requested, available, unavailable, evaluated, round(coverage, 6) coverage, stockout_rows, round(mae, 6) mae, round(rmse, 6) rmse, round(wmape, 6) wmape, round(bias, 6) + 0.0 bias, wmape_status"
FORECAST = "SELECT model, fold, product_id, dt, y observed_sales, round(pred, 6) prediction, reason unavailable_reason FROM why"
COUNTS = """SELECT f.fold, {parts}, ((SELECT count(*) FROM p) - count(x.dt))::BIGINT excluded_out_of_range FROM (SELECT DISTINCT fold FROM f) f LEFT JOIN x USING (fold) GROUP BY f.fold""".format(
    parts=", ".join(f"count(*) FILTER (x.part = '{p}') {p}_rows" for p in ("train", "validation", "test"))
)
PLACES = lambda c, n: f"coalesce(printf('%.{n}f', {c}), '—')"
DOTS = lambda c: f"replace(format('{{:,}}', {c}), ',', '.')"


def _short(counted: str, universe: str) -> str:
    g = GAPPED[0]
    return f"""WITH {PANEL}, {ranges(GAPPED)}, n AS (SELECT fold, product_id, count(dt) FILTER ({counted})::INTEGER observed_days, coalesce((max(dt) FILTER ({counted}) - min(dt) FILTER ({counted})) + 1, 0)::INTEGER observed_span_days FROM x WHERE {universe} GROUP BY ALL)
    SELECT *, {g.days}::INTEGER required_days, {g.span}::INTEGER required_span_days FROM n WHERE observed_days < {g.days} OR observed_span_days < {g.span}"""


def _panel(select: str) -> str:
    return f"WITH {PANEL} {select}"


def _folds(select: str, folds: Sequence[Ranges] = FOLDS) -> str:
    return f"WITH {PANEL}, {ranges(folds)} {select}"


def _forecast(model: str | None) -> str:
    return f"WITH {PANEL}, {ranges(FOLDS)}, {forecasts(FOLDS, 'test')} {FORECAST}" + (f" WHERE model = '{model}'" if model else "")


def _test(select: str) -> str:
    return grid(FOLDS, "test") + select


STATE = "CASE WHEN {} = 1 THEN 'censored_or_partial' ELSE 'uncensored' END"
BROKEN = """b AS (SELECT product_id true_id, dt true_dt, (product_id::INTEGER + day(dt)) % 11 k FROM p), e AS (SELECT true_id, true_dt, CASE k WHEN 1 THEN 'RowValidationError' WHEN 2 THEN 'RowValidationError' WHEN 3 THEN 'DailySumMismatchError' WHEN 4 THEN 'HourlyVectorLengthError' WHEN 5 THEN 'StockStatusValueError' WHEN 6 THEN 'StockCounterError' END error FROM b)"""
GAP_ALL = ("2024-01-03", "2024-01-28")
SEGMENTS = "('fold-1', 0, 'train', 18), ('fold-1', 1, 'validation', 3), ('fold-1', 2, 'test', 3), ('fold-2', 0, 'train', 24), ('fold-2', 1, 'validation', 3), ('fold-2', 2, 'test', 3)"

ORACLE: dict[str, str] = {
    "daily_panel": _panel("SELECT product_id, dt, y sale_amount, so stock_hour6_22_cnt, so stockout_hours_6_22 FROM p"),
    "hourly_expansion": _panel(f"SELECT p.product_id, p.dt, r.hr::INTEGER AS hour, coalesce(v, 0.0) sales_qty_observed, coalesce(s, 0) = 1 stockout_flag, {STATE.format('coalesce(s, 0)')} sales_observation_state FROM p CROSS JOIN range(24) r(hr) LEFT JOIN h ON h.product_id = p.product_id AND h.dt = p.dt AND h.hr = r.hr"),
    "hourly_stockout_window": _panel("SELECT so stockout_hours_6_22, count(*) n FROM p GROUP BY 1"),
    "target_projection": _panel(f"SELECT product_id, dt, y observed_sales, so stockout_hours_6_22, {STATE.format('anyso')} observation_state FROM p"),
    "observation_state_counts": _panel(f"SELECT {STATE.format('anyso')} observation_state, count(*) n FROM p GROUP BY 1"),
    "snapshot_summary": _panel("SELECT count(*) total_rows, count(DISTINCT product_id) unique_products FROM p"),
    "duplicate_keys": "SELECT user_id::VARCHAR product_id, ts::DATE dt, count(*) n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "distinct_revisions": _panel("SELECT 'events' revision, count(*) n FROM p"),
    "row_validation": _panel(f", {BROKEN} SELECT * FROM e"),
    "quarantine_counts": _panel(f", {BROKEN} SELECT error, count(*) n FROM e WHERE error IS NOT NULL GROUP BY 1"),
    "daily_sum_check": _panel("SELECT count(*) n, count(*) FILTER (abs(t - y) <= greatest(1e-9 * greatest(abs(t), abs(y)), 1e-6)) n_close FROM p JOIN (SELECT product_id, dt, sum(v) t FROM h GROUP BY ALL) USING (product_id, dt)"),
    "stock_counter_check": _panel("SELECT count(*) n_equal, sum(so)::BIGINT AS hours FROM p"),
    "partition_rows": _folds(COUNTS),
    "excluded_rows": _folds(f"SELECT fold, excluded_out_of_range FROM ({COUNTS})", GAPPED),
    "split_assignment": _folds("SELECT product_id, dt, fold, part FROM x", GAPPED),
    "missing_dates_global": _folds("SELECT fold, part, c::DATE dt FROM (SELECT fold, part, unnest(generate_series(a, z, INTERVAL 1 DAY)) c FROM f) WHERE c::DATE NOT IN (SELECT dt FROM p)", [*FOLDS, EDGE]),
    "missing_dates_per_product": _folds(f"SELECT fold, product_id, c::DATE dt FROM (SELECT DISTINCT fold, product_id FROM x) u CROSS JOIN (SELECT unnest(generate_series(DATE '{GAP_ALL[0]}', DATE '{GAP_ALL[1]}', INTERVAL 1 DAY)) c) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.fold = u.fold AND x.product_id = u.product_id AND x.dt = c::DATE)", GAPPED),
    "insufficient_history": _short("part = 'train'", "true"),
    "insufficient_fit_history": _short("part IN ('train', 'validation')", "true"),
    "fit_bounds": _folds("SELECT f.fold, count(x.dt) fit_row_count, min(x.dt) fit_history_start, max(x.dt) fit_history_end FROM (SELECT DISTINCT fold FROM f) f LEFT JOIN x ON x.fold = f.fold AND x.part IN ('train', 'validation') GROUP BY f.fold"),
    "expanding_folds_counts": _folds(COUNTS, EXPANDING),
    "future_target_guard": _folds("SELECT t.fold, count(*) n FROM x t JOIN (SELECT fold, product_id, max(dt) m FROM x WHERE part <> 'test' GROUP BY ALL) USING (fold, product_id) WHERE t.part = 'test' AND t.dt <= m GROUP BY t.fold", [*FOLDS, OVERLAP]),
    "fit_test_overlap": _folds("SELECT fold, count(*) n FROM (SELECT fold, product_id, dt FROM x WHERE part <> 'test' INTERSECT SELECT fold, product_id, dt FROM x WHERE part = 'test') GROUP BY fold", [*FOLDS, OVERLAP]),
    "naive_forecast": _forecast("naive"),
    "seasonal_naive_forecast": _forecast("seasonal_naive"),
    "moving_average_forecast": _forecast("moving_average"),
    "ses_forecast": _forecast("ses"),
    "forecast_all_long": _forecast(None),
    "unavailable_reasons": f"WITH {PANEL}, {ranges(GAPPED)}, {forecasts(GAPPED, 'test')} SELECT model, reason unavailable_reason, count(*) n FROM why WHERE pred IS NULL GROUP BY 1, 2",
    "metrics_validation": grid(FOLDS, "validation") + f"SELECT {MEASURES} FROM m",
    "metrics_test": _test(f"SELECT {MEASURES} FROM m"),
    "evaluation_grid": _test(f"SELECT {MEASURES}, 'baseline-evaluation-v2' protocol FROM m"),
    "wmape_status": f"WITH {PANEL.replace('p AS (', 'p0 AS (')}, p AS (SELECT * REPLACE (CASE WHEN product_id::INTEGER % 3 = 0 THEN 0.0 ELSE y END AS y) FROM p0), {ranges(FOLDS)}, {forecasts(FOLDS, 'test')} SELECT fold, model, (product_id::INTEGER % 3)::INTEGER third, count(pred) evaluated, CASE WHEN count(pred) = 0 THEN 'no_evaluable_predictions' WHEN sum(abs(y)) FILTER (pred IS NOT NULL) = 0 THEN 'not_calculable_zero_actuals' ELSE 'calculable' END wmape_status FROM fc GROUP BY ALL",
    "coverage_facts": _panel("SELECT count(*) AS rows, count(DISTINCT product_id) products, min(dt) date_min, max(dt) date_max, (max(dt) - min(dt) + 1)::INTEGER calendar_span_days, count(*) FILTER (so > 0) stockout_rows, count(*) FILTER (anyso = 1) rows_with_any_observed_stockout_status, (max(dt) - min(dt) + 1 - count(DISTINCT dt))::INTEGER missing_dates FROM p"),
    "missing_dates_by_product": _panel("SELECT product_id, c::DATE dt FROM (SELECT DISTINCT product_id FROM p) u CROSS JOIN (SELECT unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) c FROM p) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.product_id = u.product_id AND p.dt = c::DATE)"),
    "seasonal_naive_by_fold": _test("SELECT fold, available, requested, round(coverage, 6) coverage, wmape_status FROM m WHERE model = 'seasonal_naive'"),
    "coverage_complete": _test("SELECT bool_and(coverage = 1.0) coverage_complete FROM m"),
    "results_table": _test("SELECT fold, model, round(mae, 6) mae, round(rmse, 6) rmse, round(wmape, 6) wmape, round(bias, 6) + 0.0 bias, round(coverage, 6) coverage, available, requested, evaluated, stockout_rows FROM m WHERE fold = 'fold-2'"),
    "argmin_by_fold_metric": _test("SELECT fold, metric, model, round(value, 6) value FROM best"),
    "universal_winner": _test("SELECT * FROM won"),
    "stockout_facts": _test("SELECT fold, CASE WHEN count(DISTINCT stockout_rows) = 1 THEN max(stockout_rows) END stockout_rows FROM m GROUP BY fold"),
    "comparison_data": _test(f"SELECT fold, 'Partition ' || (fold_rank + 1) fold_label, metric, model, round(value, 6) AS value, {PLACES('value', 3)} formatted, r = 1 is_min FROM o"),
    "comparison_min_values": _test(f"SELECT fold, metric, {PLACES('value', 3)} minimum FROM best"),
    "comparison_equivalent_rows": _test(f"SELECT 'Partition ' || (fold_rank + 1) fold_label, metric, model, {PLACES('value', 3)} formatted, CASE WHEN r = 1 THEN 'smallest value' ELSE '' END minimum FROM o"),
    "bar_widths": _test("SELECT fold, metric, model, round(coalesce(value / nullif(top, 0), 0.0), 6) width FROM o"),
    "conclusion_summary": _test("SELECT fold, " + ", ".join(f"max(model) FILTER (metric = '{m}') {m}_model, round(max(value) FILTER (metric = '{m}'), 6) {m}_value" for m in ("mae", "rmse", "wmape")) + " FROM best GROUP BY fold"),
    "observations": _test(f"SELECT model || ' has the smallest ' || upper(metric) || ' in ' || fold || ' (' || {PLACES('value', 3)} || ').' AS text FROM best UNION ALL SELECT 'No single model has the smallest error for every metric in both folds.' FROM won WHERE NOT has_universal_winner"),
    "localized_observations": _test(f"""SELECT 'En la Partición ' || (fold_rank + 1) || ', el ' || CASE model WHEN 'naive' THEN 'último valor' WHEN 'seasonal_naive' THEN 'naive estacional' WHEN 'moving_average' THEN 'promedio móvil' ELSE 'suavizamiento exponencial' END || ' tiene el ' || upper(metric) || ' más bajo (' || {PLACES('value', 3)} || ').' AS text FROM best
 UNION ALL SELECT 'Líneas base evaluadas: Último valor, Naive estacional, Promedio móvil y Suavizamiento exponencial.'
 UNION ALL SELECT 'Ningún modelo individual tiene el error más bajo en todas las métricas de ambas particiones.' FROM won WHERE NOT has_universal_winner"""),
    "fold_labels": _test("SELECT DISTINCT fold, 'Partición ' || (fold_rank + 1) AS label FROM m"),
    "report_table_rows": _test(f"SELECT 'Partition ' || (fold_rank + 1) AS partition, model, {', '.join(f'{PLACES(c, 3)} {c}' for c in ('mae', 'rmse', 'wmape', 'bias'))}, {PLACES('coverage', 2)} coverage, {', '.join(f'{DOTS(c)} {c}' for c in ('available', 'requested', 'evaluated', 'stockout_rows'))} FROM m"),
    "protocol_segments": f"WITH v(fold, i, segment, days) AS (VALUES {SEGMENTS}), w AS (SELECT *, round_even(100.0 * days / sum(days) OVER (PARTITION BY fold), 1) share FROM v) SELECT fold, segment, days::INTEGER AS days, (CASE WHEN i = 2 THEN round_even(100.0 - s, 1) ELSE share END)::DOUBLE width FROM (SELECT *, sum(CASE WHEN i < 2 THEN share END) OVER (PARTITION BY fold) s FROM w) w",
    "stockout_share": _panel("SELECT count(*) AS rows, count(*) FILTER (so > 0) stockout_rows, round(100.0 * count(*) FILTER (so > 0) / count(*), 6)::DOUBLE stockout_percent FROM p"),
    "bounded_prefix": "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 100",
    "product_sort_order": _panel("SELECT product_id, row_number() OVER (ORDER BY product_id)::INTEGER place FROM (SELECT DISTINCT product_id FROM p)"),
    "brand_daily_panel": "SELECT p_brand product_id, l_shipdate::DATE dt, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) sale_amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
}
