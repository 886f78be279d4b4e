"""Schemas and fixed values of the daily panel."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import types as T

# Fixed values.
HOURS_PER_DAY = 24
WINDOW_FIRST_HOUR, WINDOW_END_HOUR = 6, 22
SUM_REL_TOL, SUM_ABS_TOL = 1e-9, 1e-6
EXPECTED_UNIQUE_PRODUCTS = 865
MAX_STREAM_ROWS = 1000
PINNED_REVISION = "08c1fab7f9257bc73679d415d65d644165d351d4"
SEASON_DAYS = 7
MOVING_AVERAGE_WINDOW = 7
SES_ALPHA = 0.3
TARGET = "observed_sales"
STATE_OBSERVED = "uncensored"
STATE_CENSORED = "censored_or_partial"
REASON_NO_HISTORY = "no training history for product"
REASON_NO_SEASONAL_LAG = "no seasonal lag observation in training"
PREDICTION_AVAILABLE, PREDICTION_UNAVAILABLE = "available", "unavailable"
WMAPE_CALCULABLE = "calculable"
WMAPE_ZERO_ACTUALS = "not_calculable_zero_actuals"
WMAPE_NO_EVALUABLE = "no_evaluable_predictions"
PROTOCOL_VERSION = "baseline-evaluation-v2"
MODELS = ("naive", "seasonal_naive", "moving_average", "ses")
PARTS = ("train", "validation", "test")
FIT_TRAIN, FIT_TRAIN_AND_VALIDATION = "train", "train+validation"
ObservationState = Literal["uncensored", "censored_or_partial"]
EvaluationPartition = Literal["validation", "test"]

RAW = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("dt", T.StringType()),
    T.StructField("sale_amount", T.DoubleType()),
    T.StructField("hours_sale", T.ArrayType(T.DoubleType())),
    T.StructField("hours_stock_status", T.ArrayType(T.IntegerType())),
    T.StructField("stock_hour6_22_cnt", T.IntegerType()),
])

PANEL = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_is_int", T.BooleanType()),
    T.StructField("dt", T.DateType()),
    T.StructField("sale_amount", T.DoubleType()),
    T.StructField("hours_sale", T.ArrayType(T.DoubleType())),
    T.StructField("hours_stock_status", T.ArrayType(T.IntegerType())),
    T.StructField("stock_hour6_22_cnt", T.IntegerType()),
    T.StructField("stockout_hours_6_22", T.IntegerType()),
    T.StructField("revision", T.StringType()),
])

TARGET_ROW = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_is_int", T.BooleanType()),
    T.StructField("dt", T.DateType()),
    T.StructField(TARGET, T.DoubleType()),
    T.StructField("stockout_hours_6_22", T.IntegerType()),
    T.StructField("observation_state", T.StringType()),
    T.StructField("revision", T.StringType()),
    T.StructField("latent_demand_estimate", T.DoubleType()),
])

FORECAST_ROW = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("model_rank", T.IntegerType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("dt", T.DateType()),
    T.StructField(TARGET, T.DoubleType()),
    T.StructField("prediction", T.DoubleType()),
    T.StructField("prediction_state", T.StringType()),
    T.StructField("unavailable_reason", T.StringType()),
    T.StructField("stockout_hours_6_22", T.IntegerType()),
    T.StructField("observation_state", T.StringType()),
    T.StructField("revision", T.StringType()),
])

METRICS_ROW = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("requested", "available", "unavailable", "evaluated")],
    T.StructField("coverage", T.DoubleType()),
    T.StructField("stockout_rows", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("mae", "rmse", "wmape", "bias")],
    T.StructField("wmape_status", T.StringType()),
])

MISSING_ROW = T.StructType([T.StructField("product_id", T.StringType()), T.StructField("dates", T.ArrayType(T.DateType()))])
HISTORY_ROW = T.StructType([T.StructField("product_id", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("observed_days", "observed_span_days", "required_days", "required_span_days")]])
