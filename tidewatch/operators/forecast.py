"""Hourly series: loading, history gate, seasonal quantile forecast, rolling backtest.

Many series are handled side by side; a series is as long as its hours, never as
long as the event table it was counted from.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scoring import stable_round

MIN_HISTORY_HOURS = 24 * 14
QUANTILES = (0.1, 0.5, 0.9)
ENCODER_HOURS = 24 * 7
MIN_SLOT_VALUES = 3


def read_hourly_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ``timestamp,value`` to the mean per hour."""
    rows = spark.read.csv(path, header=True, schema="timestamp string, value double")
    return hourly_mean(rows.select(F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value"))


def hourly_mean(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*keys, F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))


def fill_hours(hourly: DataFrame, value: str = "value") -> DataFrame:
    """(series, ts, idx, value): every hour between a series' first and last, gaps as 0."""
    spans = hourly.groupBy("series").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spine = spans.select("series", F.posexplode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("idx", "ts"))
    filled = spine.join(hourly.select("series", "ts", F.col(value).cast("double").alias("value")), ["series", "ts"], "left")
    return filled.withColumn("value", F.coalesce("value", F.lit(0.0)))


def history_gate(hourly: DataFrame, need_hours: int = MIN_HISTORY_HOURS) -> DataFrame:
    """Per series: enough hours to forecast from, or how many days are missing."""
    return hourly.groupBy("series").agg(F.count("*").alias("hours")).select(
        "series",
        "hours",
        F.when(F.col("hours") < need_hours, "insufficient_history").otherwise("ok").alias("status"),
        F.round(F.col("hours") / 24, 1).alias("have_days"),
        F.lit(need_hours / 24).alias("need_days"),
    )


def calendar(ts: Column) -> dict[str, Column]:
    """Cyclic encodings of the hour and the weekday (Monday is 0)."""
    hour, day = 2 * math.pi * F.hour(ts) / 24, 2 * math.pi * F.weekday(ts) / 7
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)}


def pinball_loss(actual: Column, predicted: Column, q: float) -> Column:
    error = actual - predicted
    return F.greatest(q * error, (q - 1) * error)


# --- forecast --------------------------------------------------------------------------


def _slots(train: DataFrame, keys: list[str], quantiles: tuple[float, ...], prefix: str) -> DataFrame:
    return train.groupBy(*keys).agg(
        F.percentile("value", F.array(*[F.lit(q) for q in quantiles])).alias(f"{prefix}_q"), F.count("*").alias(f"{prefix}_n")
    )


def _predict(train: DataFrame, targets: DataFrame, keys: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """Quantiles of the (weekday, hour) slot of each target, or of its hour when the slot is thin."""
    slotted = train.withColumns({"day": F.weekday("ts"), "hour": F.hour("ts")})
    weekly = _slots(slotted, [*keys, "day", "hour"], quantiles, "week")
    daily = _slots(slotted, [*keys, "hour"], quantiles, "hour_of_day")
    wanted = targets.withColumns({"day": F.weekday("horizon_ts"), "hour": F.hour("horizon_ts")})
    joined = wanted.join(weekly, [*keys, "day", "hour"], "left").join(daily, [*keys, "hour"], "left")
    picked = F.when(F.coalesce("week_n", F.lit(0)) >= MIN_SLOT_VALUES, F.col("week_q")).otherwise(F.col("hour_of_day_q"))
    names = [f"p{int(round(q * 100))}" for q in quantiles]
    # Rounded, so that a value that equals a quantile counts as inside the band.
    return joined.withColumn("_q", picked).select(*targets.columns, *[F.round(F.col("_q")[i], 9).alias(n) for i, n in enumerate(names)])


def quantile_forecast(series: DataFrame, horizon: int = 48, quantiles: tuple[float, ...] = QUANTILES, need_hours: int = MIN_HISTORY_HOURS) -> DataFrame:
    """(series, issued_at, horizon_ts, p10, p50, p90) for the hours after each series' end.

    ``series`` is the output of :func:`fill_hours`.  Series without enough history
    give no rows.
    """
    ends = series.groupBy("series").agg(F.max("ts").alias("issued_at"), F.count("*").alias("hours")).filter(F.col("hours") >= need_hours)
    hour = F.expr("INTERVAL 1 HOUR")
    ahead = F.sequence(F.col("issued_at") + hour, F.col("issued_at") + F.make_interval(hours=F.lit(horizon)), hour)
    targets = ends.select("series", "issued_at", F.explode(ahead).alias("horizon_ts"))
    return _predict(series.join(ends.select("series"), "series", "left_semi"), targets, ["series"], quantiles)


# --- backtest --------------------------------------------------------------------------


def origins(series: DataFrame, test_days: int = 21, step: int = 12, horizon: int = 24, need_hours: int = MIN_HISTORY_HOURS) -> DataFrame:
    """(series, origin): forecast starts rolled over the held-out end of each series."""
    sizes = series.groupBy("series").agg(F.count("*").cast("int").alias("n")).withColumn("first", F.col("n") - test_days * 24)
    usable = sizes.filter((F.col("first") >= need_hours) & (F.col("first") < F.col("n") - horizon))
    return usable.select("series", F.explode(F.sequence(F.col("first"), F.col("n") - horizon - 1, F.lit(step))).alias("origin"))


def windows_around(series: DataFrame, starts: DataFrame, back: int = ENCODER_HOURS, ahead: int = 24) -> DataFrame:
    """Per origin the hours just before it and the hours it has to predict (``offset`` < 0 or >= 0).

    Each hour is matched with the origins it can belong to by an equi-join on
    blocks of ``back + ahead`` hours, not by comparing all hours with all origins.
    """
    width = back + ahead
    blocks = starts.withColumn("block", F.explode(F.sequence(F.floor((F.col("origin") - back) / width), F.floor((F.col("origin") + ahead - 1) / width))))
    hours = series.withColumn("block", F.floor(F.col("idx") / width))
    joined = hours.join(blocks, ["series", "block"])
    return joined.withColumn("offset", F.col("idx") - F.col("origin")).filter(F.col("offset").between(-back, ahead - 1)).drop("block")


def rolling_forecasts(series: DataFrame, starts: DataFrame, horizon: int = 24, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(series, origin, horizon_ts, p10, p50, p90, actual): only hours before an origin train its forecast."""
    train = series.join(starts, "series").filter(F.col("idx") < F.col("origin"))
    targets = windows_around(series, starts, 0, horizon).select("series", "origin", F.col("ts").alias("horizon_ts"), F.col("value").alias("actual"))
    return _predict(train, targets, ["series", "origin"], quantiles)


def forecast_error(forecasts: DataFrame) -> DataFrame:
    """Per series: windows, hours, MAE, RMSE, MAE over the mean, coverage, pinball loss of the median."""
    miss = F.col("p50") - F.col("actual")
    inside = F.col("actual").between(F.col("p10"), F.col("p90")).cast("double")
    scored = forecasts.groupBy("series").agg(
        F.countDistinct("origin").alias("windows"),
        F.count("*").alias("forecast_hours"),
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg("actual").alias("mean_actual"),
        F.avg(inside).alias("coverage"),
        F.avg(pinball_loss(F.col("actual"), F.col("p50"), 0.5)).alias("pinball_p50"),
    )
    relative = F.col("mae") / F.when(F.col("mean_actual") == 0, 1e-9).otherwise(F.col("mean_actual"))
    rounded = {c: stable_round(F.col(c), 6) for c in ("mae", "rmse", "coverage", "pinball_p50")}
    return scored.withColumn("mae_over_mean", stable_round(relative, 6)).withColumns(rounded).drop("mean_actual")


def rolling_backtest(series: DataFrame, test_days: int = 21, step: int = 12, horizon: int = 24, need_hours: int = MIN_HISTORY_HOURS) -> DataFrame:
    starts = origins(series, test_days, step, horizon, need_hours)
    return forecast_error(rolling_forecasts(series, starts, horizon))
