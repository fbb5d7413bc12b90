"""Device telemetry: calibration, defaults, power management, transmit gate, JSON wire format,
per-device history features and the live scoring chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions import device as DV
from ..functions import rules as R
from . import frames as FR

DEVICE_KEY = "device_id"
DEVICE_ORDER = ("ts", "seq", "seq2")

SENSOR_FIELDS = ["temperature", "humidity", "pressure", "precipitation", "water_level", "water_rise_rate"]

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("sensors", T.StructType([T.StructField(f, T.DoubleType()) for f in SENSOR_FIELDS])),
    T.StructField("prediction", T.StructType([
        T.StructField("risk_score", T.DoubleType()), T.StructField("alert_level", T.IntegerType()),
        T.StructField("flood_predicted", T.IntegerType())])),
    T.StructField("power", T.StructType([
        T.StructField("battery_voltage", T.DoubleType()), T.StructField("solar_voltage", T.DoubleType()),
        T.StructField("is_charging", T.BooleanType()), T.StructField("mode", T.StringType())])),
])


def calibrate(raw: DataFrame) -> DataFrame:
    """Raw ADC / echo readings -> physical values; missing or implausible sensors -> defaults."""
    d = DV.sensor_defaults("temperature", "humidity", "pressure")
    keep = [c for c in (DEVICE_KEY, "ts", "seq", "seq2", "connected") if c in raw.columns]
    return raw.select(
        *keep,
        DV.rain_from_adc("rain_raw").alias("precipitation"),
        DV.soil_from_adc("soil_raw").alias("soil_moisture"),
        DV.level_from_echo("echo_us").alias("water_level"),
        DV.battery_voltage("battery_raw").alias("battery_voltage"),
        DV.solar_voltage("solar_raw").alias("solar_voltage"),
        d["temperature"].alias("temperature"), d["humidity"].alias("humidity"), d["pressure"].alias("pressure"))


def with_power(df: DataFrame) -> DataFrame:
    return df.withColumn("is_charging", DV.is_charging()).withColumn("power_mode", DV.power_mode())


def power_dim(spark) -> DataFrame:
    """Mode -> sampling interval and description (fixed 4 rows)."""
    return spark.createDataFrame([(m, s, d) for m, s, d in P.POWER_MODES],
                                 "power_mode string, interval_s int, mode_description string")


def with_power_dim(df: DataFrame) -> DataFrame:
    dim = F.broadcast(power_dim(df.sparkSession))
    return (df.join(dim, ["power_mode"], "left")
            .withColumn("battery_status", DV.battery_status())
            .withColumn("battery_percent", DV.battery_percent()))


def transmit_gate(df: DataFrame) -> DataFrame:
    """Only connected devices in NORMAL power mode send."""
    return df.filter(F.col("connected") & (F.col("power_mode") == "NORMAL"))


def to_wire(df: DataFrame) -> DataFrame:
    """Nested JSON record per reading (the device's POST body)."""
    ms = F.expr("CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) DIV 1000 AS BIGINT)")
    body = F.struct(
        F.col(DEVICE_KEY).alias("device_id"), ms.alias("timestamp"), F.col("seq"),
        F.struct(*[F.col(c).alias(c) for c in SENSOR_FIELDS]).alias("sensors"),
        F.struct(F.col("risk_score"), F.col("alert_level"), F.col("flood_predicted")).alias("prediction"),
        F.struct(F.col("battery_voltage"), F.col("solar_voltage"), F.col("is_charging"),
                 F.col("power_mode").alias("mode")).alias("power"))
    return df.select(F.to_json(body).alias("json"))


def from_wire(df: DataFrame, col: str = "json") -> DataFrame:
    """Decode the JSON record and flatten it; event time back from epoch milliseconds."""
    r = df.select(F.from_json(F.col(col), TELEMETRY_SCHEMA).alias("r"))
    return r.select(
        F.col("r.device_id").alias(DEVICE_KEY),
        F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, r.timestamp / 1000.0)").alias("ts"),
        F.col("r.seq").alias("seq"),
        *[F.col(f"r.sensors.{c}").alias(c) for c in SENSOR_FIELDS],
        F.col("r.prediction.risk_score").alias("risk_score"), F.col("r.prediction.alert_level").alias("alert_level"),
        F.col("r.prediction.flood_predicted").alias("flood_predicted"),
        F.col("r.power.battery_voltage").alias("battery_voltage"), F.col("r.power.solar_voltage").alias("solar_voltage"),
        F.col("r.power.is_charging").alias("is_charging"), F.col("r.power.mode").alias("power_mode"))


def interval_seconds(mode: str = "power_mode"):
    expr = None
    for m, s, _ in P.POWER_MODES:
        expr = F.when(F.col(mode) == m, s) if expr is None else expr.when(F.col(mode) == m, s)
    return expr.otherwise(P.POWER_MODES[0][1])


def device_history(df: DataFrame, key: str = DEVICE_KEY, order=DEVICE_ORDER) -> DataFrame:
    """Per device, over the last readings (current included): means of <= 12 / <= 24 readings,
    24- and 48-reading rain sums, and the rise rate (delta level / nominal interval of the power
    mode x 3600; 0 until two earlier readings exist). Skew-safe row frames."""
    specs = {
        "precipitation_ma_12": FR.rolling_mean_partial("precipitation", 12),
        "water_level_ma_12": FR.rolling_mean_partial("water_level", 12),
        "precipitation_ma_24": FR.rolling_mean_partial("precipitation", 24),
        "water_level_ma_24": FR.rolling_mean_partial("water_level", 24),
        "precip_24h": FR.rolling_sum("precipitation", 24),
        "precip_48h": FR.rolling_sum("precipitation", P.HISTORY_SIZE),
        "_prev_level": FR.lag_value("water_level", 1),
    }
    d = FR.with_row_features(df, key, order, specs, keep_position=True)
    rate = (F.col("water_level") - F.col("_prev_level")) / interval_seconds() * 3600.0
    return (d.withColumn("water_rise_rate", F.when(F.col(FR.POS) >= 2, rate).otherwise(F.lit(0.0)))
            .drop("_prev_level", FR.POS))


def score_chain(df: DataFrame) -> DataFrame:
    """Live scoring after the history features: rule, risk score, alert level."""
    return (df.withColumn("flood_predicted", R.flood_rule("precip_48h", "water_level", "water_rise_rate"))
            .withColumn("risk_score", R.risk_score("precip_48h", "water_level", "water_rise_rate"))
            .withColumn("alert_level", R.alert_level("risk_score")))
