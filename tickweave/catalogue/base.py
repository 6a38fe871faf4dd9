"""Registration, and the views that several queries share."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickweave.sources.tables import events_as_readings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ORIGIN_S = 1704067200       # 2024-01-01, the first day of the event table
DAY = 1440                  # ticks of one minute
SEED = 42
_NUDGE = 1e-7


def query(sql: str | None = None):
    """Register a query under its function name. Timestamps are read as UTC, as in the SQL."""
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c: Column | str) -> Column:
    """Round to 4 places for comparison with SQL.

    Sums differ in the last bits between engines, and means of two-decimal values often
    lie exactly between two roundings; the nudge makes both engines go the same way.
    """
    return F.round((F.col(c) if isinstance(c, str) else c) + _NUDGE, 4)


def sql_r4(expr: str) -> str:
    return f"round({expr} + {_NUDGE}, 4)"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as readings, with a zone and a tier by value band."""
    tier = F.when(F.col("value") >= 100, "ABOVE").when(F.col("value") < 5, "BELOW").otherwise("NORMAL")
    return events_as_readings(table(spark, sf_dir, "events"), ORIGIN_S).withColumn(
        "zone_id", F.col("device_id").cast("bigint") % 3 + 1
    ).withColumn("tier", tier)


READINGS_SQL = """readings AS (
  SELECT event_id, 'sensor_reading' AS event_type,
         CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 AS tick,
         CAST(user_id AS VARCHAR) AS device_id, event_type AS measure_name, value,
         user_id % 3 + 1 AS zone_id,
         CASE WHEN value >= 100 THEN 'ABOVE' WHEN value < 5 THEN 'BELOW' ELSE 'NORMAL' END AS tier
  FROM events)"""


def with_readings(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([READINGS_SQL, *ctes]) + " " + body


def uniform_sql(keys: str, draw: str, seed: int = SEED, open_interval: bool = False, part: int = 0) -> str:
    """The counter-based uniform as SQL; ``keys`` is an SQL list of columns."""
    digest = f"substr(md5(concat_ws(':', '{seed}', {keys}, '{draw}')), {1 + 13 * part}, 13)"
    number = f"CAST(('0x' || {digest}) AS BIGINT)"
    return f"(({number} + 0.5::DOUBLE) / 4503599627370496.0)" if open_interval \
        else f"({number} / 4503599627370496.0::DOUBLE)"
