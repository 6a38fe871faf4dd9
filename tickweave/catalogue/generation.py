"""Synthetic readings for every customer, five minutes apart over one day."""

from pyspark.sql import functions as F

from tickweave.catalogue import specs
from tickweave.catalogue.base import SEED, SQL, query, r4, sql_r4, table, uniform_sql, with_readings
from tickweave.catalogue.storage import shared_folder
from tickweave.functions.samplers import discrete_cdf, sample_value
from tickweave.functions.scalars import clamp
from tickweave.functions.uniform import digest, uniform
from tickweave.operators.binding import bind_devices, bind_profiles
from tickweave.operators.generate import (
    CROP_TYPES, DEPTHS_CM, KEYS, PLOT_TYPES, SOIL_TYPES, ZONE_TYPES, allocate_classes, chosen_tier, emitted, generate_readings, make_plots, make_zones,
    name_devices, plots_per_zone, prepare_profiles, tick_grid, value_draw, with_draw,
)
from tickweave.plans.end_to_end import Deployment
from tickweave.sources.feed import feed

END = 1435          # the last tick of the day that is due
MS_PER_TICK = 60_000
N_ZONES = 3

_GRID_SQL = """grid AS (
  SELECT CAST(c_custkey AS VARCHAR) AS device_id, c_mktsegment AS measure_name, c_acctbal, c_nationkey,
         unnest(range(0, 1436, 5)) AS tick FROM customer)"""
_KEYS_SQL = "device_id, measure_name, CAST(tick AS VARCHAR)"
_U1 = uniform_sql(_KEYS_SQL, "value", open_interval=True)
_U2 = uniform_sql(_KEYS_SQL, "value", part=1)


def _bindings(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("device_id"), F.col("c_mktsegment").alias("measure_name"),
        "c_acctbal", "c_nationkey", F.lit("PERIODIC").alias("mode"), F.lit(300_000.0).alias("interval_ms"))


def _grid(spark, sf_dir, **columns):
    return tick_grid(_bindings(spark, sf_dir).withColumns(columns), 0, END, MS_PER_TICK)


def _drawn(spark, sf_dir, family, **params):
    pairs = [x for k, v in params.items() for x in (F.lit(k), v.cast("double"))]
    if family not in ("poisson", "binomial"):
        grid = _grid(spark, sf_dir, params=F.create_map(*pairs)).withColumn("bits", digest(SEED, KEYS, "value"))
        value = r4(sample_value(F.lit(family), value_draw(F.col("params"), F.col("bits"))))
    else:
        grid = tick_grid(_bindings(spark, sf_dir).withColumn("params", F.create_map(*pairs)).withColumn(
            "cdf", discrete_cdf(F.lit(family), F.col("params"))), 0, END, MS_PER_TICK)
        grid, draw = with_draw(grid.withColumn("bits", digest(SEED, KEYS, "value")), F.col("params"), F.col("bits"), F.col("cdf"))
        value = sample_value(F.lit(family), draw)       # whole numbers, so there is nothing to round
    return grid.select("device_id", "measure_name", "tick", value.alias("value"))


def _sql(value, *ctes, source="grid"):
    more = "".join(f", {c}" for c in ctes)
    return f"WITH {_GRID_SQL}{more} SELECT device_id, measure_name, tick, {sql_r4(value)} AS value FROM {source}"


def _mean():
    return F.col("c_acctbal") / 100


def _spread():
    return F.col("c_nationkey") + 1


@query(f"""WITH {_GRID_SQL}
  SELECT device_id, tick, CASE WHEN u < 0.6 + c_nationkey / 100.0 THEN 'NORMAL'
         WHEN u < 0.6 + c_nationkey / 100.0 + 0.1 THEN 'ABOVE' ELSE 'BELOW' END AS tier
  FROM (SELECT *, {uniform_sql(_KEYS_SQL, 'tier')} AS u FROM grid)""")
def gen_grid_tiers(spark, sf_dir):
    u = uniform(SEED, KEYS, "tier")
    tier = chosen_tier(u, 0.6 + F.col("c_nationkey") / 100.0, F.lit(0.1))
    return _grid(spark, sf_dir).select("device_id", "tick", tier.alias("tier"))


@query(_sql(f"c_acctbal / 100 + (c_nationkey + 1) * sqrt(-2 * ln({_U1})) * cos(2 * pi() * {_U2})"))
def gen_normal(spark, sf_dir):
    return _drawn(spark, sf_dir, "normal", mean=_mean(), std_dev=_spread())


@query(_sql(f"c_acctbal / 100 + (c_nationkey + 1) * {_U2}"))
def gen_uniform(spark, sf_dir):
    return _drawn(spark, sf_dir, "uniform", low=_mean(), high=_mean() + _spread())


@query(_sql(f"-greatest(c_acctbal / 100, 1e-9) * ln(1 - {_U2})"))
def gen_exponential(spark, sf_dir):
    return _drawn(spark, sf_dir, "exponential", mean=_mean())


@query(_sql(f"""CASE WHEN c_nationkey - 1 <= 0 THEN 0.0
         WHEN (c_nationkey - 1) * 2 < 30 THEN len(list_filter(cdf, lambda c: c <= {_U2}))
         ELSE greatest(0, trunc((c_nationkey - 1) * 2 + sqrt((c_nationkey - 1) * 2)
                                * sqrt(-2 * ln({_U1})) * cos(2 * pi() * {_U2}))) END""",
            """mass AS (SELECT m.n AS c_nationkey, k, exp(-lam + k * ln(lam) - lgamma(k + 1)) AS p
                 FROM (SELECT DISTINCT c_nationkey AS n, (c_nationkey - 1) * 2.0::DOUBLE AS lam
                       FROM customer WHERE c_nationkey > 1) m, range(0, 160) t(k))""",
            """cdfs AS (SELECT c_nationkey, list(c ORDER BY k) AS cdf
                 FROM (SELECT c_nationkey, k, sum(p) OVER (PARTITION BY c_nationkey ORDER BY k) AS c FROM mass)
                 GROUP BY c_nationkey)""", source="grid LEFT JOIN cdfs USING (c_nationkey)"))
def gen_poisson(spark, sf_dir):
    return _drawn(spark, sf_dir, "poisson", mean=(F.col("c_nationkey") - 1) * 2)


@query(_sql(f"len(list_filter(cdf, lambda c: c <= {_U2}))",
            """mass AS (SELECT n AS c_nationkey, k, exp(lgamma(n + 11) - lgamma(k + 1) - lgamma(n + 10 - k + 1)
                        + k * ln(0.3) + (n + 10 - k) * ln(0.7)) AS p
                 FROM (SELECT DISTINCT c_nationkey AS n FROM customer), range(0, 35) t(k) WHERE k < n + 10)""",
            """cdfs AS (SELECT c_nationkey, list(c ORDER BY k) AS cdf
                 FROM (SELECT c_nationkey, k, sum(p) OVER (PARTITION BY c_nationkey ORDER BY k) AS c FROM mass)
                 GROUP BY c_nationkey)""", source="grid JOIN cdfs USING (c_nationkey)"))
def gen_binomial(spark, sf_dir):
    return _drawn(spark, sf_dir, "binomial", n=F.col("c_nationkey") + 10, p=F.lit(0.3))


@query(_sql(f"""greatest(1, least(60, c_acctbal / 100 + (c_nationkey + 1)
                * sqrt(-2 * ln({_U1})) * cos(2 * pi() * {_U2})))"""))
def gen_clamped(spark, sf_dir):
    params = F.create_map(F.lit("mean"), _mean().cast("double"), F.lit("std_dev"), _spread().cast("double"))
    grid = _grid(spark, sf_dir, params=params)
    grid = grid.withColumn("bits", digest(SEED, KEYS, "value"))
    grid = grid.withColumn("drawn", sample_value(F.lit("NORMAL"), value_draw(F.col("params"), F.col("bits"))))
    return grid.select("device_id", "measure_name", "tick", r4(clamp(F.col("drawn"), F.lit(1.0), F.lit(60.0))).alias("value"))


def _bound(spark, sf_dir):
    bindings = bind_devices(specs.devices(spark, sf_dir), specs.plots(spark, sf_dir), specs.measures(spark, sf_dir))
    return bind_profiles(bindings, prepare_profiles(specs.profiles(spark, sf_dir)))


_HOURS = 96


@query(with_readings(f"""
  SELECT device_id, measure_name, tick, tier,
         {sql_r4('''greatest(range_min, least(range_max, mean + std_dev * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)))''')} AS value
  FROM (SELECT g.*, t.mean, t.std_dev FROM drawn g
        LEFT JOIN tiers t ON t.measure_name = g.measure_name AND t.zone_id = g.zone_id AND t.tier = g.tier)""",
                     specs.MEASURES_SQL, specs.TIERS_SQL, specs.ARRIVALS_SQL, specs.BINDINGS_SQL, specs.PROFILES_SQL,
                     f"""drawn AS (
  SELECT *, {_U1} AS u1, {_U2} AS u2,
         CASE WHEN u < normal_p THEN 'NORMAL' WHEN u < normal_p + coalesce(above_p, 0) THEN 'ABOVE' ELSE 'BELOW' END AS tier
  FROM (SELECT *, {uniform_sql(_KEYS_SQL, 'tier')} AS u FROM (
    SELECT b.device_id, b.measure_name, b.zone_id, p.* EXCLUDE (profile, device_class, measure_name, zone_id),
           unnest(range(0, {_HOURS} + 1, CASE WHEN coalesce(mode, 'PERIODIC') = 'PERIODIC'
                  THEN greatest(1, CAST(floor(coalesce(interval_ms, 0) / 3600000) AS BIGINT)) ELSE 1 END)) AS tick
    FROM bindings b JOIN profiles p USING (profile) WHERE b.zone_id = p.zone_id)))"""))
def gen_profile_readings(spark, sf_dir):
    """From devices to readings through every step, in ticks of one hour over four days."""
    out = generate_readings(_bound(spark, sf_dir), 0, _HOURS, 3_600_000, SEED)
    return out.select("device_id", "measure_name", "tick", "tier", r4("value").alias("value"))


def _written_bound(spark, sf_dir):
    """The bindings as a table, as a feed wants them."""
    folder = shared_folder(spark, "bound")
    bound = _bound(spark, sf_dir)
    bound.write.parquet(folder)
    return spark.read.schema(bound.schema).parquet(folder)


def _fed(df):
    return df.select("device_id", "measure_name", "tick", "tier", r4("value").alias("value"))


@query(SQL["gen_profile_readings"])
def feed_range(spark, sf_dir):
    """The same readings from the feed's data source, read as a table over a range of ticks."""
    return _fed(feed(spark, _written_bound(spark, sf_dir), SEED, 0, _HOURS, 3_600_000))


@query(SQL["gen_profile_readings"])
def stream_feed(spark, sf_dir):
    """The same readings from the feed as a stream that is stopped half-way and started again."""
    bound, folder = _written_bound(spark, sf_dir), shared_folder(spark, "feed")
    for end in (_HOURS // 2, _HOURS):
        out = feed(spark, bound, SEED, 0, end, 3_600_000, stream=True)
        q = (out.writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        q.awaitTermination()
    return _fed(spark.read.schema(out.schema).parquet(f"{folder}/out"))


@query()
def gen_transmitted(spark, sf_dir):
    """The same readings after arrival mode and loss, in the record shape of the sink."""
    deployment = Deployment(specs.measures(spark, sf_dir), specs.tiers(spark, sf_dir), specs.arrivals(spark, sf_dir),
                            specs.devices(spark, sf_dir), specs.plots(spark, sf_dir))
    return emitted(deployment.delivered(0, _HOURS, 3_600_000, SEED))


_N_SQL = "(SELECT count(*) FROM customer)"
_AREA = lambda lo, hi, key: f"round({lo} + {hi - lo} * {uniform_sql(f'CAST({key} AS VARCHAR)', 'area')}, 1)"


def _n_devices(spark, sf_dir):
    return table(spark, sf_dir, "customer").count()


def _pick_sql(values, key, draw):
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    u = uniform_sql(f"CAST({key} AS VARCHAR)", draw)
    return f"[{items}][CAST(floor({u} * {len(values)}) AS BIGINT) + 1]"


@query(f"""
  SELECT zone_id, 'Zone_' || zone_id AS zone_name,
         {list(ZONE_TYPES)}[(zone_id - 1) % {len(ZONE_TYPES)} + 1] AS zone_type, {_AREA(5.0, 50.0, 'zone_id')} AS area_ha
  FROM (SELECT unnest(range(1, {_N_SQL} // 50 + 1)) AS zone_id)""")
def gen_zones(spark, sf_dir):
    """A zone for every fifty customers."""
    return make_zones(spark, _n_devices(spark, sf_dir) // 50, SEED)


@query(f"""
  SELECT plot_id, zone_id, 'Plot_' || plot_id AS plot_name, {_AREA(1.0, 10.0, 'plot_id')} AS area_ha,
         {_pick_sql(PLOT_TYPES, 'plot_id', 'plot_type')} AS plot_type,
         {_pick_sql(SOIL_TYPES, 'plot_id', 'soil_type')} AS soil_type,
         {_pick_sql(CROP_TYPES, 'plot_id', 'crop_type')} AS crop_type
  FROM (SELECT z * per + p + 101 AS plot_id, z + 1 AS zone_id
        FROM (SELECT greatest(1, greatest(3, {_N_SQL} // 6) // 3) AS per) s, range(0, 3) a(z), range(0, s.per) b(p))""")
def gen_plots(spark, sf_dir):
    return make_plots(spark, N_ZONES, plots_per_zone(_n_devices(spark, sf_dir), N_ZONES), SEED)


@query(f"""
  WITH size AS (SELECT {_N_SQL} AS n),
  counts AS (SELECT n, greatest(1, CAST(round_even(n * 0.5, 0) AS BIGINT)) AS c1, greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) AS c2,
                    greatest(1, CAST(round_even(n * 0.15, 0) AS BIGINT)) AS c34 FROM size),
  stride AS (SELECT *, c1 + c2 + 2 * c34 AS total,
                    (SELECT min(s) FROM range(1, 4000000) t(s)
                     WHERE s >= greatest(1, CAST(floor((c1 + c2 + 2 * c34) * 0.6180339887) AS BIGINT))
                       AND gcd(s, c1 + c2 + 2 * c34) = 1) AS stride FROM counts),
  classed AS (SELECT c_custkey AS idx, n,
                     CASE WHEN slot < c1 THEN 'SoilMoistureSensor' WHEN slot < c1 + c2 THEN 'AirTemperatureSensor'
                          WHEN slot < c1 + c2 + c34 THEN 'HumiditySensor' ELSE 'NPKSensor' END AS device_class
              FROM (SELECT *, c_custkey * stride % total AS slot FROM customer, stride))
  SELECT upper(substr(device_class, 1, 3)) || '_'
           || lpad(CAST(seq AS VARCHAR), CAST(greatest(4, length(CAST(seq AS VARCHAR))) AS INTEGER), '0') AS device_id,
         device_class, idx % (greatest(1, greatest(3, n // 6) // 3) * 3) + 101 AS plot_id,
         CASE WHEN device_class LIKE '%Soil%' THEN {_pick_sql(DEPTHS_CM, 'idx', 'depth')} END AS depth_cm
  FROM (SELECT *, row_number() OVER (PARTITION BY device_class ORDER BY idx) AS seq FROM classed)""")
def gen_devices(spark, sf_dir):
    n = _n_devices(spark, sf_dir)
    idx = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"))
    n_plots = plots_per_zone(n, N_ZONES) * N_ZONES
    return name_devices(allocate_classes(idx, "idx", n), "idx", n_plots, SEED)
