"""Headline queries over $BENCH_SF_DIR, and generation at the published fleet sizes.

Prints one JSON line. Queries are run to a no-op sink, so the whole result is computed;
``queries`` holds the second run of each, ``first_run`` the first.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "tumbling_avg_alert", "tumbling_all_aggs", "tumbling_lineitem", "sliding_time_avg", "sliding_rows_avg",
    "landmark_avg", "chained_report", "multi_rule_union", "cooccur_daily", "cooccur_within_10h", "keep_last_5",
    "deadband_kept", "lossy_crossing", "crossing_drop_counts", "binding_join", "profile_assembly",
    "gen_grid_tiers", "gen_normal", "gen_poisson", "gen_profile_readings", "conformance_all_devices",
    "transitions", "tier_rates_first_weeks", "dq_duplicates", "dq_orphans", "dq_functional_dependency",
    "run_scaling_exponent", "events_json_round_trip", "stream_tumbling",
]
FLEETS = (10, 50, 100, 250, 500, 1000)      # requested devices, from the published sweep


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 3)


def fleet_run(spark, n_devices: int, days: int, out: str) -> dict:
    """Generate, thin, derive and write one fleet's events; counts come from what was written."""
    from tickweave.operators.generate import make_devices, make_plots, plots_per_zone
    from tickweave.plans import example_farm as farm
    from tickweave.plans.end_to_end import Deployment, tick_range
    from tickweave.sources import write_events

    per_zone = plots_per_zone(n_devices, 3)
    deployment = Deployment(
        farm.measures(spark), farm.tiers(spark), farm.arrivals(spark),
        make_devices(spark, n_devices, per_zone * 3, 42), make_plots(spark, 3, per_zone, 42), farm.EVENT_TYPES,
        farm.RULES)
    start, end, ms = tick_range(0, days, "days", "minutes")

    def work():
        deployment.delivered(start, end, ms, 42).write.parquet(f"{out}-delivered")     # once, for all rules
        write_events(deployment.events(spark.read.parquet(f"{out}-delivered"), start), out)

    wall = timed(work)
    n = spark.read.text(out).count()
    return {"bindings": deployment.bindings().count(), "events": n, "wall_s": wall, "events_per_s": round(n / wall)}


def main() -> None:
    started = time.perf_counter()
    spark = session()
    from tickweave.catalogue import QUERIES

    QUERIES["tumbling_avg_alert"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    startup = round(time.perf_counter() - started, 3)
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    times, cold = {}, {}
    for name in names:
        run = lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        first, times[name] = timed(run), timed(run)     # the first run also compiles the plan's code
        cold[name] = first
        print(name, times[name], file=sys.stderr, flush=True)
    fleets = []
    if os.environ.get("BENCH_FLEETS", "1") == "1":
        folder = tempfile.mkdtemp(prefix="run-")
        fleets.append({"first_run": True, **fleet_run(spark, FLEETS[0], 1, f"{folder}/first")})
        for n in FLEETS:
            fleets.append(fleet_run(spark, n, 1, f"{folder}/day-{n}"))
            print(fleets[-1], file=sys.stderr, flush=True)
        fleets.append({"published": "48 devices, 90 days", **fleet_run(spark, 48, 90, f"{folder}/quarter")})
        print(fleets[-1], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first_run": cold, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": int(CPUS), "startup_s": startup, "fleets": fleets,
    }))


if __name__ == "__main__":
    main()
