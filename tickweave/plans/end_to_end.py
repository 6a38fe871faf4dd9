"""From declarations to readings, derived events and conformance in one call each."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tickweave.operators.binding import bind_devices, bind_profiles
from tickweave.operators.conformance import conformance
from tickweave.operators.generate import emitted, generate_readings, prepare_profiles
from tickweave.operators.segments import MIN_HOT_ROWS, Segments
from tickweave.operators.specs import DEFAULT_EVENT_TYPE, assemble_profiles, profile_tiers
from tickweave.operators.transmit import KEYS, ORDER, SENT, transmit
from tickweave.plans.rules import Rule, RuleSet, merge_events

# Minutes per unit of simulated time. Fixed values.
MINUTES = {"seconds": 1 / 60, "minutes": 1, "hours": 60, "days": 1440}

# What the steps after generation need of a reading.
READING_COLUMNS = (
    "event_id", "event_type", "tick", "device_id", "device_class", "measure_name", "zone_id",
    "value", "tier", "mode", "interval_ms", "threshold", "failure",
)


def tick_range(start: float, end: float, time_unit: str, tick_unit: str) -> tuple[int, int, int]:
    """First and last tick, and milliseconds per tick, of a span of simulated time."""
    per_tick = MINUTES[tick_unit]
    to_tick = lambda t: int(t * MINUTES[time_unit] / per_tick)
    return to_tick(start), to_tick(end), int(per_tick * 60 * 1000)


@dataclass(frozen=True)
class Deployment:
    """Declared measures, tiers and arrivals, and the devices on their plots."""

    measures: DataFrame
    tiers: DataFrame
    arrivals: DataFrame
    devices: DataFrame
    plots: DataFrame
    event_types: tuple[str, ...] = (DEFAULT_EVENT_TYPE,)
    rules: tuple[Rule, ...] = ()

    def profiles(self) -> DataFrame:
        return assemble_profiles(self.measures, self.tiers, self.arrivals, self.event_types)

    def bindings(self) -> DataFrame:
        return bind_devices(self.devices, self.plots, self.measures)

    def modes(self) -> list[str]:
        """Declared arrival modes: a handful of values."""
        return [r["mode"] for r in self.arrivals.select("mode").distinct().collect()]

    def readings(self, start: int, end: int, ms_per_tick: int, seed: int) -> DataFrame:
        """All readings with their transmission status, values unrounded."""
        bound = bind_profiles(self.bindings(), prepare_profiles(self.profiles()))
        made = generate_readings(bound, start, end, ms_per_tick, seed).select(*READING_COLUMNS)
        # a key has at most one reading per tick, so over a short span none can be hot
        short = end - start + 1 <= MIN_HOT_ROWS
        segments = Segments(KEYS, ORDER) if short else None
        return transmit(made, ms_per_tick, seed, start, segments=segments, modes=self.modes())

    def delivered(self, start: int, end: int, ms_per_tick: int, seed: int) -> DataFrame:
        return self.readings(start, end, ms_per_tick, seed).filter(F.col("status") == SENT)

    def derived(self, delivered: DataFrame, start: int = 0) -> DataFrame:
        """Events the rules derive from delivered readings."""
        return RuleSet(self.rules, start).run(delivered)

    def events(self, delivered: DataFrame, start: int = 0) -> DataFrame:
        """Readings and derived events as they leave the system."""
        out = emitted(delivered)
        if not self.rules:
            return out
        derived = self.derived(delivered, start).withColumnRenamed("tick", "event_time")
        return merge_events(out, derived)

    def conformance(self, delivered: DataFrame, **kw) -> DataFrame:
        """Judge delivered readings against the declared tiers."""
        profiles = self.profiles()
        bindings = self.bindings().join(
            profiles.select("profile", "range_min", "range_max"), "profile"
        ).withColumn("binding_idx", F.col("device_id"))
        readings = delivered.select("device_id", "measure_name", "tick", "event_id", "value", "tier")
        return conformance(readings, bindings, profile_tiers(profiles), **kw)
