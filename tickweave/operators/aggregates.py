"""The rule aggregates, as mergeable states.

Each aggregate is built from small states (sum, count, min, max, latest) that
Spark can combine on the map side, per tick, per block and per window. Windows
over long histories merge these states instead of touching the readings again.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

FUNCTIONS = ("avg", "min", "max", "sum", "count", "last")   # fixed values
DEFAULT_VALUE = 0.0     # value of a rule without aggregates, and of an aggregate over no values


@dataclass(frozen=True)
class Agg:
    """``out = func(input)``; nulls in ``input`` are skipped."""

    out: str
    func: str = "avg"
    input: str = "value"

    def __post_init__(self):
        if self.func not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.func!r}")


@dataclass(frozen=True)
class State:
    name: str
    from_rows: Column                      # aggregate over readings
    of_row: Column                         # the state of a single reading
    merge: Callable[[Column], Column]      # aggregate over states
    combine: Callable[[Column, Column], Column]   # two states of one row


def _add(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def states_for(aggs: Sequence[Agg], tick: str = "tick", tie: str = "event_id",
               where: Column | None = None) -> list[State]:
    """The distinct states that ``aggs`` need."""
    needed = {
        "avg": ("sum", "count"), "sum": ("sum",), "count": ("count",),
        "min": ("min",), "max": ("max",), "last": ("last",),
    }
    out: dict[str, State] = {}
    for agg in aggs:
        v = F.col(agg.input) if where is None else F.when(where, F.col(agg.input))
        latest = F.when(v.isNotNull(), F.struct(F.col(tick).alias("t"), F.col(tie).alias("i"), v.alias("v")))
        build = {
            "sum": lambda n: State(n, F.sum(v), v, F.sum, _add),
            "count": lambda n: State(n, F.count(v), v.isNotNull().cast("bigint"), F.sum, _add),
            "min": lambda n: State(n, F.min(v), v, F.min, F.least),
            "max": lambda n: State(n, F.max(v), v, F.max, F.greatest),
            "last": lambda n: State(n, F.max(latest), latest, F.max, F.greatest),
        }
        for kind in needed[agg.func]:
            name = f"_{kind}_{agg.input}"
            if name not in out:
                out[name] = build[kind](name)
    return list(out.values())


def result(agg: Agg, state: Callable[[str], Column] = F.col, prefix: str = "", empty: float | None = DEFAULT_VALUE) -> Column:
    """Final value of one aggregate from its states; ``empty`` is its value over no values."""
    s = lambda kind: state(f"{prefix}_{kind}_{agg.input}")
    value = {
        "avg": lambda: F.try_divide(s("sum"), s("count")),
        "sum": lambda: s("sum"),
        "count": lambda: s("count").cast("double"),
        "min": lambda: s("min"),
        "max": lambda: s("max"),
        "last": lambda: s("last")["v"],
    }[agg.func]()
    return F.coalesce(value, F.lit(empty)).alias(agg.out)
