"""Windowed rules that derive alert and report streams from readings.

A ``Rule`` is a declaration; ``RuleSet.run`` turns a list of them into one
DataFrame. Rules over the same window length, keys and source share one
aggregation. Rules whose source is the head of another rule are applied to its
output, so chains work to any depth.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cache, partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from tickweave.functions.scalars import COMPARISONS, compare
from tickweave.operators.aggregates import Agg, DEFAULT_VALUE, result, states_for
from tickweave.operators.ordered import rolling_rows
from tickweave.operators.segments import Segments
from tickweave.operators.windows import landmark, last_tick, sliding_time

WINDOWS = ("tumbling", "sliding", "rows", "landmark", "none")
MEAN = "_mean"           # window constraints are tested against the mean of what they name
VALUE_DIGITS = 4         # emitted values are rounded to this many places; fixed value


@dataclass(frozen=True)
class Having:
    """Constraint on the window's mean of ``name``, the value unless the source binds other names."""

    op: str
    rhs: float
    name: str = "value"

    def __post_init__(self):
        if self.op not in COMPARISONS:
            raise ValueError(f"unknown comparison {self.op!r}")


@dataclass(frozen=True)
class Source:
    """What a rule reads: an event type, optionally one measure or label of it.

    ``bind`` names the source's ``columns`` by position; ``_`` leaves one out. The rule's
    aggregates and constraints then speak of these names, so one name may stand for another
    column in each source. Without ``bind`` they speak of columns.
    """

    event_type: str
    measure: str | None = None
    where: Column | None = None
    bind: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def __post_init__(self):
        if len(self.bind) > len(self.columns):
            raise ValueError("more names than columns")
        names = [n for n in self.bind if n != "_"]
        if len(set(names)) < len(names):
            raise ValueError("a name is bound twice")

    def column(self, name: str) -> str:
        """The column that a name of the rule's body stands for."""
        if not self.bind:
            return name
        if name == "_" or name not in self.bind:
            raise ValueError(f"{name!r} is not bound by the source {self.event_type!r}")
        return self.columns[self.bind.index(name)]


@dataclass(frozen=True)
class Rule:
    head: str
    window: str
    size: int = 0
    sources: tuple[Source, ...] = ()
    aggs: tuple[Agg, ...] = ()
    having: tuple[Having, ...] = ()
    keys: tuple[str, ...] = ("device_id",)
    label: str | None = None
    fire_offset: int | None = None     # ticks after the window's start; default: its end

    def __post_init__(self):
        if self.window not in WINDOWS:
            raise ValueError(f"unknown window {self.window!r}")
        if self.window in ("tumbling", "sliding", "rows") and self.size <= 0:
            raise ValueError("window size must be > 0")
        if not self.sources:
            raise ValueError("a rule needs a source")
        for source in self.sources:
            self.body(source)

    def body(self, source: Source) -> "Body":
        """What is computed of a source's rows, in its own columns."""
        return Body(tuple(replace(a, input=source.column(a.input)) for a in self.aggs),
                    tuple(replace(h, name=source.column(h.name)) for h in self.having))


@dataclass(frozen=True)
class Body:
    """The aggregates and constraints of a rule over one of its sources."""

    aggs: tuple[Agg, ...]
    having: tuple[Having, ...]

    @property
    def private(self) -> list[Agg]:
        """The aggregates under private names, as one may be called like a column of the readings."""
        return [Agg(f"_agg{i}", a.func, a.input) for i, a in enumerate(self.aggs)]

    @property
    def means(self) -> list[Agg]:
        return mean_aggs(self.having)


def bind_positional(df: DataFrame, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rename a source's ``columns`` to ``names`` by position; ``_`` drops a column."""
    if len(names) > len(columns):
        raise ValueError("more names than columns")
    return df.select(*[F.col(c).alias(n) for n, c in zip(names, columns) if n != "_"])


def source_rows(events: DataFrame, source: Source) -> DataFrame:
    rows = events.filter(F.col("event_type") == source.event_type)
    if source.measure is not None:
        label = F.coalesce("rule_label", "measure_name") if "rule_label" in events.columns else F.col("measure_name")
        rows = rows.filter(label == source.measure)
    return rows if source.where is None else rows.filter(source.where)


def mean_aggs(having: Sequence[Having]) -> list[Agg]:
    """The means that constraints are tested against."""
    return [Agg(f"{MEAN}_{name}", "avg", name) for name in dict.fromkeys(h.name for h in having)]


def _means_hold(mean: Callable[[Agg], Column], having: Sequence[Having]) -> Column:
    means = {a.input: mean(a) for a in mean_aggs(having)}
    return reduce(lambda a, b: a & b, [compare(means[h.name], h.op, h.rhs) for h in having], F.lit(True))


def _stamp(rule: Rule, value: Column, window_start: Column, window_end: Column,
           digits: int | None) -> list[Column]:
    """The columns of a derived event, without the grouping keys."""
    fire = window_end if rule.fire_offset is None else window_start + F.lit(rule.fire_offset)
    # a rule grouped by measure keeps the measure it was grouped by
    measure = [] if "measure_name" in rule.keys else [F.lit(rule.head).alias("measure_name")]
    return [
        F.lit(rule.head).alias("event_type"),
        fire.cast("bigint").alias("tick"),
        *measure,
        (value if digits is None else F.round(value, digits)).alias("value"),
        F.lit(rule.head).alias("triggered_by"),
        F.lit(rule.label).cast("string").alias("rule_label"),
        window_start.cast("bigint").alias("window_start"),
        window_end.cast("bigint").alias("window_end"),
    ]


def tumbling_branches(
    events: DataFrame, rules: Sequence[Rule], tie: str = "event_id", digits: int | None = VALUE_DIGITS
) -> tuple[Column, list[Column], Column]:
    """What tumbling rules of one window and one set of keys need of an aggregation.

    That is which events they read, the states of every (rule, source) pair, and an
    expression over the aggregated row, with its ``window_start`` and ``window_end``, that
    makes one output row of each head whose constraint holds.
    """
    keys, size = rules[0].keys, rules[0].size
    if any(r.keys != keys or r.size != size or r.window != "tumbling" for r in rules):
        raise ValueError("tumbling_rules needs rules of one window and one set of keys")
    branches = [(r, s) for r in rules for s in r.sources]
    states, heads, wanted = [], [], F.lit(False)
    for n, (rule, source) in enumerate(branches):
        match = F.col("event_type") == source.event_type
        if source.measure is not None:
            label = (F.coalesce("rule_label", "measure_name")
                     if "rule_label" in events.columns else F.col("measure_name"))
            match = match & (label == source.measure)
        if source.where is not None:
            match = match & source.where
        match = F.coalesce(match, F.lit(False))
        wanted = wanted | match
        prefix, body = f"_b{n}", rule.body(source)
        states.append(F.count_if(match).alias(f"{prefix}_rows"))
        for s in states_for([*body.aggs, *body.means], "tick", tie, where=match):
            states.append(s.from_rows.alias(prefix + s.name))
        value = (result(body.aggs[0], prefix=prefix) if rule.aggs else F.lit(DEFAULT_VALUE))
        holds = _means_hold(lambda a: result(a, prefix=prefix, empty=None), body.having)
        fires = (F.col(f"{prefix}_rows") > 0) & F.coalesce(holds, F.lit(False))
        extra = F.map_from_arrays(
            F.array(*[F.lit(a.out) for a in rule.aggs]),
            F.array(*[result(a, prefix=prefix) for a in body.aggs]),
        ) if rule.aggs else F.lit(None).cast("map<string,double>")
        stamped = F.struct(
            *_stamp(rule, value, F.col("window_start"), F.col("window_end"), digits),
            extra.alias("aggregates"),
        )
        heads.append(F.when(fires, stamped))
    return wanted, states, F.inline(F.filter(F.array(*heads), lambda h: h.isNotNull()))


def tumbling_rules(
    events: DataFrame,
    rules: Sequence[Rule],
    start: int = 0,
    closed_at: Column | None = None,
    digits: int | None = VALUE_DIGITS,
    tie: str = "event_id",
) -> DataFrame:
    """All tumbling rules with the same keys and window length, in one aggregation.

    Each (rule, source) pair becomes a set of conditional states; the heads whose
    constraint holds are emitted from the one aggregated row.
    """
    wanted, states, heads = tumbling_branches(events, rules, tie, digits)
    keys, size = rules[0].keys, rules[0].size
    index = F.floor((F.col("tick") - start) / F.lit(size)).cast("bigint")
    windows = events.filter(wanted).groupBy(*keys, index.alias("_window")).agg(*states)
    first = F.col("_window") * size + F.lit(start)
    windows = windows.withColumn("window_start", first).withColumn("window_end", first + size)
    if closed_at is not None:
        windows = windows.filter(F.col("window_end") <= closed_at)
    return windows.select(*keys, heads)


def windowless(rows: DataFrame, body: Body) -> DataFrame:
    """Rows with the aggregates of a windowless rule: the constraint is on the reading itself, and so is every aggregate."""
    for a in [*body.private, *body.means]:
        rows = rows.withColumn(a.out, F.lit(1.0) if a.func == "count" else F.col(a.input))
    return rows


def row_bounds(rule: Rule, start: int = 0) -> tuple[Column, Column]:
    """First tick of the window of a row rule at a reading, and the first tick after it."""
    first = {"sliding": F.col("tick") - rule.size + 1, "landmark": F.lit(start)}.get(rule.window, F.col("tick"))
    return first, F.col("tick") + 1


def fired(out: DataFrame, rule: Rule, body: Body, start: int = 0, digits: int | None = VALUE_DIGITS) -> DataFrame:
    """The derived events of a row rule from a source's readings with the aggregates of its body."""
    private = body.private
    if rule.having:
        out = out.filter(_means_hold(lambda a: F.col(a.out), body.having))
    value = F.col(private[0].out) if private else F.lit(DEFAULT_VALUE)
    aggregates = F.map_from_arrays(
        F.array(*[F.lit(a.out) for a in rule.aggs]), F.array(*[F.col(a.out) for a in private])
    ) if rule.aggs else F.lit(None).cast("map<string,double>")
    return out.select(*rule.keys, *_stamp(rule, value, *row_bounds(rule, start), digits), aggregates.alias("aggregates"))


def row_rule(
    events: DataFrame,
    rule: Rule,
    start: int = 0,
    digits: int | None = VALUE_DIGITS,
    segments: Segments | None = None,
) -> DataFrame:
    """A sliding, last-N-rows, landmark or windowless rule, evaluated on every reading."""
    parts = []
    for source in rule.sources:
        rows, body = source_rows(events, source), rule.body(source)
        aggs = [*body.private, *body.means]
        if rule.window == "sliding":
            out = sliding_time(rows, rule.size, aggs, rule.keys, start)
        elif rule.window == "landmark":
            out = landmark(rows, aggs, rule.keys)
        elif rule.window == "rows":
            states = states_for(aggs)
            out = rolling_rows(
                rows, rule.size, {s.name: s.from_rows for s in states}, rule.keys, segments=segments
            ).select(*rows.columns, *[result(a) for a in aggs])
        else:
            out = windowless(rows, body)
        parts.append(fired(out, rule, body, start, digits))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class RuleSet:
    """Many rules over one stream; their outputs are merged by name."""

    rules: tuple[Rule, ...]
    start: int = 0
    complete_only: bool = True
    digits: int | None = VALUE_DIGITS
    segments: dict[tuple[str, ...], Segments] = field(default_factory=dict)

    def levels(self) -> list[list[Rule]]:
        """Rules in chaining order; a rule comes after every rule whose head it reads."""
        open_rules, out = list(self.rules), []
        while open_rules:
            waiting = {r.head for r in open_rules}
            ready = [
                r for r in open_rules
                if all(s.event_type not in waiting for s in r.sources)
            ]
            if not ready:
                raise ValueError("rules form a cycle")
            out.append(ready)
            open_rules = [r for r in open_rules if r not in ready]
        return out

    def run(self, readings: DataFrame) -> DataFrame:
        """Derived events of all rules, with the aggregates map of each.

        Chained rules see unrounded values; rounding happens once, on the way out. A rule
        reads the outputs of the heads it names only, so a chain adds its own steps to the plan.
        """
        closed_at = last_tick(readings) if self.complete_only else None
        return self.evaluated(
            readings,
            lambda events, rules: tumbling_rules(events, rules, self.start, closed_at, None),
            lambda events, rule: row_rule(events, rule, self.start, None, self.segments.get(rule.keys)))

    def evaluated(
        self,
        readings: DataFrame,
        tumbling: Callable[[DataFrame, list[Rule]], DataFrame],
        by_row: Callable[[DataFrame, Rule], DataFrame],
        wanted: Sequence[str] | None = None,
        shared: bool = True,
    ) -> DataFrame:
        """Level by level, with these two ways to evaluate rules; both must leave values unrounded.

        Only the heads ``wanted`` are put out. What several rules read is one DataFrame if
        ``shared``, else one for each of them.
        """
        heads = {r.head for r in self.rules}
        makers: list[tuple[set[str], Callable[[], DataFrame]]] = []

        def make(rules: list[Rule]) -> DataFrame:
            reads = {s.event_type for r in rules for s in r.sources}
            parts = [readings] if reads - heads else []
            for head in sorted(reads & heads):      # a rule may read readings and derived events together
                parts += [_as_events(out().where(F.col("event_type") == head)) for own, out in makers if head in own]
            events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            return tumbling(events, rules) if rules[0].window == "tumbling" else by_row(events, rules[0])

        for level in self.levels():
            groups: dict[tuple, list[Rule]] = {}
            for r in level:
                chained = any(s.event_type in heads for s in r.sources)
                reading = any(s.event_type not in heads for s in r.sources)
                group = (r.window, r.size, r.keys, chained, reading) if r.window == "tumbling" else (id(r),)
                groups.setdefault(group, []).append(r)
            for rules in groups.values():
                maker = partial(make, rules)
                makers.append(({r.head for r in rules}, cache(maker) if shared else maker))
        outs = [out() for own, out in makers if wanted is None or own & set(wanted)]
        derived = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outs)
        if wanted is not None:
            derived = derived.where(F.col("event_type").isin(*wanted))
        if self.digits is None:
            return derived
        return derived.withColumn("value", F.round("value", self.digits))


def _as_events(derived: DataFrame) -> DataFrame:
    """Derived events as the input of a later rule, numbered by a hash of what tells them apart."""
    names = [c for c in derived.columns if c not in ("value", "aggregates", "event_ts")]
    return derived.withColumn("event_id", F.xxhash64(*names))


def merge_events(readings: DataFrame, derived: DataFrame) -> DataFrame:
    """Readings and derived events in one stream."""
    return readings.withColumn("triggered_by", F.lit(None).cast("string")).unionByName(
        derived, allowMissingColumns=True
    )


def count_by_kind(events: DataFrame) -> DataFrame:
    """Persistent (readings) and triggered (derived) events."""
    kind = F.when(F.col("triggered_by").isNotNull(), "triggered").otherwise("persistent")
    return events.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
