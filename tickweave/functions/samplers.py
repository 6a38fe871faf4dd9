"""Sampling a declared distribution as Column expressions.

Each family is one builder in ``FAMILIES``: it gets the parameter map, two
independent uniforms and the discrete CDF array, and returns a Column. Add a
family by registering a builder, which may wrap a pandas UDF.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickweave.functions.search import rank_in_sorted, with_rank
from tickweave.schemas import DOUBLE, LONG, struct

POISSON_EXACT_BELOW = 30.0   # from this mean on, Poisson is drawn as a truncated normal
_CDF_MAX = 1 << 20      # the search reaches 2 * _CDF_MAX - 1 entries; a wider distribution raises


@dataclass(frozen=True)
class Draw:
    """What a family builder can use."""

    params: Column
    u1: Column      # uniform on (0, 1), safe under a logarithm
    u2: Column      # uniform on [0, 1)
    cdf: Column     # struct(first outcome, ascending CDF); null for continuous families
    rank: Column | None = None      # u2's rank in the CDF where it was found before, see with_cdf_rank

    def param(self, name: str) -> Column:
        return F.try_element_at(self.params, F.lit(name))

    @property
    def outcome(self) -> Column:
        """Discrete outcome by inverse CDF."""
        rank = rank_in_sorted(self.cdf["cdf"], self.u2, _CDF_MAX) if self.rank is None else self.rank
        return (self.cdf["first"] + rank).cast("double")

    @property
    def z(self) -> Column:
        """Standard normal."""
        return F.sqrt(-2.0 * F.log(self.u1)) * F.cos(2.0 * F.pi() * self.u2)


def _normal(d: Draw) -> Column:
    return d.param("mean") + d.param("std_dev") * d.z


def _uniform(d: Draw) -> Column:
    return d.param("low") + (d.param("high") - d.param("low")) * d.u2


def _exponential(d: Draw) -> Column:
    return -F.greatest(d.param("mean"), F.lit(1e-9)) * F.log1p(-d.u2)


def _poisson(d: Draw) -> Column:
    lam = d.param("mean")
    large = F.greatest(F.lit(0.0), (lam + F.sqrt(lam) * d.z).cast("bigint").cast("double"))
    return F.when(lam <= 0, 0.0).when(lam < POISSON_EXACT_BELOW, d.outcome).otherwise(large)


def _binomial(d: Draw) -> Column:
    return d.outcome


FAMILIES: dict[str, Callable[[Draw], Column]] = {
    "normal": _normal,
    "uniform": _uniform,
    "exponential": _exponential,
    "poisson": _poisson,
    "binomial": _binomial,
}


def sample_value(family: Column, draw: Draw, families: dict | None = None) -> Column:
    """Value drawn from ``family``; an unknown family gives 0.0."""
    name = F.lower(family)
    out = None
    for key, build in (families or FAMILIES).items():
        out = F.when(name == key, build(draw)) if out is None else out.when(name == key, build(draw))
    return out.otherwise(F.lit(0.0))


def _log_mass_ratio_cdf(log_first: float, log_ratios: np.ndarray) -> list[float]:
    """CDF over consecutive outcomes from the first log mass and the log ratios."""
    log_mass = np.concatenate(([log_first], log_first + np.cumsum(log_ratios)))
    cdf = np.minimum(np.cumsum(np.exp(log_mass)), 1.0)
    cdf[-1] = 1.0   # a uniform below 1 never runs past the end
    return cdf.tolist()


def _poisson_cdf(lam: float) -> tuple[int, list[float]]:
    n = math.ceil(lam + 12 * math.sqrt(lam) + 60)
    k = np.arange(1, n + 1)
    return 0, _log_mass_ratio_cdf(-lam, math.log(lam) - np.log(k))


def _binomial_cdf(n: int, p: float) -> tuple[int, list[float]]:
    if n <= 0 or p <= 0:
        return 0, [1.0]
    if p >= 1:
        return n, [1.0]
    # outside this band the mass is far below the spacing of a double
    reach = 12 * math.sqrt(n * p * (1 - p)) + 60
    first, last = max(0, math.floor(n * p - reach)), min(n, math.ceil(n * p + reach))
    if last - first + 1 >= 2 * _CDF_MAX:
        raise ValueError(f"binomial with n={n}, p={p} has more outcomes than can be searched")
    log_first = (
        math.lgamma(n + 1) - math.lgamma(first + 1) - math.lgamma(n - first + 1)
        + first * math.log(p) + (n - first) * math.log1p(-p)
    )
    k = np.arange(first + 1, last + 1)
    return first, _log_mass_ratio_cdf(log_first, np.log((n - k + 1) / k) + math.log(p / (1 - p)))


@F.pandas_udf(struct(first=LONG, cdf=T.ArrayType(DOUBLE)))
def _cdf_udf(family: pd.Series, lam: pd.Series, n: pd.Series, p: pd.Series) -> pd.DataFrame:
    """Each distinct distribution of a batch is built once."""
    built: dict[tuple, tuple] = {}
    rows = []
    for name, mean, trials, prob in zip(family, lam, n, p):
        if name == "poisson" and 0 < mean < POISSON_EXACT_BELOW:
            key, build = (name, mean), lambda: _poisson_cdf(mean)
        elif name == "binomial" and trials == trials and prob == prob:
            key, build = (name, int(trials), prob), lambda: _binomial_cdf(int(trials), prob)
        else:
            key, build = None, lambda: (None, None)
        if key not in built:
            built[key] = build()
        rows.append(built[key])
    return pd.DataFrame(rows, columns=["first", "cdf"])


def discrete_cdf(family: Column, params: Column) -> Column:
    """CDF of a Poisson (small mean) or binomial family; null fields otherwise."""
    arg = lambda name: F.try_element_at(params, F.lit(name))
    return _cdf_udf(F.lower(family), arg("mean"), arg("n"), arg("p"))


def with_cdf(specs: DataFrame, family: str = "family", params: str = "params",
             out: str = "cdf") -> DataFrame:
    """Add the CDF array once per declared distribution.

    Call it on the spec table before joining it to the grid: the array is then
    built once per spec row, not once per reading.
    """
    return specs.withColumn(out, discrete_cdf(F.col(family), F.col(params)))


def with_cdf_rank(df: DataFrame, out: str, cdf: Column, u2: Column) -> DataFrame:
    """Add the rank of ``u2`` in the CDF, for ``Draw.rank``: the quick way for many rows."""
    return with_rank(df, out, cdf["cdf"], u2, _CDF_MAX)
