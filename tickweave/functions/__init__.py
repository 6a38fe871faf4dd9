from tickweave.functions.samplers import sample_value, with_cdf
from tickweave.functions.scalars import clamp, compare, duration_ms, profile_key, tick_of
from tickweave.functions.search import rank_in_sorted
from tickweave.functions.uniform import digest, fraction, open_uniform, uniform

__all__ = [
    "clamp", "compare", "digest", "duration_ms", "fraction", "open_uniform", "profile_key", "rank_in_sorted",
    "sample_value", "tick_of", "uniform", "with_cdf",
]
