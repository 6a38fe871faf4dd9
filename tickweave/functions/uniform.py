"""Counter-based random numbers.

A draw is a pure function of (seed, key columns, draw number), so the same row
gets the same number on any partitioning, after a lost executor, and in any SQL
engine that has md5. ``F.rand`` has none of these properties.
"""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_BITS = 52
_HEX = _BITS // 4


def _parts(seed: int, keys: Sequence[Column | str]) -> list[Column]:
    return [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]


def digest(seed: int, keys: Sequence[Column | str], draw: str) -> Column:
    """The 128 random bits of a draw, enough for two numbers."""
    return F.md5(F.concat_ws(":", *_parts(seed, keys), F.lit(draw)))


def stem(seed: int, keys: Sequence[Column | str]) -> Column:
    """What the digests of many draws begin with: the seed and the first keys."""
    return F.concat_ws(":", *_parts(seed, keys))


def digest_from(stem: Column, key: Column, draw: str) -> Column:
    """``digest`` with one more key after those of the stem."""
    return F.md5(F.concat_ws(":", stem, key.cast("string"), F.lit(draw)))


def fraction(bits: Column, part: int = 0, open_interval: bool = False) -> Column:
    """Number ``part`` (0 or 1) of a digest: uniform on [0, 1), or on (0, 1) for logarithms."""
    k = F.conv(F.substring(bits, 1 + part * _HEX, _HEX), 16, 10).cast("bigint").cast("double")
    return (k + 0.5 if open_interval else k) / F.lit(float(1 << _BITS))


def uniform(seed: int, keys: Sequence[Column | str], draw: str) -> Column:
    """Uniform on [0, 1)."""
    return fraction(digest(seed, keys, draw))


def open_uniform(seed: int, keys: Sequence[Column | str], draw: str) -> Column:
    """Uniform on (0, 1): safe under a logarithm."""
    return fraction(digest(seed, keys, draw), open_interval=True)
