"""URL filter: rules first, then a likelihood ratio of two character models.

URLs that a rule allows or blocks teach two variable-order Markov models over bytes. The
probability of a byte after up to ``ORDER`` bytes is smoothed from order to order: counts
of the longest context are mixed with the next shorter one's estimate, which weighs
``STRENGTH`` observations. A URL without a rule is blocked if the mean log-likelihood
difference per byte is above a threshold; the threshold is calibrated on labelled URLs
that the counts have not seen.

Counts are exact and gathered from all labelled rows of the input: a table with a row for
each context and each context with its byte, which grows with what the URLs hold. To
score, URLs are cut into blocks; a block's distinct contexts are joined with the table and
come back to the block.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tickweave.llm.common import free_names, text_blocks, utf8, written

ORDER = 4
COUNT_BYTES = 256 << 10     # URLs that a task counts at a time
BLOCK_BYTES = 32 << 10      # URLs that are scored together
STRENGTH = 2.0
BINS = 400          # of the calibration histogram, over differences from -4 to 4 a byte
SPAN = 4.0
FOLDS = 5           # one of five labelled rows calibrates, the others are counted

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule(ALLOW, "com"), Rule(BLOCK, "example.com", "/en/"), Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"), Rule(BLOCK, "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (name, verdict) if rules else (F.lit(None).cast("string"),) * 2


_CONTEXT = 1 << 62      # marks the key of a context alone; 0 behind it is the empty context


def keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the context and of context with byte, for each order (rows) and byte (columns).

    A context is written in digits of 9 bits from 1 on, so contexts of all orders differ. A
    URL is preceded by zero bytes, so its first bytes have contexts too.
    """
    n = len(data)
    at = np.arange(n, dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
    context = np.zeros(n, np.int64)
    of, with_byte = np.empty((ORDER + 1, n), np.int64), np.empty((ORDER + 1, n), np.int64)
    for k in range(ORDER + 1):
        if k:
            back = np.zeros(n, np.int64)
            back[k:] = data[:-k] if k < n else 0
            back[at < k] = 0
            context = context | (back + 1) << (9 * (k - 1))
        of[k] = context | _CONTEXT
        with_byte[k] = context << 8 | data
    return of, with_byte


def distinct_keys(data, offsets) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the texts, ascending, and how often each occurs."""
    return np.unique(np.concatenate([k.ravel() for k in keys_of(data, offsets)]), return_counts=True)


@dataclass
class Counts:
    """Counts of some keys (ascending) in accepted and rejected URLs; keys that are not here have none."""

    keys: np.ndarray
    n: np.ndarray       # (accepted or rejected, key)

    @classmethod
    def of(cls, found: pa.Table) -> "Counts":
        keys, first = np.unique(found.column("key").to_numpy(), return_index=True)
        return cls(keys, np.stack([found.column(c).to_numpy()[first] for c in ("accepted", "rejected")]))

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((2, len(keys)))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.n[:, at] * (self.keys[at] == keys)


def log_likelihoods(counts: Counts, data, offsets) -> np.ndarray:
    """Log-probability of each byte (columns) as part of an accepted and of a rejected URL (rows)."""
    p = np.full((2, len(data)), 1 / 256)
    for of, with_byte in zip(*keys_of(data, offsets)):
        p = (counts.get(with_byte) + STRENGTH * p) / (counts.get(of) + STRENGTH)
    return np.log(p)


def differences(counts: Counts | DataFrame, data, offsets) -> np.ndarray:
    """Mean over the bytes of log P(rejected) - log P(accepted); 0 for an empty URL.

    A table of counts is asked for the keys of these texts only.
    """
    if isinstance(counts, DataFrame):
        keys = counts.sparkSession.createDataFrame(pa.table({"key": distinct_keys(data, offsets)[0]}))
        counts = Counts.of(counts.join(keys, "key").toArrow())
    lengths = np.diff(offsets)
    accepted, rejected = log_likelihoods(counts, data, offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(owner, rejected - accepted, len(lengths)) / np.maximum(lengths, 1)


def counted(labelled: DataFrame) -> DataFrame:
    """``key``, ``accepted``, ``rejected``: how often each key occurs, from ``url`` and ``rejected`` (boolean)."""
    def count(batches):
        for block in text_blocks(batches, "url", COUNT_BYTES):
            flag = np.asarray(block.column("rejected").to_pylist(), bool)
            for c in (False, True):
                part = block.filter(pa.array(flag == c))
                if part.num_rows:
                    keys, n = distinct_keys(*utf8(part.column("url")))
                    none = np.zeros_like(n)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(none if c else n), pa.array(n if c else none)],
                                                     names=["key", "accepted", "rejected"])

    each = labelled.select("url", "rejected").mapInArrow(count, "key long, accepted long, rejected long")
    sums = each.groupBy("key").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    return written(sums, "counts")


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with the ``difference`` of ``url``; a column of this name is replaced."""
    rows = rows.drop("difference")
    of_block, = free_names(rows, "block")

    def number(batches):
        first = TaskContext.get().partitionId() << 32
        for k, block in enumerate(text_blocks(batches, "url", BLOCK_BYTES)):
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(np.full(block.num_rows, first + k))],
                                             names=[*block.schema.names, of_block])

    def keys(batches):
        for batch in batches:
            block = batch.column(of_block).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)] if len(block) else [0]
            for start, stop in zip(edges, edges[1:]):
                found, _ = distinct_keys(*utf8(batch.column("url").slice(start, stop - start)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block[start])), pa.array(found)],
                                                 names=[of_block, "key"])

    def score(block, found):
        d = differences(Counts.of(found), *utf8(block.column("url").combine_chunks()))
        return block.drop_columns([of_block]).append_column("difference", pa.array(d))

    numbered = written(rows.mapInArrow(number, _with(rows, f"{of_block} long")), "urls")
    wanted = numbered.select(of_block, "url").mapInArrow(keys, f"{of_block} long, key long")
    found = wanted.join(counts, "key").select(of_block, "key", "accepted", "rejected")
    return numbered.groupBy(of_block).cogroup(found.groupBy(of_block)).applyInArrow(score, _with(rows, "difference double"))


def learn(labelled: DataFrame) -> tuple[DataFrame, float]:
    """The table of counts and the threshold, from ``url``, ``rejected`` (boolean) and ``calibrates`` (boolean)."""
    counts = counted(labelled.where(~F.col("calibrates")))
    return counts, threshold_of(scored(labelled.where("calibrates").select("url", "rejected"), counts))


def threshold_of(graded: DataFrame) -> float:
    """The threshold from ``difference`` and ``rejected`` of URLs that the counts have not seen."""
    at = F.floor((F.col("difference") + SPAN) / (2 * SPAN) * BINS)
    at = F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1))
    seen = np.zeros((2, BINS))
    for r in graded.groupBy(F.col("rejected").cast("int").alias("c"), at.alias("bin")).agg(F.count("*").alias("n")).collect():
        seen[r["c"], r["bin"]] = r["n"]
    return calibrated(seen)


def calibrated(histogram: np.ndarray) -> float:
    """The bin edge nearest to 0 with the best mean of both classes' hit rates; 0 if a class has no rows."""
    if not histogram.sum(1).all():
        return 0.0
    share = histogram / histogram.sum(1, keepdims=True)
    accepted_below = np.concatenate(([0], np.cumsum(share[0])))
    rejected_above = 1 - np.concatenate(([0], np.cumsum(share[1])))
    gain = np.round(accepted_below + rejected_above, 9)
    edges = np.linspace(-SPAN, SPAN, BINS + 1)
    best = np.flatnonzero(gain == gain.max())
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the model's ``difference``.

    A null or odd URL has empty host and path, so no rule; the model judges its text (an
    empty one is allowed). If no rule has accepted or none has rejected anything, there is
    nothing to compare with and URLs without a rule are allowed. Columns of these names in
    ``pages`` are replaced. Repeated rows get equal verdicts.
    """
    new = ("host", "path", "rule", "verdict", "difference")
    host, path = host_and_path(F.col("url"))
    rows = pages.drop(*new).withColumn("host", host).withColumn("path", path)
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("verdict", verdict)
    rejected, calibrates = F.col("verdict") == BLOCK, F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)) == 0
    labelled = F.col("rule").isNotNull()
    counts = counted(rows.where(labelled & ~calibrates).select("url", rejected.alias("rejected")))
    graded = written(scored(rows, counts), "scored")
    threshold = threshold_of(graded.where(labelled & calibrates).select("difference", rejected.alias("rejected")))
    seen = counts.where(F.col("key") == _CONTEXT).first()
    both = bool(seen and seen["accepted"] and seen["rejected"])
    return graded.withColumn("verdict", F.coalesce(
        "verdict", F.when((F.col("difference") > threshold) & F.lit(both), BLOCK).otherwise(ALLOW)))


def _with(df: DataFrame, field: str):
    from pyspark.sql.types import StructType

    name, kind = field.split()
    return StructType(list(df.schema.fields)).add(name, kind)
