"""What the operators share: tables between steps, blocks of text, and hashes of bytes."""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK_BYTES = 4 << 20       # text that a task holds as arrays at a time; a longer single text is a block of its own


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there; the files go when the driver ends."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that are no columns of ``df``, whatever it has."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of all columns of a row, of any type; nulls count."""
    def plain(c: str) -> Column:        # maps and variants have no hash, their JSON has
        kind = df.schema[c].dataType.simpleString()
        return F.to_json(F.struct(df[c])) if "map<" in kind or "variant" in kind else df[c]

    parts = [x for c in df.columns for x in (df[c].isNull(), plain(c))]
    return F.xxhash64(F.lit(0), *parts), F.xxhash64(F.lit(1), *parts)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text (one more than there are texts); null is empty."""
    texts = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    texts = texts.fill_null(b"") if texts.null_count else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_blocks(batches, column: str, limit: int = BLOCK_BYTES):
    """Cut record batches into runs of rows whose texts have about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as code points (uint32) with the offset of each text."""
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, before[offsets]


def within(offsets: np.ndarray) -> np.ndarray:
    """For each element, its position in its own run."""
    lengths = np.diff(offsets)
    return np.arange(offsets[-1], dtype=np.int64) - np.repeat(offsets[:-1], lengths)


_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _S)
    h = h * _A
    h ^= h >> _S
    h *= _B
    h ^= h >> _S
    return h


class Powers:
    """Powers of an odd multiplier modulo 2**64 and their inverses, kept and grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
            self.up = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _PRIME))))
            self.down = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, inverse))))
        return self.up[:n], self.down[:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * _B)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, space=_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words ``[^\\x20\\x09-\\x0D]+``, and how many words come before each text.

    ``space`` says of each of the 256 bytes whether it stands between words instead.
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    edge = inside[1:] != inside[:-1]
    first = np.zeros(len(data) + 1, bool)       # a word ends where its text does
    first[offsets[1:-1]] = True
    joint = first & inside[1:] & inside[:-1]
    starts = np.flatnonzero((edge & inside[1:]) | joint)
    stops = np.flatnonzero((edge & inside[:-1]) | joint)
    return starts, stops, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]
