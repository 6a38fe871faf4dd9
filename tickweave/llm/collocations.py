"""Phrases whose words belong together, by Toivonen's sampling of frequent sequences.

1. A sample of the rows proposes words and phrases (``SAMPLE``, ``PROPOSED``).
2. A pass over all rows counts all words, and every longer phrase whose two parts, without
   the last and without the first word, are both proposed. These are the proposed phrases
   and their negative border, as far as it occurs at all. What is counted is a hash of the
   phrase, so a count is never too small, and seldom too large.
3. If the border turns out to hold frequent words or phrases, they are added to what is
   proposed, and another pass counts the phrases that this opens up. Passes go on until
   nothing frequent is missing, so the result does not depend on the sample.
4. A last pass counts those that reached the bound by their words, exactly.

Tasks look phrases up in a bitmap of ``BITS`` bits, which every pass sends to all of them:
its size never grows with the data. Two phrases with one bit only mean that more is counted
than needed.

A task counts up to ``HELD`` hashes together before anything is shuffled, so a phrase that all
rows hold is a few numbers of each task. They travel as arrays of 32-bit numbers, sorted, one
array for each bucket of hashes, and a bucket adds them up.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tickweave.llm.common import Powers, lower, mix, range_hashes, text_blocks, utf8, within, words, written

LEAST = 10              # occurrences of a phrase
LONGEST = 3             # words of a phrase
TOP = 2000              # phrases of each language
COVERED = 50            # percent of a phrase's occurrences inside a longer one, from which on it is dropped
SAMPLE = 8              # one row in so many is sampled
PROPOSED = 2            # occurrences in the sample that make a proposal
BITS = 1 << 27          # a power of two
RANKED = 20_000         # candidates that are ranked at a time
_CHUNK = 1 << 16
BLOCK = 2 << 20         # bytes of text that a task takes apart at a time
HELD = 2 << 20          # hashes that a task counts together, about
BUCKET = 8 << 20        # bytes of text for each bucket of hashes
_LOW = np.uint64((1 << 32) - 1)

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _CUT.copy()
_BETWEEN[[0x20, 0x09]] = True


def _segments(block: pa.RecordBatch):
    """(bytes, offsets, languages) of a block; a text that is longer than a block is cut between pieces."""
    lang = block.column("lang").fill_null("und").to_pylist()
    data, offsets = utf8(block.column("text"))
    if block.num_rows != 1 or len(data) <= BLOCK:
        yield data, offsets, lang
        return
    marks = np.flatnonzero(_CUT[data])
    start = 0
    while start < len(data):
        at = int(np.searchsorted(marks, start + BLOCK))
        stop = int(marks[at]) + 1 if at < len(marks) else len(data)
        yield data[start:stop], np.array([0, stop - start]), lang
        start = stop


def _hits(bitmap: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(hashes), bool)
    bit = hashes & np.uint64(BITS - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _joined(text: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Strings of the words in each row of ``ids``, with a blank between them."""
    n, k = ids.shape
    size = length[ids] + 1
    size[:, -1] -= 1
    flat, take = size.ravel(), length[ids].ravel()
    first = np.cumsum(flat) - flat
    out = np.full(int(flat.sum()), 0x20, np.uint8)
    at = within(np.concatenate(([0], np.cumsum(take))))
    out[np.repeat(first, take) + at] = text[np.repeat(start[ids].ravel(), take) + at]
    ends = np.concatenate(([0], np.cumsum(size.sum(1))))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]
                                            ).cast(pa.large_string()).cast(pa.string())


def _key(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its beginning and of its last word."""
    return mix(hashes * np.uint64(31) + last)


class _Words:
    """The words of a segment: where they are, which follow each other in one piece, and their hashes."""

    def __init__(self, data, offsets, lang, powers):
        self.data = lower(data)
        self.starts, self.stops, first = words(self.data, offsets, _BETWEEN)
        doc = np.repeat(np.arange(len(lang)), np.diff(first))
        cuts = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_CUT[data], out=cuts[1:])
        self.follows = (doc[1:] == doc[:-1]) & (cuts[self.starts[1:]] == cuts[self.stops[:-1]])
        langs = pa.array(lang, pa.string()).dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy().astype(np.int64)[doc]
        self.hash = range_hashes(self.data, self.starts, self.stops, powers)
        self.word = _key(_hashes(self.langs, powers)[self.lang], self.hash)

    def chain(self, hashes, k):
        """The hashes of phrases of ``k`` words from those of one word less."""
        return _key(hashes[:-1], self.hash[k - 1:])


def _hashes(strings: pa.Array, powers: Powers) -> np.ndarray:
    data, at = utf8(strings)
    return range_hashes(data, at[:-1], at[1:], powers)


def _opened(words: _Words, longest: int, now: np.ndarray | None, before: np.ndarray | None):
    """The hashes of all words and phrases that ``now`` opens; with ``before``, only of phrases that it did not."""
    if before is None:
        yield words.word
    own, known = words.word, _hits(now, words.word)
    old = np.zeros(len(own), bool) if before is None else _hits(before, own)
    for k in range(2, longest + 1):
        opened = known[:-1] & known[1:] & words.follows[k - 2:]
        old = old[:-1] & old[1:] & opened
        own = words.chain(own, k)
        yield own[opened & ~old]
        if k < longest:
            known = opened & _hits(now, own)
            old &= known if before is None else _hits(before, own)


def _frequent(words: _Words, longest: int, often: np.ndarray):
    """(language, phrase, n) of the words and phrases in ``often``; the phrase '' has the number of words."""
    size = words.stops - words.starts
    ends = np.concatenate(([0], np.cumsum(size)))
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.stops] -= 1
    body = words.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(body)]
                                             ).dictionary_encode()
    word = names.indices.to_numpy().astype(np.int64)
    text, at = utf8(names.dictionary)
    n_langs, n_words = len(words.langs), len(at) - 1
    yield words.langs, pa.array([""] * n_langs, pa.string()), pa.array(np.bincount(words.lang, minlength=n_langs))
    own, there = words.word, np.ones(len(word), bool)
    for k in range(1, longest + 1):
        if k > 1:
            there = there[:-1] & there[1:] & words.follows[k - 2:]
            own = words.chain(own, k)
        there = there & _hits(often, own)
        place = np.flatnonzero(there)
        if not len(place):
            return
        key, n = words.lang[place] * n_words + word[place], n_langs * n_words
        for j in range(1, k):
            if n * n_words >= 1 << 62:
                seen, key = np.unique(key, return_inverse=True)
                n = len(seen)
            key, n = key * n_words + word[place + j], n * n_words
        _, one, n = np.unique(key, return_index=True, return_counts=True)
        place = place[one]
        phrases = _joined(text, at[:-1], np.diff(at), word[place[:, None] + np.arange(k)])
        yield words.langs.take(pa.array(words.lang[place])), phrases, pa.array(n)


def _pass(docs: DataFrame, count, shape: str, *bitmaps) -> DataFrame:
    """The batches that ``count`` makes of the segments of a task's texts."""
    packed = [None if x is None else zstandard.compress(x.tobytes(), 1) for x in bitmaps]
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def segments(batches):
        powers = Powers()
        for block in text_blocks(batches, "text", BLOCK):
            for segment in _segments(block):
                words = _Words(*segment, powers)
                if len(words.starts):
                    yield words

    def run(batches):
        bitmaps = [None if x is None else np.frombuffer(zstandard.decompress(x), np.uint8) for x in shared.value]
        return count(segments(batches), *bitmaps)

    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.where("text is not null").mapInArrow(run, shape)


def _bucketed(hashes: np.ndarray, longest: bool, buckets: int) -> pa.RecordBatch:
    """For each bucket, the low halves of its hashes: those that occur once, and the others with their counts."""
    each, n = np.unique(hashes, return_counts=True)         # so a bucket's hashes lie together, in order
    bucket = ((each >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    ends = np.flatnonzero(np.concatenate((bucket[1:] != bucket[:-1], [True]))) + 1
    starts = np.concatenate(([0], ends[:-1]))
    low, single = (each & _LOW).astype(np.uint32), n == 1
    rows = [(low[s:e][single[s:e]].tobytes(), low[s:e][~single[s:e]].tobytes(), n[s:e][~single[s:e]].astype(np.uint32).tobytes())
            for s, e in zip(starts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts]), pa.array(np.full(len(starts), longest)), *[pa.array(c, pa.binary()) for c in zip(*rows)]],
        names=["bucket", "longest", "once", "more", "counts"])


def _hash_counts(docs: DataFrame, buckets: int, least: int, longest: int, now: np.ndarray | None,
                 before: np.ndarray | None) -> DataFrame:
    """``hash`` (its low half) of all words and phrases that ``now`` opens and ``before`` did not, with ``least`` occurrences.

    ``longest`` says which have so many words.
    """
    def count(segments, now, before):
        held = {False: [], True: []}
        for words in segments:
            level = 1 if before is None else 2
            for hashes in _opened(words, longest, now, before):
                held[level == longest].append(hashes)
                level += 1
            for flag, parts in held.items():
                if sum(map(len, parts)) >= HELD:
                    yield _bucketed(np.concatenate(parts), flag, buckets)
                    parts.clear()
        for flag, parts in held.items():
            if sum(map(len, parts)):
                yield _bucketed(np.concatenate(parts), flag, buckets)

    def added(frame):
        numbers = lambda column: np.concatenate([np.frombuffer(x, np.uint32) for x in column])
        once, more = numbers(frame["once"]), numbers(frame["more"])
        low, which = np.unique(np.concatenate((once, more)), return_inverse=True)
        n = np.bincount(which, np.concatenate((np.ones(len(once)), numbers(frame["counts"]))))
        low = low[n >= least]
        return pd.DataFrame({"hash": low.astype(np.int64), "longest": np.full(len(low), bool(frame["longest"].iloc[0]))})

    each = _pass(docs, count, "bucket long, longest boolean, once binary, more binary, counts binary", now, before)
    return each.groupBy("bucket", "longest").applyInPandas(added, "hash long, longest boolean")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of the hashes; at most BITS / 8 bytes come to the driver."""
    def packed(frame):
        flags = np.zeros(_CHUNK, bool)
        flags[frame["bit"].to_numpy()] = True
        return frame.iloc[:1][["chunk"]].assign(bits=[zstandard.compress(np.packbits(flags, bitorder="little").tobytes(), 1)])

    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    each = hashes.select(F.floor(bit / _CHUNK).alias("chunk"), (bit % _CHUNK).cast("int").alias("bit")).distinct()
    out = np.zeros(BITS // 8, np.uint8)
    for r in each.groupBy("chunk").applyInPandas(packed, "chunk long, bits binary").collect():
        start = r["chunk"] * _CHUNK // 8
        out[start:start + _CHUNK // 8] = np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
    return out


def _n_words(phrase):
    return F.size(F.split(phrase, " "))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """lang, phrase, n of all words and phrases with ``least`` occurrences, and after how many passes no border was missing.

    The phrase '' has the number of words of the language.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))
    some = docs.where(F.pmod(F.xxhash64("text", "lang"), F.lit(sample)) == 0)
    now = _bitmap(_hash_counts(some, buckets, PROPOSED, max(longest - 1, 1), None, None))
    before, often, passes = None, np.zeros(BITS // 8, np.uint8), 0
    while True:
        reached = written(_hash_counts(docs, buckets, least, longest, now, before), "phrases")
        passes += 1
        border = _bitmap(reached.where("not longest"))
        often |= border | _bitmap(reached.where("longest"))
        if not (border & ~now).any():
            break
        before, now = now, now | border

    def count(segments, often):
        for words in segments:
            for columns in _frequent(words, longest, often):
                yield pa.RecordBatch.from_arrays(list(columns), names=["lang", "phrase", "n"])

    exact = _pass(docs, count, "lang string, phrase string, n long", often).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return written(exact.where((F.col("n") >= least) | (F.col("phrase") == "")), "counts"), passes


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into
    words at blanks and tabs. A null language is ``und``. Null and empty texts have no words.
    Repeated rows count as often as they stand there. ``a`` is the phrase's number of
    occurrences; of its cuts into two parts, with ``l`` and ``r`` occurrences, the one with the
    lowest score floor(1000000 * a * a / (l * r)) counts, the first of several. A phrase with
    half of its occurrences inside one longer phrase is left out. Equal scores go by ``a``,
    then by the phrase. Arithmetic is in 38 digits, exact for up to 10**16 words. A language
    without such phrases has no rows. Other columns are not used.
    """
    found = frequent(docs, least, longest)[0].withColumn("k", _n_words("phrase"))
    total = found.where("phrase = ''").select("lang", F.col("n").alias("all"))
    counts = found.where("phrase <> ''")
    parts = F.split("phrase", " ")
    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumns({
        "left": F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " "),
        "right": F.array_join(F.slice(parts, F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    part = counts.select("lang", "phrase", "n")
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)), ["lang", side])
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("above", exact("a") * exact("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn(
        "below", exact("l") * exact("r")).withColumn("score", F.expr("above div below"))
    scored = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = [F.struct(F.array_join(F.slice(parts, i, m), " ").alias("phrase"), F.lit(m).alias("m"))
             for m in range(2, longest) for i in range(1, longest - m + 2)]
    covers = phrases.where("k > 2").select("lang", "k", "a", F.explode(F.array(*inner)).alias("part")) if inner else None
    if covers is not None:
        covers = covers.where((F.col("part.m") < F.col("k")) & (_n_words("part.phrase") == F.col("part.m"))).groupBy(
            "lang", F.col("part.phrase").alias("phrase")).agg(F.max("a").alias("longer"))
        scored = scored.join(covers, ["lang", "phrase"], "left").where(
            F.coalesce(F.col("longer") * 100 < F.col("a") * COVERED, F.lit(True)))
    kept = written(scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), "scored")

    # ranks in two steps: first among about RANKED phrases of a language at a time
    order = [F.desc("score"), F.desc("a"), "phrase"]
    groups = max(1, -(-kept.count() // RANKED))
    group = F.pmod(F.xxhash64("phrase"), F.lit(groups))
    first = kept.withColumn("nth", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).where(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).join(F.broadcast(total) if total.count() <= RANKED else total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("all").alias("n"), "score")
