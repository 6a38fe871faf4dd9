"""Quality of documents from their lines: a linear-chain conditional random field marks each line content or boilerplate.

A line is described by shares of its characters (upper case, digits, symbols, punctuation),
by its length, its first and last character, whether an earlier line of the text equals it,
and by some of this of the lines around it. Each of these is a bucket with a weight for each
label; two labels of neighbouring lines have a weight too. A document is kept if at least
``SHARE`` percent of its words stand in content lines.

The field is trained from documents with a quality label, whole documents of at most ``LINES``
lines in a row, at most ``DOCS`` of each quality. Lines of good documents are content. Which
lines of a bad one are boilerplate isn't given: at first those that look more like bad
documents than like good ones line by line (naive Bayes), then, for ``ROUNDS`` rounds of
training, those that the field itself marks; the worst line always is. Decoding is Viterbi
over all documents of a block at once.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tickweave.llm.common import text_blocks, utf8, words

DOCS = 300              # labelled documents of each quality
LINES = 64              # of each of these, in a row
ROUNDS = 3
STEPS = 60
SHARE = 50
LEAST_WORDS = 50
MOST_REPEATED = 50      # percent of words in repeated windows of three
BUCKETS = 16            # of each feature
_SHARES = np.array([1e-9, 0.01, 0.03, 0.1, 0.25, 0.5])
_SIZES = np.array([2, 4, 8, 16, 32, 64, 128, 256])

_KIND = np.zeros(256, np.uint8)         # 0: other signs
_KIND[128:] = 1
_KIND[[*range(ord("a"), ord("z") + 1)]] = 1
_KIND[[*range(ord("A"), ord("Z") + 1)]] = 2
_KIND[[*range(ord("0"), ord("9") + 1)]] = 3
_KIND[[*b"#*$%&|<>"]] = 4
_KIND[[*b".,;:!?"]] = 5
_KIND[[0x20, *range(0x09, 0x0E)]] = 6
N_FEATURES = 14


def repeated_windows(word: np.ndarray, first: np.ndarray, n_words: int) -> np.ndarray:
    """Which words lie in a window of three that their text has twice or more.

    ``word`` numbers the words of all texts, equal words alike; ``first`` has each text's first word.
    """
    inside = np.zeros(len(word), bool)
    if len(word) < 3:
        return inside
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[2:] == text[:-2])
    pair = np.unique(word[at] * n_words + word[at + 1], return_inverse=True)[1]
    three = np.unique(pair * n_words + word[at + 2], return_inverse=True)[1]
    _, group, n = np.unique(three * np.int64(len(first)) + text[at], return_inverse=True, return_counts=True)
    often = at[n[group] > 1]
    for k in range(3):
        inside[often + k] = True
    return inside


def _ids(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each byte range, equal for equal bytes, and how many numbers there are."""
    size = stops - starts
    ends = np.concatenate(([0], np.cumsum(size)))
    body = data[np.repeat(starts - ends[:-1], size) + np.arange(ends[-1])]
    names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    coded = names.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


@dataclass
class Lines:
    """A block's texts: counts of each text, and its lines with a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    first: np.ndarray           # lines with a word before each text
    words: np.ndarray           # of each such line
    features: np.ndarray        # (N_FEATURES, lines), each a cell of its own range


def read(data: np.ndarray, offsets: np.ndarray) -> Lines:
    starts, stops, first = words(data, offsets)
    kind = _KIND[data]
    n_words = np.diff(first)
    word, n_names = _ids(data, starts, stops) if len(starts) else (np.zeros(0, np.int64), 1)
    again = np.concatenate(([0], np.cumsum(repeated_windows(word, first, n_names))))
    points = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & (kind != 6))))
    symbols = np.concatenate(([0], np.cumsum(kind == 4)))

    # lines: from each text's start or the byte behind a newline, up to the next newline or the text's end
    newline = np.flatnonzero(data == 0x0A)
    text_of = np.searchsorted(offsets, newline, "right") - 1
    begin = np.concatenate((offsets[:-1], newline + 1))
    owner = np.concatenate((np.arange(len(offsets) - 1), text_of))
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.concatenate((begin[1:] - 1, offsets[-1:]))
    last = np.ones(len(begin), bool)
    last[:-1] = owner[1:] != owner[:-1]
    end[last] = offsets[1:]
    before = np.searchsorted(starts, begin)
    n = np.searchsorted(starts, end) - before
    full = n > 0
    begin, end, owner, before, n = begin[full], end[full], owner[full], before[full], n[full]
    per_text = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))))
    dup = np.zeros(len(begin), bool)
    if len(begin):
        name, n_lines = _ids(data, begin, end)
        key = name * np.int64(len(offsets)) + owner
        dup[:] = True
        dup[np.unique(key, return_index=True)[1]] = False

    size = np.maximum(end - begin, 1)
    part = lambda k: (lambda c: c[end] - c[begin])(np.concatenate(([0], np.cumsum(kind == k))))
    letters = np.maximum(part(1) + part(2), 1)
    share = lambda x, of: np.searchsorted(_SHARES, x / of, "right")
    symbol, upper = share(part(4), size), share(part(2), letters)
    own = [symbol, upper, share(part(3), size), share(part(5), size), share(part(0), size), np.searchsorted(_SIZES, n, "right"),
           np.searchsorted(_SIZES, (size - part(6)) // np.maximum(n, 1), "right"), dup.astype(np.int64)]
    if len(begin):
        own += [kind[starts[before]].astype(np.int64), kind[stops[before + n - 1] - 1].astype(np.int64)]
        is_first, is_last = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
        is_first[per_text[:-1][np.diff(per_text) > 0]] = True
        is_last[per_text[1:][np.diff(per_text) > 0] - 1] = True
        own += [np.where(is_first, BUCKETS - 1, np.roll(symbol, 1)), np.where(is_last, BUCKETS - 1, np.roll(symbol, -1)),
                np.where(is_first, BUCKETS - 1, np.roll(upper, 1)), np.where(is_last, BUCKETS - 1, np.roll(upper, -1))]
    features = np.stack(own) + np.arange(N_FEATURES)[:, None] * BUCKETS if len(begin) else np.zeros((N_FEATURES, 0), np.int64)
    of_text = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    return Lines(n_words, of_text(points), of_text(symbols), np.bincount(owner[dup], minlength=len(offsets) - 1),
                 again[first[1:]] - again[first[:-1]], per_text, n, features)


@dataclass
class Field:
    weights: np.ndarray     # (N_FEATURES * BUCKETS, 2): content, boilerplate
    moves: np.ndarray       # (2, 2)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(0)


def decode(field: Field, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of each line, by Viterbi over all texts together, the longest first."""
    emit = field.scores(features)
    n_lines = np.diff(first)
    order = np.argsort(-n_lines, kind="stable")[:int((n_lines > 0).sum())]
    begin, length = first[:-1][order], n_lines[order]
    label = np.zeros(len(emit), np.int8)
    if not len(order):
        return label
    best = emit[begin]
    back = np.zeros(emit.shape, np.int8)
    active = np.searchsorted(-length, -np.arange(length[0]), "left")        # texts with more lines than that
    for t in range(1, int(length[0])):
        k = active[t]
        ways = best[:k, :, None] + field.moves
        back[begin[:k] + t] = ways.argmax(1)
        best[:k] = ways.max(1) + emit[begin[:k] + t]
    now = best.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        k = active[t]
        label[begin[:k] + t] = now[:k]
        if t:
            now[:k] = back[begin[:k] + t, now[:k]]
    return label


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, start: Field | None = None) -> Field:
    """Adam on the mean log-likelihood of the label sequences, by forward and backward sums over all texts together."""
    n_lines = np.diff(first)
    texts, longest = len(n_lines), int(n_lines.max())
    at = first[:-1][:, None] + np.minimum(np.arange(longest), n_lines[:, None] - 1)
    inside = np.arange(longest) < n_lines[:, None]
    field = start or Field(np.zeros((N_FEATURES * BUCKETS, 2)), np.zeros((2, 2)))
    weights, moves = field.weights.copy(), field.moves.copy()
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    target = np.eye(2)[label]
    follows = np.zeros((2, 2))
    head = np.zeros(len(label), bool)
    head[first[:-1]] = True
    np.add.at(follows, (label[:-1][~head[1:]], label[1:][~head[1:]]), 1)
    for step in range(1, STEPS + 1):
        emit = Field(weights, moves).scores(features)
        each = emit[at]
        alpha, beta = np.empty((longest, texts, 2)), np.zeros((longest, texts, 2))
        alpha[0] = each[:, 0]
        for t in range(1, longest):
            alpha[t] = np.where(inside[:, t, None], _logsum(alpha[t - 1][:, :, None] + moves, 1) + each[:, t], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            beta[t] = np.where(inside[:, t + 1, None], _logsum(moves + (each[:, t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        total = _logsum(alpha[-1], 1)
        chance = np.exp(alpha + beta - total[None, :, None])
        expected = np.zeros((len(label), 2))
        pairs = np.zeros((2, 2))
        for t in range(longest):
            ok = inside[:, t]
            expected[at[ok, t]] = chance[t][ok]
            if t:
                pairs += np.exp(alpha[t - 1][ok][:, :, None] + moves + (each[ok, t] + beta[t][ok])[:, None, :]
                                - total[ok][:, None, None]).sum(0)
        slope = -0.002 * weights
        for x in features:
            for k in (0, 1):
                slope[:, k] += np.bincount(x, (target - expected)[:, k], len(weights)) / texts
        for p, g, m, v in ((weights, slope, 0, 1), (moves, (follows - pairs) / texts - 0.002 * moves, 2, 3)):
            state[m] = 0.9 * state[m] + 0.1 * g
            state[v] = 0.99 * state[v] + 0.01 * g * g
            p += 0.1 * (state[m] / (1 - 0.9 ** step)) / (np.sqrt(state[v] / (1 - 0.99 ** step)) + 1e-8)
    return Field(weights, moves)


def train(sample: list[tuple[bool, np.ndarray]]) -> Field | None:
    """A field from (whether the document is good, its lines' features); None without documents of both kinds."""
    sample = [(good, x) for good, x in sample if x.shape[1]]
    if len({good for good, _ in sample}) < 2:
        return None
    features = np.concatenate([x for _, x in sample], 1)
    first = np.concatenate(([0], np.cumsum([x.shape[1] for _, x in sample])))
    bad = np.repeat([not good for good, _ in sample], np.diff(first))
    count = np.stack([np.bincount(features[:, side].ravel(), minlength=N_FEATURES * BUCKETS) for side in (~bad, bad)], 1) + 1.0
    looks = np.log(count / count.sum(0))
    score = np.diff(looks[features].sum(0), axis=1)[:, 0]
    label, field = (bad & (score > 0)).astype(np.int64), None
    for _ in range(ROUNDS):
        for i, (good, _) in enumerate(sample):
            if not good:
                s, e = first[i], first[i + 1]
                label[s + int(score[s:e].argmax())] = 1
        field = fit(features, first, label, field)
        label = np.where(bad, decode(field, features, first), 0).astype(np.int64)
        score = np.diff(field.scores(features), axis=1)[:, 0]
    return field


def _fails(x: Lines) -> np.ndarray:
    return (x.n_words < LEAST_WORDS) | (100 * x.n_repeat_words > MOST_REPEATED * x.n_words)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[bool, np.ndarray]]:
    """The features of up to DOCS labelled documents of each quality, chosen by a hash of the row.

    ``labels`` has doc_id and ``quality`` (1 good, 0 bad); an id with both is left out, and so
    are documents that fail without the field. Of a document with over LINES lines, LINES in a row are taken, the first one by a hash of its text.
    """
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    known = one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit(3))
    ids = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(DOCS) for q in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    draw = F.xxhash64("doc_id", "text", F.lit(4))
    parts = [chosen.where(F.col("quality") == q).orderBy(draw).limit(DOCS) for q in (0, 1)]

    def run(batches):
        for block in text_blocks(batches, "text"):
            lines = read(*utf8(block.column("text")))
            failed = _fails(lines)
            for i, quality in enumerate(block.column("quality").to_pylist()):
                if failed[i]:
                    continue
                s, e = int(lines.first[i]), int(lines.first[i + 1])
                s += (int(lines.n_words[i]) * 7919) % max(1, e - s - LINES + 1)
                own = lines.features[:, s:min(e, s + LINES)]
                yield pa.RecordBatch.from_arrays([pa.array([quality]), pa.array([own.astype(np.int16).tobytes()])],
                                                 names=["quality", "features"])

    rows = parts[0].unionByName(parts[1]).select(F.col("quality").cast("long").alias("quality"), "text").mapInArrow(
        run, "quality long, features binary").collect()
    rows = sorted(rows, key=lambda r: (r["quality"], bytes(r["features"])))
    return [(r["quality"] == 1, np.frombuffer(r["features"], np.int16).reshape(N_FEATURES, -1).astype(np.int64)) for r in rows]


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words and kept.

    Words are ``[^\\x20\\x09-\\x0D]+``, lines are cut at newlines, and a line without a word
    is none. A null or empty text has no words; it fails, as every text does with fewer than
    LEAST_WORDS words or over MOST_REPEATED percent of them in repeated windows of three.
    ``content_words`` are those in lines that the field marks content. Without a field all
    lines are content. Columns of these names are replaced, all others stay, and repeated
    rows get equal results.
    """
    new = [*_LONGS, "base_failed", "content_words", "kept"]
    own = docs.drop(*new)
    schema = T.StructType([*own.schema.fields, *[T.StructField(c, T.LongType()) for c in _LONGS],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("content_words", T.LongType()),
                           T.StructField("kept", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        for block in text_blocks(batches, "text"):
            x = read(*utf8(block.column("text")))
            label = decode(field, x.features, x.first) if field else np.zeros(len(x.words), np.int8)
            content = np.concatenate(([0], np.cumsum(np.where(label == 0, x.words, 0))))
            content = content[x.first[1:]] - content[x.first[:-1]]
            failed = _fails(x)
            kept = ~failed & (100 * content >= SHARE * x.n_words)
            yield pa.RecordBatch.from_arrays(
                [*block.columns, *[pa.array(getattr(x, c).astype(np.int64)) for c in _LONGS], pa.array(failed),
                 pa.array(content.astype(np.int64)), pa.array(kept)], names=[*block.schema.names, *new])

    return own.mapInArrow(run, schema)
