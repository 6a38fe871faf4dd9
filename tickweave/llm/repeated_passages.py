"""Removal of repeated passages through merged Burrows-Wheeler transforms.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a document with a
smaller id. Documents are kept in blocks of a few MB, and three rounds pass between blocks
and buckets:

1. Every window of LENGTH bytes names its smallest GRAM-byte hash (a minimiser). Equal
   windows name equal hashes, so windows whose hash occurs in one document only are unique.
   Buckets of hashes find those that occur in several documents.
2. Blocks send the stretches of windows under one such hash to the hash's bucket, equal
   stretches once with their smallest id. A stretch is at most 2 * LENGTH - GRAM bytes long.
3. A bucket groups equal stretches. Where a hash has several different stretches, they are
   dealt to shards; each shard's suffixes are sorted and give its Burrows-Wheeler
   transform. The transforms are merged by refining the interleave one symbol at a time
   (Holt and McMillan, 2014), which orders all suffixes by LENGTH symbols without sorting them again;
   runs of rows with a common prefix of LENGTH bytes are the repeated intervals. Each run's
   smallest id says in which documents its windows go.

A string that a third of all documents share is one row per block on its way, and one
stretch in its bucket. All windows are judged on the input.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickweave.llm.common import Powers, mix, range_hashes, text_blocks, utf8, within, written

LENGTH = 50
GRAM = 20
BLOCK = 3 << 20         # bytes of text in a block; a longer text is a block of its own
BUCKET = 16 << 20       # bytes of text for each bucket of hashes
BATCH = 1 << 20         # bytes of stretches that are sorted and merged at a time
SHARDS = 4
_LOW = np.uint64((1 << 32) - 1)


def packed(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def to_blocks(docs: DataFrame) -> DataFrame:
    """Rows of block, ids, has_id, offsets, data (compressed arrays)."""
    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for block in text_blocks(batches, "text", BLOCK):
            data, offsets = utf8(block.column("text"))
            ids = block.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | k]), pa.array([packed(ids.fill_null(0).to_numpy())]),
                 pa.array([packed(ids.is_valid().to_numpy(zero_copy_only=False))]), pa.array([packed(offsets)]),
                 pa.array([packed(data)])], names=["block", "ids", "has_id", "offsets", "data"])
            k += 1

    return docs.select("doc_id", "text").mapInArrow(
        run, "block long, ids binary, has_id binary, offsets binary, data binary")


class Block:
    def __init__(self, row):
        self.ids, self.has_id = unpacked(row["ids"], np.int64), unpacked(row["has_id"], bool)
        self.offsets, self.data = unpacked(row["offsets"], np.int64), unpacked(row["data"], np.uint8)

    def windows(self, powers: Powers):
        """Runs of windows with one minimiser: hash, document number, first window, how many."""
        data, offsets = self.data, self.offsets
        n = len(data)
        if n < LENGTH:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
        up, down = powers.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n - GRAM + 1])
        del sums
        # smallest hash over the grams of each window, with its place in the low bits
        width, span = 1, LENGTH - GRAM + 1
        low = np.uint64((1 << 23) - 1) if n < 1 << 23 else np.uint64((1 << 32) - 1)
        best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        m = best
        while width * 2 <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[:n - LENGTH + 1], m[span - width:span - width + n - LENGTH + 1])
        place = (m & low).astype(np.int64)
        lengths = np.diff(offsets)
        last = np.where(self.has_id, offsets[1:] - LENGTH, -1)      # a document's last window
        doc = np.repeat(np.arange(len(lengths)), lengths)[:len(m)]
        inside = np.arange(len(m)) <= last[doc]
        new = np.ones(len(m), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.concatenate((head, [len(m)])))
        some = inside[head]
        head, count = head[some], count[some]
        return grams[place[head]], doc[head], head, count


def _by_bucket(hashes: np.ndarray, buckets: int):
    """(bucket, positions) of hashes, positions in the order of hashes."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes & _LOW, bucket))
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b]:ends[b + 1]]


def fingerprints(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, the distinct hashes of the block's windows, and whether several of its documents have them."""
    def run(batches):
        powers = Powers()
        for batch in batches:
            for row in batch.to_pylist():
                hashes, doc, _, _ = Block(row).windows(powers)
                out = []
                for b, at in _by_bucket(hashes, buckets):
                    m, d = (hashes[at] & _LOW).astype(np.uint32), doc[at]
                    cuts = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
                    several = np.minimum.reduceat(d, cuts) != np.maximum.reduceat(d, cuts)
                    out.append((b, row["block"], packed(m[cuts]), packed(several)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["bucket", "block", "hashes", "several"])

    return blocks.mapInArrow(run, "bucket long, block long, hashes binary, several binary")


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """For each block of a bucket, those of its hashes that occur in several documents."""
    each = [unpacked(x, np.uint32) for x in frame["hashes"]]
    m = np.concatenate(each)
    order = np.argsort(m, kind="stable")
    new = np.ones(len(m), bool)
    new[1:] = m[order][1:] != m[order][:-1]
    group = np.cumsum(new) - 1
    often = np.bincount(group) > 1
    often |= np.bincount(group, np.concatenate([unpacked(x, bool) for x in frame["several"]])[order]) > 0
    keep = np.empty(len(m), bool)
    keep[order] = often[group]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in each])))
    rows = [(b, frame["bucket"].iloc[0], packed(e[keep[s:t]])) for b, e, s, t in zip(frame["block"], each, ends[:-1], ends[1:])
            if keep[s:t].any()]
    return pd.DataFrame(rows, columns=["block", "bucket", "hashes"])


def _stretches(blocks: pd.DataFrame, shared: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """A block's stretches for each bucket: distinct strings with smallest id, and where each occurs."""
    out = []
    if len(blocks) and len(shared):
        powers = Powers()
        block = Block(blocks.iloc[0])
        hashes, doc, head, count = block.windows(powers)
        wanted = {b: unpacked(x, np.uint32) for b, x in zip(shared["bucket"], shared["hashes"])}
        names = range_hashes(block.data, head, head + count + LENGTH - 1, powers)
        for b, at in _by_bucket(hashes, buckets):
            if b not in wanted:
                continue
            m = (hashes[at] & _LOW).astype(np.uint32)
            near = np.minimum(np.searchsorted(wanted[b], m), len(wanted[b]) - 1)
            hit = wanted[b][near] == m
            at, m = at[hit], m[hit]
            start, size = head[at], count[at] + LENGTH - 1
            name = names[at]
            ids = block.ids[doc[at]]
            order = np.lexsort((ids, name))
            new = np.ones(len(order), bool)
            new[1:] = name[order][1:] != name[order][:-1]
            first = order[new]
            length = size[first]
            ends = np.concatenate(([0], np.cumsum(length)))
            text = block.data[np.repeat(start[first], length) + within(ends)]
            out.append((b, blocks["block"].iloc[0], packed(text), packed(length.astype(np.int32)), packed(m[first]),
                        packed(ids[first]), packed(np.cumsum(new).astype(np.int32) - 1), packed(ids[order]),
                        packed(start[order].astype(np.int32))))
    return pd.DataFrame(out, columns=["bucket", "block", "text", "length", "hash", "lowest", "which", "ids", "start"])


def suffix_order(symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of strings that end with symbol 0 at ``end``, equal ones by place; and their first 8 symbols."""
    n = len(symbols)
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        here = np.zeros(n, np.uint64)
        here[:n - k] = symbols[k:]
        here[at + k > end] = 0
        key = key << np.uint64(8) | here
    depth, rank = 8, key
    longest = int((end - at).max()) + 1
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.ones(n, bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        if depth >= longest or new.all():
            return order, key
        dense = np.empty(n, np.uint64)
        dense[order] = np.cumsum(new)
        nxt = np.zeros(n, np.uint64)
        nxt[:n - depth] = dense[depth:]
        nxt[at + depth > end] = 0
        rank = dense << np.uint64(32) | nxt
        depth *= 2


def merged_order(text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, place in it) of all suffixes, ordered by their first LENGTH bytes.

    Strings are dealt to SHARDS by turns. Bytes become dense symbols; with all 256 in use,
    the two largest that occur least together would not fit one byte, so symbols take two.
    """
    used = np.zeros(257, np.int64)
    used[1:][np.unique(text)] = 1
    dense = np.cumsum(used)[1:]
    start = np.concatenate(([0], np.cumsum(length)))[:-1]
    transforms, strings, places, keys, n_ends = [], [], [], [], []
    for s in range(SHARDS):
        own = np.arange(s, len(length), SHARDS)
        if not len(own):
            continue
        size = length[own] + 1
        ends = np.cumsum(size)
        string = np.repeat(own, size)
        place = within(np.concatenate(([0], ends)))
        final = np.repeat(ends - 1, size)
        symbols = np.zeros(int(ends[-1]), np.int64)
        body = np.arange(len(symbols)) != final
        symbols[body] = dense[text[start[string[body]] + place[body]]]
        order, key = _sorted(symbols, final)
        before = np.where(place[order] > 0, symbols[order - 1], 0)
        transforms.append(before)
        strings.append(string[order])
        places.append(place[order])
        keys.append(key[order])
        n_ends.append(len(own))
    kind = np.uint8 if dense.max(initial=0) < 256 else np.uint16
    transform = np.concatenate(transforms).astype(kind)
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms]).astype(np.uint8)
    ends_first = np.repeat(np.arange(len(n_ends)), n_ends).astype(np.uint8)
    key = np.concatenate(keys)
    interleave = shard[np.argsort(key, kind="stable")]      # ordered by 8 symbols (4 if they take two bytes)
    symbol = np.empty(len(transform), kind)
    known = 8 if int(dense.max(initial=0)) < 256 else 4     # symbols by which the start is in order already
    for _ in range(LENGTH - known):
        symbol[np.argsort(interleave, kind="stable")] = transform
        new = np.concatenate((ends_first, interleave[np.argsort(symbol, kind="stable")[len(ends_first):]]))
        if np.array_equal(new, interleave):
            break
        interleave = new
    rows = np.empty(len(transform), np.int64)
    rows[np.argsort(interleave, kind="stable")] = np.arange(len(transform))
    return np.concatenate(strings)[rows], np.concatenate(places)[rows]


def _sorted(symbols: np.ndarray, final: np.ndarray):
    """suffix_order for symbols that may need nine bits: two symbols of base 16 stand for one then."""
    if symbols.max() < 256:
        return suffix_order(symbols.astype(np.uint64), final)
    two = np.empty(2 * len(symbols), np.uint64)
    two[0::2], two[1::2] = symbols >> 4, symbols & 15
    order, key = suffix_order(two, np.repeat(2 * final + 1, 2))
    even = order % 2 == 0
    return order[even] // 2, key[0::2]


def smallest_ids(text, length, lowest) -> np.ndarray:
    """For each window of each string, in order, the smallest id among strings that hold an equal window."""
    n_windows = length - LENGTH + 1
    first = np.concatenate(([0], np.cumsum(n_windows)))
    start = np.concatenate(([0], np.cumsum(length)))[:-1]
    string, place = merged_order(text, length)
    full = place < n_windows[string]
    string, place = string[full], place[full]
    at = start[string] + place
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    word = np.zeros(len(text), np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k:len(text) + k]
    new = np.zeros(len(at), bool)
    new[:1] = True
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:        # adjacent rows with a common prefix of LENGTH
        w = word[at + k]
        new[1:] |= w[1:] != w[:-1]
    cuts = np.flatnonzero(new)
    low = np.minimum.reduceat(lowest[string], cuts)
    out = np.empty(first[-1], np.int64)
    out[first[string] + place] = low[np.cumsum(new) - 1]
    return out


def _removals(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows to remove in each block of a bucket: first window and how many."""
    texts = [unpacked(x, np.uint8) for x in frame["text"]]
    text = np.concatenate(texts)
    each = [unpacked(x, np.int32) for x in frame["length"]]
    length = np.concatenate(each).astype(np.int64)
    hashes = np.concatenate([unpacked(x, np.uint32) for x in frame["hash"]])
    lowest = np.concatenate([unpacked(x, np.int64) for x in frame["lowest"]])
    start = np.concatenate(([0], np.cumsum(length)))
    name = np.concatenate([range_hashes(t, e.cumsum() - e, e.cumsum(), Powers()) for t, e in zip(texts, each)])
    _, first, same = np.unique(name, return_index=True, return_inverse=True)
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, same, lowest)
    size, own = length[first], hashes[first]
    windows = np.concatenate(([0], np.cumsum(size - LENGTH + 1)))
    answer = np.repeat(low, size - LENGTH + 1)
    order = np.argsort(own, kind="stable")
    runs = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1], [True])))
    several = np.repeat(np.diff(runs) > 1, np.diff(runs))       # a hash with one string only has its answer
    order = order[several]
    key = own[order]
    total = np.concatenate(([0], np.cumsum(size[order])))
    s = 0
    while s < len(order):
        e = int(np.searchsorted(total, total[s] + BATCH, "right")) - 1
        e = int(np.searchsorted(key, key[max(e - 1, s)], "right"))          # a hash stays whole
        part = order[s:e]
        ends = np.concatenate(([0], np.cumsum(size[part])))
        own_text = text[np.repeat(start[first[part]], size[part]) + within(ends)]
        ids = smallest_ids(own_text, size[part], low[part])
        count = size[part] - LENGTH + 1
        answer[np.repeat(windows[part], count) + within(np.concatenate(([0], np.cumsum(count))))] = ids
        s = e
    out, base = [], 0
    for (_, row), own_length in zip(frame.iterrows(), each):
        which = same[base + unpacked(row["which"], np.int32)]
        base += len(own_length)
        ids, at = unpacked(row["ids"], np.int64), unpacked(row["start"], np.int32).astype(np.int64)
        count = size[which] - LENGTH + 1
        inner = within(np.concatenate(([0], np.cumsum(count))))
        gone = answer[np.repeat(windows[which], count) + inner] < np.repeat(ids, count)
        place = np.sort((np.repeat(at, count) + inner)[gone])
        if len(place):
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(place) != 1)))
            out.append((row["block"], packed(place[cuts]), packed(np.diff(np.concatenate((cuts, [len(place)]))))))
    return pd.DataFrame(out, columns=["block", "first", "windows"])


def _cleaned(blocks: pd.DataFrame, removals: pd.DataFrame, with_text: bool) -> pd.DataFrame:
    """Each document's counts and what is left of it."""
    block = Block(blocks.iloc[0])
    depth = np.zeros(len(block.data) + 1, np.int64)
    for first, count in zip(removals["first"], removals["windows"]):
        first, count = unpacked(first, np.int64), unpacked(count, np.int64)
        np.add.at(depth, first, 1)
        np.add.at(depth, first + count + LENGTH - 1, -1)
    gone = np.cumsum(depth)[:-1] > 0
    out = []
    for i, (s, e) in enumerate(zip(block.offsets[:-1], block.offsets[1:])):
        own = gone[s:e]
        spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
        rest = block.data[s:e][~own].tobytes() if spans else block.data[s:e].tobytes()
        out.append((int(block.ids[i]) if block.has_id[i] else None, int(e - s), int(own.sum()), spans,
                    hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])
    return frame.astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left) of every row.

    A null text is empty. Rows with a null doc_id have no order: they lose nothing and take
    nothing from others. Rows that repeat a doc_id don't take from each other. Texts shorter
    than LENGTH stay. What is left of a text may cut a character in two, as bytes are judged.
    Other columns are not used.
    """
    blocks = written(to_blocks(docs), "blocks")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET))
    shared = written(fingerprints(blocks, buckets).groupBy("bucket").applyInPandas(
        _shared, "block long, bucket long, hashes binary"), "shared")
    columns = "text binary, length binary, hash binary, lowest binary, which binary, ids binary, start binary"
    parts = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(
        lambda a, b: _stretches(a, b, buckets), f"bucket long, block long, {columns}")
    gone = written(parts.groupBy("bucket").applyInPandas(_removals, "block long, first binary, windows binary"), "gone")
    return blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInPandas(
        lambda a, b: _cleaned(a, b, with_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
