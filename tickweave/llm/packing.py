"""Packing of token sequences by swap-based local search.

Documents become pieces of at most ``CAPACITY`` tokens. Pieces are dealt out by a hash to
groups of about ``GROUP`` and each group is packed by one task: a best-fit start, then
moves, one-for-one and two-for-one exchanges between underfull bins. Each step makes the
sum of squared fills larger, so fuller bins get fuller and the emptiest ones empty. A
group leaves at most a few underfull bins among thousands.
"""

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickweave.llm.common import text_blocks, utf8, within, written

CAPACITY = 4096
GROUP = 8192
END_ID = 1
CACHE_WORDS = 600_000       # words whose ids a task remembers
CACHE_RUNS = 800_000        # runs whose ids a task remembers
ENCODE = 4096               # texts that are encoded at a time

#: Words whose lower case is one letter for each and that no normal form changes, and how such a word is split.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u017f0-9]+")
#: The sign by which a byte-level vocabulary writes each byte: itself if it prints, else the next one from 256.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class _Places(dict):
    """Numbers words as they come, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class WordIds:
    """Ids of texts through a tokenizer that drops white space, remembered word by word.

    The tokenizer never joins what ASCII white space separates, so a text's ids are those
    of its words in order. It lower-cases and splits words into runs of letters, digits and
    other signs, so a word of printable ASCII and Latin letters has the ids of its runs,
    which many words share. Other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs: dict[str, list[int]] = {}
        self.clear()

    def clear(self):
        self.places = _Places()
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.runs) > CACHE_RUNS:
            self.runs = {}

    def _run(self, run: str) -> list[int]:
        """The merged ids of one run of lower-case signs."""
        signs = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return [t.id for t in self.model.tokenize(signs)]

    def _encoded(self, texts: list[str]):
        """The whole tokenizer's ids of each text; few encodings are held at a time, as each is large."""
        for k in range(0, len(texts), ENCODE):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[k:k + ENCODE], add_special_tokens=False))

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in new]
        parts = [_RUNS.findall(t.lower()) if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        known = self.runs
        for run in {r for runs in parts if runs for r in runs if r not in known}:
            known[run] = self._run(run)
        other = self._encoded([t for t, runs in zip(texts, parts) if runs is None])
        ids = [next(other) if runs is None else known[runs[0]] if len(runs) == 1 else [i for r in runs for i in known[r]]
               for runs in parts]
        ends = self.begin[-1] + np.cumsum([len(x) for x in ids])
        self.begin = np.concatenate((self.begin, ends))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), np.uint32)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offset of each text's."""
        if len(self.places) > CACHE_WORDS:
            self.clear()
        raw = data.tobytes()
        split = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.places.new = []
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.places.new:
            self._learn(self.places.new)
        lengths = self.begin[at + 1] - self.begin[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        shift = np.repeat(self.begin[at] - ends[:-1], lengths)
        return self.ids[shift + np.arange(len(shift))], ends[np.concatenate(([0], np.cumsum(counts)))]


def pieces(docs: DataFrame, tokenizer: str, with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of each row's pieces.

    ``tokenizer`` is the path of a tokenizer file that every executor has. A null text is
    empty: one piece that holds the end id alone. Repeated rows are packed each.
    """
    def run(batches):
        words = WordIds(tokenizer)
        for block in text_blocks(batches, "text"):
            ids, at = words.encode(*utf8(block.column("text")))
            n = len(at) - 1
            tokens = np.insert(ids, at[1:], END_ID).astype("<u4")
            at = at + np.arange(n + 1)
            length = np.diff(at)
            count = -(-length // capacity)
            first = np.concatenate(([0], np.cumsum(count)))
            owner = np.repeat(np.arange(n), count)
            piece = within(first)
            start = piece * capacity
            size = np.minimum(capacity, length[owner] - start)
            begin = at[owner] + start
            raw = tokens.tobytes()
            crc = [zlib.crc32(raw[4 * b:4 * (b + s)]) for b, s in zip(begin.tolist(), size.tolist())]
            columns = [block.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start),
                       pa.array(size), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(
                    np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(tokens.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers): longest items first, each to the fullest bin that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0                # bit r: a bin with room r is open
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(b)
            some |= 1 << (room - size)
    return bins


class _Underfull:
    """Items of underfull bins in arrays; full bins are done and take no part."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.capacity, self.lengths = capacity, lengths
        self.fill = np.array([sum(lengths[b].tolist()) for b in bins], np.int64)
        self.bin_of = np.empty(len(lengths), np.int64)
        for b, items in enumerate(bins):
            self.bin_of[items] = b
        self.refresh()

    def refresh(self):
        open_bins = (self.fill > 0) & (self.fill < self.capacity)
        self.items = np.flatnonzero(open_bins[self.bin_of])
        self.size = self.lengths[self.items]

    def shift(self, gives: list[int], takes: list[int], source: int, target: int) -> None:
        for i in gives:
            self.bin_of[i] = target
        for i in takes:
            self.bin_of[i] = source
        moved = int(self.lengths[gives].sum() - (self.lengths[takes].sum() if takes else 0))
        self.fill[source] -= moved
        self.fill[target] += moved

    def step(self, source: int) -> bool:
        """One move or exchange that takes tokens from ``source`` to a bin at least as full; False if there is none."""
        bins = self.bin_of[self.items]
        room = self.capacity - self.fill[bins]
        own = self.items[bins == source]
        other = (bins != source) & (self.fill[bins] >= self.fill[source]) & (room > 0)
        if not len(own) or not other.any():
            return False
        items, size, room = self.items[other], self.size[other], room[other]
        rooms = np.unique(room)
        own = own[np.argsort(-self.lengths[own], kind="stable")]
        for x in own.tolist():                      # move
            if self.lengths[x] <= rooms[-1]:
                k = int(np.argmin(np.where(room >= self.lengths[x], room, self.capacity + 1)))
                self.shift([x], [], source, int(self.bin_of[items[k]]))
                return True
        for x in own[np.unique(self.lengths[own], return_index=True)[1]].tolist():     # one for one
            gain = self.lengths[x] - size
            good = np.where((gain > 0) & (gain <= room), gain, 0)
            k = int(good.argmax())
            if good[k]:
                self.shift([x], [int(items[k])], source, int(self.bin_of[items[k]]))
                return True
        sizes = self.lengths[own]
        pairs = own[(np.arange(len(own)) < 2) | (sizes != np.roll(sizes, 2))].tolist()     # two of each length
        tried = set()
        for n, x in enumerate(pairs):               # two for one
            for y in pairs[n + 1:]:
                both = int(self.lengths[x] + self.lengths[y])
                if both in tried:
                    continue
                tried.add(both)
                gain = both - size
                good = np.where((gain > 0) & (gain <= room), gain, 0)
                k = int(good.argmax())
                if good[k]:
                    self.shift([x, y], [int(items[k])], source, int(self.bin_of[items[k]]))
                    return True
        return False


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> np.ndarray:
    """The bin of each item, once no step from the emptiest bins up helps any more."""
    state = _Underfull(lengths, bins, capacity)
    lowest = -(-int(lengths.sum()) // capacity)
    moved = True
    while moved and int((state.fill > 0).sum()) > lowest:
        moved = False
        for source in np.argsort(state.fill, kind="stable").tolist():
            if int((state.fill > 0).sum()) <= lowest:
                break
            while 0 < state.fill[source] < capacity and state.step(source):
                moved = True
            if moved:
                state.refresh()
    return state.bin_of


def pack_group(frame, capacity: int):
    """A group's rows with sequence_id and offset."""
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, kind="stable")
    lengths = frame["length"].to_numpy()
    bins = local_search(lengths, best_fit(lengths.tolist(), capacity), capacity)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    sorted_bins = bins[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_bins[1:] != sorted_bins[:-1]
    before = ends - lengths[order]
    offset = np.empty(len(order), np.int64)
    offset[order] = before - before[np.flatnonzero(new)][np.cumsum(new) - 1]
    group = frame["packing_group"].to_numpy()
    return frame.drop(columns="packing_group").assign(sequence_id=group * (1 << 32) + bins, offset=offset)


def dealt(cut: DataFrame, group: int = GROUP) -> DataFrame:
    """Pieces, with the ``row`` they were written under, in groups of about ``group`` by a hash of all that tells them apart.

    The row's number is part of it, so rows that share a doc_id or have none are spread like others.
    """
    groups = max(1, round(cut.count() / group))
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "row", F.lit(5))
    return cut.withColumn("packing_group", F.pmod(key, F.lit(groups))).drop("row")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all rows with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Rows with a null doc_id, and rows that share one, are packed like others. Without rows there are no pieces.
    Only doc_id and text are read, so other columns may have any name.
    """
    cut = pieces(docs, tokenizer, capacity=capacity)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    numbered = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return dealt(numbered).groupBy("packing_group").applyInPandas(
        lambda frame: pack_group(frame, capacity), f"{schema}, sequence_id long, offset long")
