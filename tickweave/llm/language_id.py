"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text knows every string that occurs in
it. A text is cut greedily into the longest strings the automaton knows; a text in the
same language needs few phrases, one in another language many. ``phrases * log2(length of
the labelled text) / letters`` estimates the cross entropy (Ziv and Merhav, 1993), so
languages with less labelled text compete fairly. The language with the lowest value wins.

The automaton with "start a new phrase" on every missing arc is a complete table, so a
task parses thousands of stretches of text at once, one letter of each per step. A text
is parsed in stretches of ``STRETCH`` letters; a phrase never crosses two stretches.

Every letter of the labelled text has a code of its own. The ``DENSE`` most frequent ones
are columns of the table; arcs of all others are few, so they are kept as sorted pairs of
state and letter and looked up.
"""

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickweave.llm.common import code_points, text_blocks, utf8

STRETCH = 512
DOCS_PER_LANGUAGE = 400         # bound of the sample that is learned from
LETTERS_PER_LANGUAGE = 60_000   # and of its text after normalisation
LETTERS_PER_DOC, PARTS = 1_000, 4       # a longer row gives so many parts, spread from its start to its end
DENSE = 250                     # letters with a column in the table
ROWS_AT_A_TIME = 4096           # of the table, while it is made
UNFIT_RATE, UNFIT_LETTERS = 0.6, 20     # rejected: over 0.6 phrases a letter, from 20 letters on
UNDETERMINED = "und"


class Automaton:
    """The suffix automaton of a sequence, as rows of one flat array that is added to; state 0 is the start.

    Letters below ``width`` are columns (-1: no arc), arcs by others are in ``rare``. States
    count from 0 in each automaton, wherever in ``table`` its rows begin.
    """

    def __init__(self, table: array, width: int):
        self.table, self.width, self.begin = table, width, len(table)
        self.blank = array("i", [-1]) * width
        self.rare: dict[int, dict[int, int]] = {}
        self.states = 0

    def add(self, like: int = -1) -> int:
        """A new state, without arcs or with those of another one."""
        at = self.begin + like * self.width
        self.table.extend(self.blank if like < 0 else self.table[at:at + self.width])
        if like in self.rare:
            self.rare[self.states] = dict(self.rare[like])
        self.states += 1
        return self.states - 1

    def get(self, state: int, c: int) -> int:
        if c < self.width:
            return self.table[self.begin + state * self.width + c]
        return self.rare[state].get(c, -1) if state in self.rare else -1

    def put(self, state: int, c: int, to: int) -> None:
        if c < self.width:
            self.table[self.begin + state * self.width + c] = to
        else:
            self.rare.setdefault(state, {})[c] = to

    def read(self, text: list[int]) -> None:
        get, put, add = self.get, self.put, self.add
        last = add()
        link, length = array("i", [-1]), array("i", [0])
        for c in text:
            new = add()
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and get(p, c) < 0:
                put(p, c, new)
                p = link[p]
            if p >= 0:
                q = get(p, c)
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = add(q)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and get(p, c) == q:
                        put(p, c, twin)
                        p = link[p]
            last = new


@dataclass
class Model:
    """Parsing tables of all languages, one below the other."""

    languages: list[str]
    letters: str                # code 2 + i is letters[i]; 0 is a gap, 1 any letter that is not in the labelled text
    table: np.ndarray           # (target row * width) * 2 + whether a phrase begins
    roots: np.ndarray           # start of each language's table, in cells
    bits: np.ndarray            # log2 of the labelled length
    width: int                  # codes with a column: 0, 1 and the most frequent letters
    arcs: np.ndarray            # row * codes + code of each arc by another letter, ascending
    targets: np.ndarray         # what the table would hold for it
    starts: np.ndarray          # the same for a new phrase, by language and code - width


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def codes_of(letters: str) -> np.ndarray:
    """Code of every code point."""
    table = np.zeros(0x110000, np.uint8 if len(letters) + 2 <= 256 else np.uint32)
    known = {c: i + 2 for i, c in enumerate(letters)}
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            table[point] = known.get(_lower(c), 1)
    return table


def normalise(data, offsets, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with runs of non-letters as one gap and none at a text's start; offsets; whether a text has letters."""
    points, at = code_points(data, offsets)
    codes = table[points]
    before = np.empty(len(codes), codes.dtype)
    before[1:], before[:1] = codes[:-1], 0
    before[at[:-1][np.diff(at) > 0]] = 0
    keep = (codes > 0) | (before > 0)
    count = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], count[at], np.diff(count[at]) > 0


def train(sample: list[tuple[str, str]]) -> Model | None:
    """A model from (language, text) rows; languages in code point order. None without any letters."""
    texts: dict[str, list[str]] = {}
    for language, text in sample:
        texts.setdefault(language, []).append(text or "")
    seen: dict[str, int] = {}
    for text in (t for group in texts.values() for t in group):
        for c in text:
            if c.isalpha():
                seen[_lower(c)] = seen.get(_lower(c), 0) + 1
    ranked = sorted(seen, key=lambda c: (-seen[c], c))
    letters = "".join(sorted(ranked[:DENSE]) + ranked[DENSE:])
    if not letters:
        return None
    n_codes, width = len(letters) + 2, min(len(letters), DENSE) + 2
    known = {c: i + 2 for i, c in enumerate(letters)}
    names, roots, bits, sizes, base = [], [], [], [], 0
    raw = array("i")        # rows of all languages, so that no second copy is needed to join them
    sparse: dict[int, int] = {}
    starts = []
    for language in sorted(texts):
        codes = array("i")
        for text in texts[language]:
            own = [known[_lower(c)] if c.isalpha() else 0 for c in text]
            codes.extend([c for i, c in enumerate(own) if c or (i and own[i - 1])] + [0])
        codes = codes[:LETTERS_PER_LANGUAGE]
        if not any(codes):
            continue
        arcs = Automaton(raw, width)
        arcs.read(codes)
        other = np.full(n_codes - width, base, np.int64)
        for k, own in arcs.rare.items():
            for c, to in own.items():
                sparse[(base + k) * n_codes + c] = (base + to) * 2 * width + (k == 0)
        for c, to in arcs.rare.get(0, {}).items():
            other[c - width] = base + to
        starts.append(other * 2 * width + 1)
        names.append(language)
        roots.append(base * width)
        bits.append(np.log2(max(2, len(codes))))
        sizes.append(arcs.states)
        base += arcs.states
    if not names:
        return None
    table = np.frombuffer(raw, np.intc)
    if base * 2 * width >= 1 << 31:
        table = table.astype(np.int64)
    first = 0
    for size in sizes:      # states of one language become cells of the whole table, a stretch of rows at a time
        rows = table[first * width:(first + size) * width].reshape(size, width)
        start = (np.maximum(rows[0], 0).astype(table.dtype) + first) * 2 * width + 1
        for k in range(0, size, ROWS_AT_A_TIME):
            part = rows[k:k + ROWS_AT_A_TIME]
            part[:] = np.where(part < 0, start, (part + first) * 2 * width)
        rows[0] = start
        first += size
    keys = np.fromiter(sparse, np.int64, len(sparse))
    order = np.argsort(keys)
    return Model(names, letters, table, np.array(roots, table.dtype), np.array(bits), width, keys[order],
                 np.fromiter(sparse.values(), table.dtype, len(sparse))[order], np.stack(starts).astype(table.dtype))


def _by_rare_letters(model: Model, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where each language (rows) goes from its cell on letters without a column."""
    out = model.starts[:, codes - model.width]
    if len(model.arcs):
        key = (cell >> 1).astype(np.int64) // model.width * (len(model.letters) + 2) + codes
        at = np.minimum(np.searchsorted(model.arcs, key), len(model.arcs) - 1)
        out = np.where(model.arcs[at] == key, model.targets[at], out)
    return out


def phrases(model: Model, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) by each language (columns)."""
    lengths = np.diff(offsets)
    stretches = -(-lengths // STRETCH)
    first = np.concatenate(([0], np.cumsum(stretches)))
    n = int(first[-1])
    owner = np.repeat(np.arange(len(lengths)), stretches)
    size = np.minimum(STRETCH, lengths[owner] - (np.arange(n) - first[owner]) * STRETCH)
    grid = np.zeros(n * STRETCH, codes.dtype)
    grid[np.arange(len(codes)) + np.repeat(first[:-1] * STRETCH - offsets[:-1], lengths)] = codes
    order = np.argsort(-size, kind="stable")
    steps = np.ascontiguousarray(grid.reshape(n, STRETCH)[order].T)
    active = np.searchsorted(-size[order], -np.arange(STRETCH), "left")
    some_rare = len(codes) and int(codes.max()) >= model.width
    begun = np.zeros((len(model.languages), n), np.int32)
    cell = np.repeat(model.roots[:, None] * 2, n, 1)
    for t in range(STRETCH):
        k = int(active[t])
        if not k:
            break
        step = steps[t, :k]
        at = cell[:, :k] >> 1
        if some_rare:
            rare = np.flatnonzero(step >= model.width)
            at += np.where(step < model.width, step, 1).astype(at.dtype)
            at = model.table.take(at)
            if len(rare):
                at[:, rare] = _by_rare_letters(model, cell[:, rare], step[rare].astype(np.int64))
        else:
            at += step.astype(at.dtype, copy=False)
            at = model.table.take(at)
        begun[:, :k] += at & 1
        cell[:, :k] = at
    out = np.zeros((len(lengths), len(model.languages)), np.int64)
    np.add.at(out, owner[order], begun.T)
    return out


def judge(model: Model, codes, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winner, its lead (1 - its entropy / that of the next), and whether it fits at all."""
    letters = np.maximum(np.diff(offsets), 1)
    count = phrases(model, codes, offsets)
    entropy = count * model.bits / letters[:, None]
    best = entropy.argmin(1)
    rows = np.arange(len(best))
    lowest = entropy[rows, best]
    rest = entropy.copy()
    rest[rows, best] = np.inf
    second = rest.min(1) if len(model.languages) > 1 else np.full(len(best), np.inf)
    lead = np.where(np.isfinite(second) & (second > 0), 1 - lowest / np.where(second > 0, second, 1), 0.0)
    if len(model.languages) == 1:
        lead = np.ones(len(best))
    fits = (count[rows, best] <= UNFIT_RATE * letters) | (letters < UNFIT_LETTERS)
    return best, np.clip(lead, 0, 1), fits


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Up to DOCS_PER_LANGUAGE labelled rows of each language, chosen by a hash of the id.

    Rows are counted first, so that a fraction of each language's rows is enough; the
    driver gets about twice the bound at most. Of a row of over LETTERS_PER_DOC letters it
    gets PARTS parts with so many together, at even distances over the whole row.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * DOCS_PER_LANGUAGE / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    part, length = LETTERS_PER_DOC // PARTS, F.length("text")
    spread = F.concat_ws(" ", *[F.substring("text", F.floor((length - part) * k / (PARTS - 1)).cast("int") + 1, F.lit(part))
                                for k in range(PARTS)])
    rows = (known.where(draw < share[F.col("lang")])
            .select("lang", F.when(length > LETTERS_PER_DOC, spread).otherwise(F.col("text")).alias("text"),
                    draw.alias("draw"), "doc_id"))
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows.collect(), key=lambda r: (r["draw"], r["doc_id"], r["text"] or "")):
        if taken.get(r["lang"], 0) < DOCS_PER_LANGUAGE:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            out.append((r["lang"], r["text"] or ""))
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``fits``.

    The prediction sees the text only. ``und`` with score 0 and ``fits`` false if the text
    is null, empty or has no letter, or if there is no model. Equal entropies go to the
    language first in code point order. Columns of these names in ``docs`` are replaced;
    all others stay, repeated rows too.
    """
    own = docs.drop("lang_pred", "score", "fits")
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, codes_of(model.letters if model else "")))

    def run(batches):
        model, table = shared.value
        for block in text_blocks(batches, "text"):
            codes, offsets, has_letters = normalise(*utf8(block.column("text")), table)
            n = block.num_rows
            best, lead, fits = judge(model, codes, offsets) if model else (None, np.zeros(n), np.zeros(n, bool))
            ok = has_letters if model else np.zeros(n, bool)
            names = [model.languages[b] if o else UNDETERMINED for b, o in zip(best, ok)] if model else [UNDETERMINED] * n
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.array(names, pa.string()), pa.array(np.where(ok, lead, 0.0)), pa.array(fits & ok)],
                names=[*block.schema.names, "lang_pred", "score", "fits"])

    return own.mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """Documents whose text has a language: not ``und``, and not unlike every learned language."""
    found = identify(docs, train(labelled_sample(docs)))
    return found.where(F.col("fits")).select(*docs.columns)
