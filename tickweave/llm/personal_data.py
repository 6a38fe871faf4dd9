"""Personal data: fixed patterns, and what a conditional random field finds beside them.

The patterns give e-mail addresses, IP addresses, card and phone numbers. The field is a
linear chain over white-space words with the tags O, contact, ident and secret. It sees
word shapes (runs of upper case, lower case, digits and each punctuation mark) of a word
and its neighbours, lengths, digit counts, and the few words that occur in the labelled
table. It is trained on that table by gradient ascent on the exact likelihood and finds
what patterns can't list: numbers without a country code, addresses written with [at], numbers
of documents and keys. Decoding is Viterbi over thousands of texts at once.

A chain is a whole text; neighbouring words with one tag are one span. A span that overlaps a pattern's match is left out.
"""

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tickweave.llm.common import Powers, lower, range_hashes, text_blocks, utf8, words

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", "contact", "ident", "secret")
CELLS = 4096
GROUPS = 8          # feature groups, each with CELLS cells

# patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Found from their @, so that long runs of letters cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at)):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if text.count(".") > 2:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


# the labelled table

def labelled_table(seed: int = 11, rows: int = 360) -> list[list[tuple[str, str]]]:
    """Sentences as (word, tag) rows: templates whose slots are filled by a seeded generator."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    filler = "the of and was in that report line page with at for from on le la de und der est en y que".split()
    syllables = "an er in on re the st ou le ion tion ei ch sch ar os ad ie qu men al or ed ing".split()

    def word():
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
        return pick([w, w, w, w.capitalize(), w + ".", w + ",", w.capitalize() + ".", "|", w + "***", w + "&&&"])

    def plain(n):
        return [(pick(filler) if rng.random() < 0.4 else word(), "O") for _ in range(n)]

    name = lambda: "".join(pick(syllables) for _ in range(2))
    hexes = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(n))
    tag = lambda text, t: [(w, t) for w in text.split(" ")]
    slots = [
        lambda: tag(f"({number(3)}) {number(3)}-{number(4)}", "contact"),
        lambda: tag(f"{number(3)}-{number(3)}-{number(4)}", "contact"),
        lambda: tag(f"{number(3)}.{number(3)}.{number(4)}", "contact"),
        lambda: tag(f"+1 ({number(3)}) {number(3)}-{number(4)}", "contact"),
        lambda: [(pick(["tel", "tel:", "phone", "Phone:", "call"]), "O"), *tag(f"{number(3)} {number(3)} {number(4)}", "contact")],
        lambda: tag(f"{name()}[at]{name()}.{pick(['com', 'org'])}", "contact"),
        lambda: tag(f"{name()}.{number(2)}@{name()}.example.com", "contact"),
        lambda: tag(f"{number(3)}-{number(2)}-{number(4)}", "ident"),
        lambda: [(pick(["passport", "Passport", "id", "ID:"]), "O"), (pick("ABCDKLMX") + number(8), "ident")],
        lambda: [(pick(["IBAN", "iban", "IBAN:"]), "O"), *tag(f"DE{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}", "ident")],
        lambda: [("token", "O"), ("=", "O"), (f'"{hexes(40)}"', "secret")],
        lambda: [(pick(["key", "api_key", "password", "secret"]), "O"), (pick(["=", ":", "is"]), "O"), (pick([f'"{mixed(24)}"', mixed(20), hexes(32)]), "secret")],
        lambda: [(f"{number(3)}.{number(2)}.{number(3)}.{number(2)}", "O")],
        lambda: [(number(16), "O")],
        lambda: [(number(int(rng.integers(1, 7))) + pick(["", ".", ",", "%"]), "O")],
        lambda: [(f"{number(4)}-{number(2)}-{number(2)}", "O")],
        lambda: [(f"{number(2)}:{number(2)}", "O")],
        lambda: [("version", "O"), (f"{number(1)}.{number(1)}", "O")],
        lambda: [("token", "O"), ("of", "O")], lambda: [("key", "O"), (name(), "O")],
        lambda: [("call", "O"), ("the", "O")],
    ]
    out = []
    for k in range(rows):
        row = plain(int(rng.integers(2, 7)))
        if k % 6:
            row += slots[k % len(slots)]() + plain(int(rng.integers(1, 6)))
        out.append(row)
    return out


# features

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("a"):ord("z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[128:] = 2


def features(data: np.ndarray, starts, stops, first, known: np.ndarray, powers: Powers) -> np.ndarray:
    """(GROUPS, words) cells. ``first`` is the number of words before each text; ``known`` hashes stand for themselves."""
    n = len(starts)
    kind = _CLASS[data]
    changes = np.ones(len(data), bool)
    changes[1:] = kind[1:] != kind[:-1]
    changes[starts] = True
    run = np.concatenate(([0], np.cumsum(changes)))
    shape = range_hashes(kind[changes], run[starts], run[stops], powers)
    # a word's runs begin with its first byte, and the next text's or word's first byte begins a new one
    digits = np.concatenate(([0], np.cumsum(kind == 3)))
    n_digits = np.minimum(digits[stops] - digits[starts], 20)
    length = np.minimum(stops - starts, 40)
    name = range_hashes(lower(data), starts, stops, powers)
    at = np.searchsorted(known, name) if len(known) else np.zeros(n, np.int64)
    at = np.minimum(at, max(len(known) - 1, 0))
    word = np.where(known[at] == name, at + 1, 0) if len(known) else np.zeros(n, np.int64)
    cell = (shape % np.uint64(CELLS)).astype(np.int64)
    sized = ((shape * np.uint64(31) + (n_digits * 64 + length).astype(np.uint64)) % np.uint64(CELLS)).astype(np.int64)
    is_first, is_last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    is_first[first[:-1]] = True
    is_last[np.maximum(first[1:] - 1, 0)] = True
    before = lambda x: np.where(is_first[:n], CELLS - 1, np.roll(x, 1))
    after = lambda x: np.where(is_last[:n], CELLS - 1, np.roll(x, -1))
    own = [cell, sized, word, before(cell), after(cell), before(word), after(word), n_digits * 64 + length]
    return np.stack(own) + np.arange(GROUPS)[:, None] * CELLS


@dataclass
class Field:
    weights: np.ndarray     # (GROUPS * CELLS, tags)
    moves: np.ndarray       # (tags, tags)
    known: np.ndarray       # hashes of the labelled table's words, sorted


def _logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[list[tuple[str, str]]], steps: int = 120, rate: float = 0.15, decay: float = 0.002) -> Field:
    """Adam on the mean log-likelihood by forward-backward, all rows at once."""
    powers = Powers()
    column = pa.array([" ".join(w for w, _ in row) for row in table])
    data, offsets = utf8(column)
    starts, stops, first = words(data, offsets)
    names = range_hashes(lower(data), starts, stops, powers)
    seen, counts = np.unique(names, return_counts=True)
    known = seen[counts >= 3][:CELLS - 2]
    x = features(data, starts, stops, first, known, powers)
    y = np.array([TAGS.index(t) for row in table for _, t in row])
    n, k, longest = len(table), len(TAGS), max(map(len, table))
    length = np.array([len(r) for r in table])
    at = first[:-1][:, None] + np.minimum(np.arange(longest), length[:, None] - 1)
    inside = np.arange(longest) < length[:, None]
    weights, moves = np.zeros((GROUPS * CELLS, k)), np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        emit = weights[x].sum(0)[at]
        alpha, beta = np.empty((longest, n, k)), np.zeros((longest, n, k))
        alpha[0] = emit[:, 0]
        for t in range(1, longest):
            new = _logsum(alpha[t - 1][:, :, None] + moves, 1) + emit[:, t]
            alpha[t] = np.where(inside[:, t, None], new, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            new = _logsum(moves + (emit[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(inside[:, t + 1, None], new, beta[t + 1])
        total = _logsum(alpha[-1], 1)
        expected = np.exp(alpha + beta - total[None, :, None])
        gradient = -weights * decay
        delta = np.zeros((len(y), k))
        for t in range(longest):
            ok = inside[:, t]
            delta[at[ok, t]] -= expected[t][ok]
        delta[np.arange(len(y)), y] += 1
        for g in range(GROUPS):
            np.add.at(gradient, x[g], delta / n)
        pair = np.zeros((k, k))
        for t in range(1, longest):
            ok = inside[:, t]
            joint = alpha[t - 1][ok][:, :, None] + moves + (emit[ok, t] + beta[t][ok])[:, None, :] - total[ok][:, None, None]
            pair -= np.exp(joint).sum(0)
        same = np.ones(len(y), bool)
        same[first[:-1]] = False
        np.add.at(pair, (y[:-1][same[1:]], y[1:][same[1:]]), 1)
        for p, g, m, v in ((weights, gradient, 0, 1), (moves, pair / n - moves * decay, 2, 3)):
            state[m] = 0.9 * state[m] + 0.1 * g
            state[v] = 0.99 * state[v] + 0.01 * g * g
            p += rate * (state[m] / (1 - 0.9 ** step)) / (np.sqrt(state[v] / (1 - 0.99 ** step)) + 1e-8)
    return Field(weights, moves, known)


def decode(field: Field, x: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The best tag of each word, by Viterbi over all chains together."""
    emit = np.zeros((x.shape[1], len(TAGS)))
    for group in x:
        emit += field.weights[group]
    full = np.flatnonzero(n_words)
    order = full[np.argsort(-n_words[full], kind="stable")]
    begin, length = (np.cumsum(n_words) - n_words)[order], n_words[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")
    at = np.cumsum(active)
    back = np.empty((x.shape[1], len(TAGS)), np.int8)      # step by step, the texts that are as long
    score = emit[begin]
    for t in range(1, longest):
        k = int(active[t])
        ways = score[:k, :, None] + field.moves
        best = ways.argmax(1)
        score[:k] = np.take_along_axis(ways, best[:, None, :], 1)[:, 0] + emit[begin[:k] + t]
        back[at[t - 1]:at[t]] = best
    tags = np.zeros(x.shape[1], np.int8)
    now = score.argmax(1) if len(score) else np.zeros(0, np.int64)
    for t in range(longest - 1, -1, -1):
        k = int(active[t])
        tags[begin[:k] + t] = now[:k]
        if t:
            now[:k] = back[at[t - 1]:at[t]][np.arange(k), now[:k]]
    return tags


def tagged_spans(field: Field, data, offsets, powers: Powers):
    """(text number, tag, start byte, stop byte) arrays of runs of one tag, without punctuation at their ends."""
    starts, stops, first = words(data, offsets)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    tags = decode(field, features(data, starts, stops, first, field.known, powers), np.diff(first))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    new = np.ones(len(tags), bool)
    new[1:] = (tags[1:] != tags[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(tags)])) - 1
    some = tags[head] > 0
    return text[head[some]], tags[head[some]], starts[head[some]], stops[tail[some]]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_EDGE = "\"'.,;:|!?*&"


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (patterns), n_more (the field's spans), base_sha256 and spans.

    Offsets are code points, ends exclusive. A null text is empty. ``spans`` lists the
    patterns' matches by kind and start, then the field's by tag and start. Columns of these names are replaced,
    all others stay; repeated rows get equal results.
    """
    new = [*(f"n_{k}" for k in KINDS), "n_more"]
    own = docs.drop(*new, "base_sha256", "spans")
    schema = T.StructType([*own.schema.fields, *[T.StructField(c, T.LongType()) for c in new],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(field or train(labelled_table()))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        powers, field = Powers(), shared.value
        for block in text_blocks(batches, "text"):
            data, offsets = utf8(block.column("text"))
            n = block.num_rows
            marks = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57) | (data == 64))))
            marked = np.diff(marks[offsets]) > 0
            base = [[] for _ in range(n)]
            more = [[] for _ in range(n)]
            raw = data.tobytes()
            for i in np.flatnonzero(marked):
                base[i] = pattern_spans(raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace"))
            for i, tag, s, e in zip(*(x.tolist() for x in tagged_spans(field, data, offsets, powers))):
                while s < e and chr(raw[s]) in _EDGE:
                    s += 1
                while e > s and chr(raw[e - 1]) in _EDGE:
                    e -= 1
                if s < e:
                    ahead = len(raw[offsets[i]:s].decode("utf-8", "replace"))
                    span = (ahead, ahead + len(raw[s:e].decode("utf-8", "replace")))
                    if all(span[1] <= b or span[0] >= c for _, b, c in base[i]):
                        more[i].append((TAGS[tag], *span))
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS]
            names = [joined(b) for b in base]
            hashes = [hashlib.sha256(t.encode()).hexdigest() if t else nothing for t in names]
            spans = [joined(b + sorted(m, key=lambda x: (TAGS.index(x[0]), x[1]))) for b, m in zip(base, more)]
            yield pa.RecordBatch.from_arrays(
                [*block.columns, *counts, pa.array([len(m) for m in more], pa.int64()), pa.array(hashes, pa.string()),
                 pa.array(spans, pa.string())], names=[*block.schema.names, *new, "base_sha256", "spans"])

    return own.mapInArrow(run, schema)
