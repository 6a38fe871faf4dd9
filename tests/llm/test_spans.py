"""Personal data and repeated passages against plain Python."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_text_operators import DOCS, ODD, SF_DIR, clashing, table
from tickweave.llm import personal_data, queries, repeated_passages
from tickweave.llm.common import Powers, utf8, words

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TRICKY = [
    "a@b@c.com a@b.co@d.com x@y z.w@q-r.s-t.u @a.b a@.b", "1.2.3.4.5 256.1.1.1 1.2.3.04 0001.2.3.4 1.2.3 1.2.3.4000000000",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111111111111111 0", "é 4111111111111111 \U0001F600 +1 (017) 555-7713",
    "+1 234 +123456789 +1234567890123456 ++1-234-5678- +1().", "1" * 3000 + " " + "1." * 500, "a" * 3000 + "@" + "b." * 100 + "@c.d",
    "token = \"4bb0c75cc3b0398440b6ca30dd75e60ee4a65a87\" tel: 555 123 4567 or 123-45-6789",
]


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                twice = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
                if not 16 <= len(digits) <= 19 or (sum(digits[-1::-2]) + sum(twice)) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("text", TRICKY)
def test_patterns(text):
    assert personal_data.pattern_spans(text) == plain_spans(text)


def test_personal_data_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark).collect()}
    for r in queries.op2_personal_data(spark, SF_DIR).collect():
        want = plain_spans(texts[r["doc_id"]])
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(x[0] == k for x in want) for k in personal_data.KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans[:len(want)] == [f"{k}:{s}:{e}" for k, s, e in want] and len(spans) == len(want) + r["n_more"]


def test_field_finds_what_patterns_miss(spark):
    docs = spark.createDataFrame([(0, TRICKY[-1]), (1, "plain words, in a line. And some more of them")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in personal_data.find(docs).collect()}
    found = {TRICKY[-1][int(s.split(":")[1]):int(s.split(":")[2])] for s in got[0]}
    assert "4bb0c75cc3b0398440b6ca30dd75e60ee4a65a87" in found and "123-45-6789" in found
    assert got[1] == []


def test_field_on_unseen_rows():
    field = personal_data.train(personal_data.labelled_table())
    rows = personal_data.labelled_table(seed=5)
    data, offsets = utf8(pa.array([" ".join(w for w, _ in r) for r in rows]))
    starts, stops, first = words(data, offsets)
    x = personal_data.features(data, starts, stops, first, field.known, Powers())
    tags = personal_data.decode(field, x, np.diff(first))
    want = np.array([personal_data.TAGS.index(t) for r in rows for _, t in r])
    assert (tags == want).mean() > 0.98


def test_viterbi_runs_through_long_texts():
    """One path over 200 words, also from word 64 to 65."""
    rng = np.random.default_rng(3)
    field = personal_data.Field(np.zeros((personal_data.GROUPS * personal_data.CELLS, 4)), 3 * rng.normal(size=(4, 4)), np.zeros(0, np.uint64))
    field.weights[:210] = rng.normal(size=(210, 4))
    got = personal_data.decode(field, np.arange(210)[None, :], np.array([3, 0, 200, 7]))
    for start, n in ((0, 3), (3, 200), (203, 7)):
        score, back = field.weights[start], []
        for t in range(start + 1, start + n):
            ways = score[:, None] + field.moves
            back.append(ways.argmax(0))
            score = ways.max(0) + field.weights[t]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[start:start + n].tolist() == path[::-1]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    field = personal_data.Field(np.zeros((personal_data.GROUPS * personal_data.CELLS, 4)), rng.normal(size=(4, 4)), np.zeros(0, np.uint64))
    x = np.arange(7)[None, :]
    field.weights[:7] = rng.normal(size=(7, 4))
    got = personal_data.decode(field, x, np.array([5, 0, 2]))
    import itertools

    def best(rows):
        return max(itertools.product(range(4), repeat=len(rows)), key=lambda p: sum(
            field.weights[r, t] for r, t in zip(rows, p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])))
    assert got.tolist() == [*best(range(5)), *best(range(5, 7))]


def test_personal_data_of_odd_rows(spark):
    odd = clashing(spark.createDataFrame(ODD, DOCS))
    got = personal_data.find(odd).collect()
    assert len(got) == len(ODD)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in got if r["doc_id"] in (3, 4, 5))
    assert personal_data.find(spark.createDataFrame([], DOCS)).count() == 0


# repeated passages

def repeats_by_hand(rows, length=repeated_passages.LENGTH):
    raw = [(d, (t or "").encode()) for d, t in rows]
    lowest = {}
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i:i + length]
                lowest[w] = min(lowest.get(w, d), d)
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if lowest[b[i:i + length]] < d:
                    gone[i:i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def in_order(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r))


def test_repeats_equal_brute_force(spark):
    rows = [tuple(r) for r in table(spark).select("doc_id", "text").where("doc_id < 500").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert in_order(repeated_passages.remove_repeats(docs)) == repeats_by_hand(rows)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz "])
def test_repeats_of_small_alphabets(spark, monkeypatch, letters):
    monkeypatch.setattr(repeated_passages, "BLOCK", 3000)
    monkeypatch.setattr(repeated_passages, "BUCKET", 20_000)
    monkeypatch.setattr(repeated_passages, "BATCH", 1500)
    rng = np.random.default_rng(8)
    parts = ["".join(rng.choice(list(letters), int(rng.integers(30, 120)))) for _ in range(40)]
    rows = [(int(rng.integers(0, 90)), "".join(parts[k] for k in rng.integers(0, 40, int(rng.integers(1, 6))))) for _ in range(120)]
    rows += [(200 + i, "ab" * 100) for i in range(5)] + [(300, "é" * 80), (301, "é" * 90), (None, parts[0] * 2), (302, parts[0][:49])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert in_order(repeated_passages.remove_repeats(docs)) == repeats_by_hand(rows)


def test_merge_orders_all_suffixes():
    rng = np.random.default_rng(9)
    for high in (3, 30, 256):
        length = rng.integers(50, 81, 300)
        text = rng.integers(0, high, int(length.sum())).astype(np.uint8)
        text[:80 * 60] = np.tile(text[:80], 60)
        string, place = repeated_passages.merged_order(text, length)
        start = np.cumsum(length) - length
        got = [text[start[s] + p:start[s] + min(p + 50, length[s])].tobytes() for s, p in zip(string, place)]
        assert got == sorted(got) and len(set(zip(string.tolist(), place.tolist()))) == int((length + 1).sum())


def test_repeats_of_odd_rows(spark):
    odd = clashing(spark.createDataFrame(ODD, DOCS))
    assert in_order(repeated_passages.remove_repeats(odd)) == repeats_by_hand([r[:2] for r in ODD])
    assert repeated_passages.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    left = repeated_passages.remove_repeats(odd, with_text=True).where("doc_id = 1").first()
    assert left["kept"].decode() == ODD[0][1]
