"""Quality rules, centroid clustering and phrase collocations against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm import centroids, collocations, mixing, near_duplicates, quality_rules
from tickweave.llm.common import row_key

SF = "/root/testdata/sf0.01"
_WORD = re.compile("[^\x20\x09-\x0D]+")


# quality rules

def plain_counts(text):
    text = text or ""
    found = _WORD.findall(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    repeated = {i + k for i, w in enumerate(zip(found, found[1:], found[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(found)
    return (n, sum(map(len, found)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeated),
            n < 50 or 100 * len(repeated) > 50 * n)


def best_path(emit, moves):
    """Viterbi by trying every path."""
    best = max(range(1 << len(emit)), key=lambda p: (sum(
        emit[t][p >> t & 1] + (moves[p >> (t - 1) & 1][p >> t & 1] if t else 0) for t in range(len(emit))), -p))
    return [best >> t & 1 for t in range(len(emit))]


def test_counts_and_verdicts_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    field = quality_rules.train(quality_rules.labelled_sample(docs, labels))
    rows = quality_rules.judged(docs, field).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(r.text)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(quality[r.doc_id], r.kept) for r in rows if r.doc_id in quality and not r.base_failed]
    good = [k for q, k in judged if q == 1]
    bad = [k for q, k in judged if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_held_out_quality(spark):
    """Trained on two thirds of the labels, judged on the rest."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    field = quality_rules.train(quality_rules.labelled_sample(docs, labels.where("doc_id % 3 <> 1")))
    rows = quality_rules.judged(docs.join(labels.where("doc_id % 3 = 1"), "doc_id"), field).where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.97


def test_line_labels_are_the_best_path():
    rng = np.random.default_rng(5)
    field = quality_rules.Field(rng.normal(size=(quality_rules.N_FEATURES * quality_rules.BUCKETS, 2)), rng.normal(size=(2, 2)) * 3)
    sizes = [3, 0, 7, 1, 6]
    features = rng.integers(0, quality_rules.BUCKETS, (quality_rules.N_FEATURES, sum(sizes))) + (
        np.arange(quality_rules.N_FEATURES)[:, None] * quality_rules.BUCKETS)
    first = np.concatenate(([0], np.cumsum(sizes)))
    label = quality_rules.decode(field, features, first)
    emit = field.scores(features)
    for s, e in zip(first[:-1], first[1:]):
        assert label[s:e].tolist() == best_path(emit[s:e].tolist(), field.moves.tolist())


def test_training_follows_the_likelihood():
    """The sum of the chances of all paths is one: expected counts equal those given at the optimum without decay."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (quality_rules.N_FEATURES, 40)) + np.arange(quality_rules.N_FEATURES)[:, None] * quality_rules.BUCKETS
    label = (x[0] > 1).astype(np.int64)
    field = quality_rules.fit(x, np.array([0, 10, 25, 40]), label)
    assert (quality_rules.decode(field, x, np.array([0, 10, 25, 40])) == label).all()


def test_quality_of_odd_rows(spark):
    long = "word " * 30_000 + "\n" + "\n".join(f"line number {k} of it" for k in range(30_000))
    rows = [(1, None, 1), (2, "", 1), (3, " \t\n\r\n", 2), (None, "a b c", 3), (5, "x" * 200_000, 4), (5, "x" * 200_000, 4),
            (6, "a b c a b c", 5), (7, "a\na\r\na\n a\n\na", 6), (8, long, 7), (9, "é ü ß\né ü ß\nÉ", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = quality_rules.judged(docs, None).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1]) and r.content_words == want[0]
    assert quality_rules.judged(docs.limit(0), None).count() == 0
    labels = spark.createDataFrame([(8, 1), (1, 0), (5, 0), (5, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    sample = quality_rules.labelled_sample(docs, labels)
    assert [(good, x.shape[1]) for good, x in sample] in ([(True, quality_rules.LINES)], [])
    assert quality_rules.train(sample) is None and quality_rules.train([]) is None
    assert quality_rules.labelled_sample(docs, labels.limit(0)) == []


def test_quality_sample_is_bounded_for_a_shared_id(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "DOCS", 20)
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}"), F.col("id").cast("string")) for k in range(60)])
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), text.alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert len(quality_rules.labelled_sample(docs, labels)) <= 40


# centroids

def plain_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) if abs(x) < 2 ** 53 else 64 * int(x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [list(v) for _, v in named[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for k, vs in own.items():
            at[k] = [sum(xs) // len(vs) for xs in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    each = Counter()
    for _, d, k in found:
        each[k] += d
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, k, fits(d), fits(each[k]), fits(sum(each.values())),
                    hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()) for i, d, k in found), key=str)


def test_clusters_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted(map(tuple, centroids.cluster(df).collect()), key=str)
    assert got == plain_clusters(df.select("vec_id", "embedding").collect())


def test_orchard_finds_the_nearest_with_few_distances():
    rng = np.random.default_rng(3)
    places = rng.integers(-500, 500, (40, 8))
    search = centroids.Orchard(places.tolist())
    points = places[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 8))
    apart = ((points[:, None] - places[None]) ** 2).sum(2)
    start = rng.integers(0, 40, 3000)
    best, distance = search.nearest(points, start)
    assert (best == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    assert search.visits < 0.5 * 40 * 3000
    ties = centroids.Orchard([[0, 0], [4, 0], [2, 0], [2, 0]])
    assert ties.nearest(np.array([[2, 0], [1, 0], [3, 0]]), np.array([3, 1, 0]))[0].tolist() == [2, 0, 1]


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    vector = lambda s=1.0: [float(x) for x in rng.normal(size=64) * s]
    same = vector()
    rows = [(k, vector(), "x") for k in range(30)] + [(5, same, "y"), (5, same, "y"), (None, vector(), None), (40, [0.0] * 64, "z"),
            (41, None, "z"), (42, [], "z"), (43, [1.0] * 63, "z"), (44, [1.0] * 63 + [None], "z"), (45, [float("nan")] * 64, "z"),
            (46, [float("inf")] + [0.0] * 63, "z"), (47, [1e30] * 64, "z"), (48, [-3e7] * 64, "z"), (49, [1e308] + [0.5] * 63, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    got = sorted(map(tuple, centroids.cluster(df).collect()), key=str)
    assert got == plain_clusters([r[:2] for r in rows])
    assert got == sorted(map(tuple, centroids.cluster(df.repartition(7)).collect()), key=str)
    few = df.where("vec_id in (1, 2)")
    assert sorted(r.cluster for r in centroids.cluster(few).collect()) == [0, 1]
    for nothing in (df.limit(0), df.where("vec_id = 41"), df.where("vec_id is null")):
        assert centroids.cluster(nothing).collect() == []
        assert centroids.cluster(nothing).columns == centroids.cluster(few).columns


# phrases

def plain_phrases(rows, least=10, longest=3, top=2000, covered=50):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            found = re.findall("[^ \t]+", piece)
            n[lang] += len(found)
            for k in range(1, longest + 1):
                for i in range(len(found) - k + 1):
                    f[lang][tuple(found[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = {p[i:i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                 if 100 * a >= covered * candidates[p[i:i + k]]}
        ranked = []
        for p, a in candidates.items():
            if p not in inner:
                s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def test_phrases_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, collocations.collocations(docs).collect()))
    assert got == plain_phrases(docs.select("text", "lang").collect())


@pytest.mark.parametrize("sample", [1, 1000])
def test_any_sample_gives_the_same_counts(spark, monkeypatch, sample):
    """A sample without rows proposes nothing; the border then fails once for each length but the last."""
    monkeypatch.setattr(collocations, "HELD", 50)
    rng = np.random.default_rng(8)
    rows = [(k, " ".join("abcdefgh"[int(x)] for x in rng.integers(0, 8, 40)), "x") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(F.pmod(F.xxhash64("text", "lang"), F.lit(1000)) != 0)
    found, passes = collocations.frequent(docs, 4, 4, sample)
    want = defaultdict(int)
    for _, text, lang in docs.collect():
        w = text.split()
        want[""] += len(w)
        for k in range(1, 5):
            for i in range(len(w) - k + 1):
                want[" ".join(w[i:i + k])] += 1
    assert {r.phrase: r.n for r in found.collect()} == {p: n for p, n in want.items() if n >= 4}
    assert passes == (4 if sample == 1000 else 1) or sample == 1 and passes <= 4


def test_phrases_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 1 << 12)         # long texts are cut between pieces
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, " \t.,;\n", None, 1), (4, "New York New York " * 400, "en", 2),
            (5, "new york. new york; " * 600, "en", 2), (5, "new york. new york; " * 600, "en", 2), (6, "é ü\té ü\r" * 12, None, 3),
            (7, "é ü " * 11, "und", 3), (8, "x" * 20_000 + " y", "zz", 3), (9, "a a a a a a a a a a a a", "", 4),
            (None, "new york " * 3, "en", 5), (10, "only once here", "fr", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase long")
    want = plain_phrases([(r[1], r[2]) for r in rows])
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == want and want
    assert sorted(map(tuple, collocations.collocations(docs.repartition(5), top=1).collect())) == plain_phrases(
        [(r[1], r[2]) for r in rows], top=1)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.where("doc_id in (1, 2, 3)")).collect() == []


# rows that share an id, and columns of any type

def test_ranges_of_shared_ids_stay_even(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 500)
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 100)
    docs = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same words")).otherwise(F.concat(F.lit("w "), F.col("id").cast("string"))).alias("text"),
        F.lit("s").alias("source"))
    draws = mixing._draws(mixing._classes(docs)).collect()
    assert len(draws) == 6000
    largest = Counter(int(r["u"] * 12) for r in draws).most_common(1)[0][1]
    assert largest < 700
    again = mixing._draws(mixing._classes(docs.repartition(9))).collect()
    assert sorted(r["u"] for r in draws) == sorted(r["u"] for r in again)


def test_rows_with_columns_of_any_type(spark):
    docs = spark.createDataFrame(
        [(1, "one two three", "s", {"a": 1}), (1, "one two three", "s", {"a": 1}), (2, "one two three", "s", None)],
        "doc_id long, text string, source string, extra map<string,int>")
    assert docs.select(*row_key(docs)).distinct().count() == 2
    assert [r.doc_id for r in near_duplicates.without_duplicates(docs).collect()] == [1]
    assert mixing.mixed_rows(docs).count() == 3
