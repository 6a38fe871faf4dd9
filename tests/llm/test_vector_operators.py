"""Nearest neighbours and similar vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm import cover_tree, nearest, queries

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [
    (0, [1.0, 2.0, 2.0], 1), (100, [1.0, 2.0, 2.0], 1), (200, [2.0, 4.0, 4.0], 1), (3, None, 1), (4, [], 1),
    (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 2.0], 1), (7, [float("nan"), 1.0, 1.0], 1), (8, [float("inf"), 1.0, 1.0], 2),
    (None, [1.0, 2.0, 2.0], 1), (9, [1.0, 2.0, 2.0], None), (10, [1.0, 2.0], 1), (300, [1.0, 2.1, 2.0], 1),
    (300, [1.0, 2.1, 2.0], 1), (11, [-1.0, -2.0, -2.0], 1), (12, [3.0, 0.0, 0.0], 2), (13, [0.0, -0.0, 1.0], 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, VECTORS).withColumn("side", F.lit("x")).withColumn("dim", F.lit("x"))


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def nearest_by_hand(rows, k=10):
    known = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and good(v)})
    out = {}
    for q, v in known:
        if q % 100 == 0:
            v32 = np.float32(v).astype(float)
            d = sorted((float(np.sqrt(((np.float32(w).astype(float) - v32) ** 2).sum())), i)
                       for i, w in known if i != q and len(w) == len(v))
            out[q] = d[:k]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding", "label").collect()]
    want = nearest_by_hand(rows)
    got = results(queries.op3_nearest_neighbours(spark, "/root/testdata/sf0.1"))
    assert set(got) == set(want) and all(len(v) == 10 and v == sorted(v) for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.95
    exact = {q: dict((i, d) for d, i in nearest_by_hand([r for r in rows], 5000)[q]) for q in list(want)[:3]}
    assert all(d == pytest.approx(exact[q][i], abs=1e-12) for q in exact for d, i in got[q])


def test_neighbours_of_odd_rows(spark, odd):
    got = results(nearest.nearest_neighbours(odd, F.col("vec_id") % 100 == 0))
    want = nearest_by_hand(ODD)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert nearest.nearest_neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def test_many_equal_vectors_and_shards(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 60)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 1.0, 0.5], 1) for i in range(400)] + [
        (400 + i, [float(x) for x in rng.normal(size=3)], 1) for i in range(300)]
    got = results(nearest.nearest_neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0))
    assert {q: [i for _, i in v] for q, v in got.items()} == {
        q: [i for _, i in v] for q, v in nearest_by_hand(rows).items()}


def similar_by_hand(rows, cosine=0.93):
    n = len(rows)
    links, low = [0] * n, list(range(n))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    ok = [i for i, (d, v, label) in enumerate(rows) if d is not None and label is not None and good(v)]
    vec = {i: np.float32(rows[i][1]).astype(float) for i in ok}
    for x, i in enumerate(ok):
        for j in ok[x + 1:]:
            if rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]):
                if vec[i] @ vec[j] / (np.linalg.norm(vec[i]) * np.linalg.norm(vec[j])) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    low[max(find(i), find(j))] = min(find(i), find(j))
    smallest = {}
    for i in ok:
        smallest[find(i)] = min(smallest.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], links[i], smallest[find(i)] if i in vec else r[0]) for i, r in enumerate(rows)), key=str)


def test_similar_vectors_equal_brute_force(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding", "label").collect()]
    got = queries.op6_similar_vectors(spark, "/root/testdata/sf0.01").collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == similar_by_hand(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("block", [16, 2048])
def test_similar_vectors_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in centres[rng.integers(30)] + rng.normal(size=8) * 0.25], int(rng.integers(3))) for i in range(240)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(50)]
    got = cover_tree.similar_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got), key=str) == similar_by_hand(rows)


def test_similar_vectors_of_odd_rows(spark, odd):
    got = sorted(map(tuple, cover_tree.similar_vectors(odd).collect()), key=str)
    assert got == similar_by_hand(ODD)
    assert cover_tree.similar_vectors(spark.createDataFrame([], VECTORS)).count() == 0
