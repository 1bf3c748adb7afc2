import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def nearest(rows, k):
    """Brute force, by the contract."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-float((x * y).sum()), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def search(spark, rows, k=20):
    got = {}
    for r in neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) / max(1, len(near)) for q, near in want.items()])


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 700)
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    r = np.random.default_rng(1)
    centres = r.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] * (i % 3) + r.standard_normal(16)).tolist()) for i in range(1500)]
    got, want = search(spark, rows), nearest(rows, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    truth = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(abs(s - (truth[q] * truth[i]).sum()) < 1e-9 for q, near in got.items() for i, s in near)


def test_few_vectors_are_verified():
    """Of 10,000 vectors without any structure, the threshold lets a twentieth through."""
    r = np.random.default_rng(5)
    vectors = r.standard_normal((10_000, 64))
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    shard = neighbours.Shard(np.arange(10_000), vectors, 1.0)
    asked = list(range(0, 10_000, 400))
    found = shard.answer(asked, [vectors[q] for q in asked], 20)
    assert shard.looked <= 0.05 * 10_000 * len(asked)
    hits = 0
    for q, near, _ in found:
        scores = vectors @ vectors[q]
        scores[q] = -2
        hits += len(set(near.tolist()) & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.95 * 20 * len(asked)


def test_queries_need_few_passes(monkeypatch):
    """Of 4,000 vectors without any structure, most queries are done with the first or the second window; so the work is a few counts of all vectors."""
    counted = []
    colliding = neighbours.Shard._colliding
    monkeypatch.setattr(neighbours.Shard, "_colliding", lambda self, low, span: counted.append(len(low)) or colliding(self, low, span))
    r = np.random.default_rng(6)
    vectors = r.standard_normal((4_000, 64))
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    shard = neighbours.Shard(np.arange(4_000), vectors, 1.0)
    asked = list(range(0, 4_000, 5))
    assert len(shard.answer(asked, [vectors[q] for q in asked], 20)) == 800
    assert sum(counted) <= 2 * len(asked) and len(counted) < len(asked) / 4


def test_equal_vectors_go_by_id(spark):
    one = [1.0] + [0.0] * 15
    rows = [(i, one) for i in range(100)] + [(200 + i, [0.0, 1.0] + [0.0] * 14) for i in range(30)]
    got = search(spark, rows)
    assert got[0] == [(i, 1.0) for i in range(1, 21)] and [i for i, _ in got[40]] == list(range(20))


def test_what_takes_no_part(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(16).tolist()) for i in range(60)]
    rows += [(100, None), (120, [0.0] * 16), (140, [float("nan")] * 16), (160, [1.0] * 15 + [None]), (180, [1.0] * 8), (200, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    got, want = search(spark, rows), nearest(rows, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0] + [0.0] * 15), (1, [0.5] * 16), (2, [-1.0] + [0.0] * 15)]
    assert [i for i, _ in search(spark, rows)[0]] == [1, 2]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(20, [1.0, 2.0])], [(3, [1.0, 2.0])]])
def test_no_candidates(spark, rows):
    assert search(spark, rows) == {}
