"""Multi-index search against brute force."""

import heapq
import math

import numpy as np
import pytest

from feedtide.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, score int, cell string"


def brute(rows, every=20, nearest=20):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and all(math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in dict(good).items():
        if q % every == 0:
            out[q] = [i for _, i in sorted((-float((v * w).sum()), i) for i, w in good if i != q)[:nearest]]
    return out


def found(vectors, **options):
    rows = neighbours.search(vectors, **options).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append(r.vec_id)
    return out


def awkward():
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=7).astype(np.float32).tolist()) for k in range(120)]
    rows += [(k, [0.5] * 7) for k in range(200, 280)]  # a hot vector, and ties
    rows += [(300, None), (320, []), (340, [0.0] * 7), (360, [1.0, None] + [1.0] * 5), (380, [math.nan] + [1.0] * 6), (400, [math.inf] + [1.0] * 6), (None, [1.0] * 7), (420, [-0.0, 1.0] + [0.0] * 5)]
    return rows


def test_exact_when_all_cells_are_visited(spark, monkeypatch):
    rows = awkward()
    vectors = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    expected = brute(rows)
    assert found(vectors, visit=1.0) == expected
    monkeypatch.setattr(neighbours, "CHUNK", 30)
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    assert found(vectors, visit=1.0, centroids=4) == expected


def test_recall_of_the_registered_setting(spark):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(1500, 32)).astype(np.float32)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(matrix)]
    expected, got = brute(rows), found(spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA))
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(expected)
    assert np.mean([len(set(got[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9


def test_few_candidates_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "c"), (1, [0.5, 0.5], 1, "c"), (40, [1.0, 1.0], 1, "c")], SCHEMA)
    assert found(few) == {0: [40, 1], 40: [0, 1]}
    assert neighbours.search(few.limit(0)).count() == 0
    one = spark.createDataFrame([(20, [2.0], 1, "c")], SCHEMA)
    assert neighbours.search(one).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_cells_come_in_the_order_of_summed_distance(seed):
    rng = np.random.default_rng(seed)
    a, b, counts = rng.normal(size=6), rng.normal(size=5), rng.integers(0, 4, 30)
    wanted = int(counts.sum() * 0.6)
    cells = neighbours.visited_cells(a, b, counts, wanted)
    sums = (a[:, None] + b[None, :]).ravel()
    assert len(set(cells)) == len(cells) and [sums[c] for c in cells] == heapq.nsmallest(len(cells), sums.tolist())
    assert counts[cells].sum() >= wanted > counts[cells[:-1]].sum()
