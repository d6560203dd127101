"""Similar vectors against brute force."""

import numpy as np
import pytest

from threadloom.llm import neighbours
from threadloom.llm.neighbours import hash_buckets, plan_size, similar_vectors

SCHEMA = "feature_id long, producer_hash string, vec_values array<float>, bucket string"


def brute(rows, k=5, least=0.85):
    out, groups = set(), {}
    for i, p, v, _ in rows:
        if p is None or v is None or len(v) != 64 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        groups.setdefault(p, []).append((i, np.array(v, np.float32).astype(np.float64)))
    for own in groups.values():
        ids = np.array([i for i, _ in own])
        x = np.array([v / np.linalg.norm(v) for _, v in own])
        s = x @ x.T
        for r in range(len(ids)):
            near = [c for c in range(len(ids)) if c != r and s[r, c] >= least]
            near.sort(key=lambda c: (-round(s[r, c], 6), ids[c]))
            out |= {(min(ids[r], ids[c]), max(ids[r], ids[c])) for c in near[:k]}
    return out


def data(n=700, seed=0):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((40, 64))
    rows = []
    for i in range(n):
        v = centers[r.integers(40)] + r.standard_normal(64) * r.choice([0.02, 0.2, 0.35, 1.0])
        rows.append((i, r.choice(["p", "p", "q"]), [float(x) for x in (v * r.choice([0.3, 1, 20])).astype(np.float32)], "x"))
    rows += [(1000 + i, "p", rows[3][2], "x") for i in range(20)] + [(1100 + i, "p", rows[4][2], "x") for i in range(3)]
    bad = [None, [], [1.0] * 32, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63]
    rows += [(2000 + i, "p", v, None) for i, v in enumerate(bad)] + [(3000, None, [1.0] * 64, None)]
    return [(int(i), p if p is None else str(p), v, b) for i, p, v, b in rows]


@pytest.mark.parametrize("tile", [4096, 8])
def test_pairs_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    rows = data()
    got = [(x.a, x.b) for x in similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert len(set(got) & want) >= 0.98 * len(want)
    assert len(set(got) & want) >= 0.98 * len(got)
    copies = {(a, b) for a, b in want if a >= 1000 and b < 2000}
    assert copies <= set(got)


def test_empty_and_unusable(spark):
    df = spark.createDataFrame(data()[-8:], SCHEMA)
    assert similar_vectors(df).count() == 0
    assert similar_vectors(df.limit(0)).count() == 0


def test_probes_are_distinct_and_start_with_the_own_bucket():
    r = np.random.default_rng(1)
    x = r.standard_normal((50, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scope = np.zeros(50, np.int64)
    own = hash_buckets(x, scope, 0, 12, 0)[:, 0]
    many = hash_buckets(x, scope, 0, 12, 8)
    assert (many[:, 0] == own).all() and all(len(set(row)) == 9 for row in many)
    assert plan_size(0)[0] == 4 and plan_size(10**9)[1] > plan_size(10**5)[1] == 4
