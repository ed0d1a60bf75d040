"""Clusters against a search of all centroids."""

import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetloom.llm import centroids, queries


def nearest(v, cents):
    d = [sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in cents]
    return min(range(len(d)), key=lambda i: (d[i], i)), min(d)


def expected(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for _ in range(rounds):
        own = [nearest(v, cents)[0] for _, v in kept]
        cents = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own) if o == i])] if i in own else c for i, c in enumerate(cents)]
    found = [(i, *nearest(v, cents)) for i, v in kept]
    total = lambda c: sum(d for _, o, d in found if c in (None, o))
    return sorted(((i, c, d, total(c), total(None), sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def run(spark, rows, path):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("v", "x", "h", "cluster", "label")})
    df.write.parquet(f"{path}/embeddings.parquet")
    found = queries.QUERIES["op12_mean_scan"](spark, str(path))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def awkward(n):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 64))
    rows = [(i, (middles[i % 6] + rng.normal(size=64) * 0.3).astype(np.float32).tolist()) for i in range(n)]
    rows += [(900 + i, [float(i % 3)] * 64) for i in range(9)]  # copies, equal means, ties
    rows += [(5, [0.5] * 64), (5, [0.25] * 64), (5, [0.25] * 64), (None, [-0.5] * 64), (None, None)]
    bad = [[1.0] * 63, [1.0] * 65, [], [None] + [1.0] * 63, [math.nan] + [1.0] * 63, [1.0] * 63 + [-math.inf]]
    return rows + [(2000 + i, v) for i, v in enumerate(bad)]


@pytest.mark.parametrize("n", [0, 5, 400])
def test_clusters_equal_a_full_search(spark, tmp_path, n):
    rows = awkward(n)
    assert run(spark, rows, tmp_path) == expected(rows)


def test_no_vector_that_counts(spark, tmp_path):
    assert run(spark, [], tmp_path / "none") == []
    assert run(spark, [(1, [1.0] * 3), (2, None)], tmp_path / "bad") == []


def test_search_rejects_most_and_misses_none():
    rng = np.random.default_rng(1)
    cents = rng.integers(-200, 200, (64, 32)) + rng.integers(-300, 300, (64, 1))
    v = cents[rng.integers(0, 64, 3000)] + rng.integers(-20, 20, (3000, 32))
    number, distance, computed = centroids.Codebook(cents).nearest(v)
    full = ((v[:, None] - cents[None]) ** 2).sum(2)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert computed < full.size / 4


def test_equal_centroids_give_the_smaller_number():
    cents = np.array([[3, 1], [1, 3], [3, 1], [2, 2]])
    number, distance, _ = centroids.Codebook(cents).nearest(np.array([[3, 1], [1, 3], [2, 1], [4, 4]]))
    assert number.tolist() == [0, 1, 0, 3] and distance.tolist() == [0, 0, 1, 8]


def test_values_out_of_range_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="would not fit"):
        run(spark, [(1, [1e9] * 64)], tmp_path)
