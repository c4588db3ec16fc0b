import hashlib
import math

import numpy as np
import pytest

from frostline.llm import cross_polytope as cp
from frostline.llm import simplex_clusters as sc

SCHEMA = "vec_id long, embedding array<double>, key string, v int, cluster string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, x, "k", 1, "c") for i, x in rows], schema)


def odd_rows(pick, width, n):
    """Vectors with all that may be wrong with them, ties and repeated rows."""
    rows = [(i, pick.normal(size=width).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * width), (n + 3, [1.0, None] + [0.0] * (width - 2))]
    rows += [(n + 4, [float("nan")] * width), (n + 5, [float("inf")] + [1.0] * (width - 1))]
    rows += [(n + 10 + i, rows[3][1]) for i in range(60)]  # many copies of one vector
    rows += [rows[0], rows[0], (1, [5.0] + [0.25] * (width - 1)), (None, [1.0] * width), (n + 80, [-0.0, 2.0] + [0.5] * (width - 2))]
    return rows + [(n + 90, [2.0] * (width - 3)), (n + 91, [1e-3] * (width + 1))]


def brute_neighbours(rows, every, k):
    width = max((len(x) for _, x in rows if x), default=0)
    able = {
        (i, tuple([y + 0.0 for y in x]))
        for i, x in rows
        if i is not None and x and all(y is not None and math.isfinite(y) for y in x) and any(x)
    }
    full = [(i, x, list(x) + [0.0] * (width - len(x))) for i, x in able]
    found = []
    for q, own, qx in full:
        if q % every:
            continue
        near = []
        for i, x, y in full:
            if (i, x) != (q, own):
                score = 0.0
                for a, b in zip(qx, y):
                    score += a * b
                near.append((-score, i, x))
        found += [(q, r + 1, i, -s) for r, (s, i, _) in enumerate(sorted(near)[:k])]
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_with_all_probes_are_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(cp, "RECALL", 1.0)
    monkeypatch.setattr(cp, "BLOCK", 37)
    monkeypatch.setattr(cp, "HELD", 200 * seed)
    rows = odd_rows(np.random.default_rng(seed), 6, 150)
    found = cp.nearest_neighbours(table(spark, rows), every=5, k=7, tables=2, bucket_rows=10)
    assert sorted(map(tuple, found.collect())) == brute_neighbours(rows, 5, 7)


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [3.0, 0.0])]
    found = cp.nearest_neighbours(table(spark, rows))
    assert sorted(map(tuple, found.collect())) == brute_neighbours(rows, 20, 20)
    assert cp.nearest_neighbours(table(spark, rows[:1])).count() == 0
    assert cp.nearest_neighbours(table(spark, rows[2:])).count() == 0
    assert cp.nearest_neighbours(table(spark, [])).count() == 0


def test_queries_short_of_neighbours_probe_on(spark, monkeypatch):
    monkeypatch.setattr(cp, "probes_needed", lambda *_: 1)
    pick = np.random.default_rng(3)
    rows = [(i, pick.normal(size=8).tolist()) for i in range(300)]
    found = cp.nearest_neighbours(table(spark, rows), every=20, k=20, bucket_rows=4).collect()
    assert len(found) == 15 * 20
    exact = {(q, i): s for q, _, i, s in brute_neighbours(rows, 20, 299)}
    assert all(exact[r.query_id, r.vec_id] == r.score for r in found)


@pytest.mark.parametrize("seed", [6, 7])
def test_queries_go_to_two_cells_and_then_to_the_others(spark, seed, monkeypatch):
    for name, value in (("RECALL", 1.0), ("BLOCK", 3), ("HELD", 100), ("CELL", 500), ("AT_ONCE", 0)):
        monkeypatch.setattr(cp, name, value)
    rows = odd_rows(np.random.default_rng(seed), 6, 150)
    rows += [(300 + i, [1.0 + i / 1000] + [0.5] * 5) for i in range(40)]  # a bucket of several cells
    found = cp.nearest_neighbours(table(spark, rows), every=5, k=7, tables=2, bucket_rows=10)
    assert sorted(map(tuple, found.collect())) == brute_neighbours(rows, 5, 7)


def test_a_query_is_sent_to_cells_and_not_to_each_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(cp, "probes_needed", lambda *_: 512)
    x = np.random.default_rng(8).normal(size=(256, 4096))
    # a copy of the queries for each bucket would have 4 GB
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = cp.nearest_neighbours(table(spark, rows), every=1, k=3, bucket_rows=1).collect()
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1)[:, :3]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [
        (q, r + 1, int(i)) for q in range(256) for r, i in enumerate(near[q])
    ]


@pytest.mark.parametrize("even", [True, False])
def test_recall_against_brute_force(spark, even):
    pick = np.random.default_rng(4)
    x = pick.normal(size=(4000, 32)) + 2 * pick.normal(size=(40, 32))[pick.integers(0, 40, 4000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True) if even else 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype("f4").astype(float))]
    found = cp.nearest_neighbours(
        table(spark, rows, SCHEMA.replace("double", "float")), every=20, k=20, bucket_rows=100
    ).collect()
    x = x.astype("f4").astype(float)
    scores = x @ x.T
    hits = 0
    for q in range(0, 4000, 20):
        scores[q, q] = -np.inf
        hits += len(set(np.argsort(-scores[q])[:20]) & {r.vec_id for r in found if r.query_id == q})
    assert len(found) == 4000 and hits >= 0.9 * 4000


def test_hadamard_and_hashes_keep_angles():
    pick = np.random.default_rng(5)
    x = pick.normal(size=(50, 16))
    y = cp.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T)
    hashing = cp.CrossPolytope(16, 1.0, True, 8, 2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    tables, buckets = hashing.probes(unit, 2 * 256)
    hashes = hashing.hashes(unit)
    for t, b, h in zip(tables, buckets, hashes):
        probes = list(zip(t.tolist(), b.tolist()))
        assert len(set(probes)) == 512  # every bucket once
        places = sorted(probes.index((i, c)) for i, c in enumerate(h.tolist()))
        assert places[0] == 0  # a vector's own bucket comes first in its table


def brute_clusters(rows, k, rounds, width, scale, seed):
    kept = [
        (i, tuple(math.floor(scale * y) for y in x))
        for i, x in rows
        if x and len(x) == width and all(y is not None and math.isfinite(y) for y in x)
    ]
    name = lambda i: "g" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    assign = lambda: [min((far(x, c), n) for n, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        at = [n for _, n in assign()]
        for n in range(len(centroids)):
            own = [x for (_, x), m in zip(kept, at) if m == n]
            if own:
                centroids[n] = tuple(sum(v) // len(own) for v in zip(*own))
    last = assign()
    inertia = [sum(d for d, m in last if m == n) for n in range(len(centroids))]
    return sorted(
        ((i, n, d, inertia[n], sum(inertia), ",".join(map(str, centroids[n]))) for (i, _), (d, n) in zip(kept, last)), key=repr
    )


@pytest.mark.parametrize("pivots", [1, 4, 16])
@pytest.mark.parametrize("seed", [1, 7])
def test_clusters_against_brute_force(spark, seed, pivots):
    rows = odd_rows(np.random.default_rng(seed), 6, 120)
    found = sc.cluster(table(spark, rows), k=9, rounds=3, width=6, pivots=pivots)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_clusters(rows, 9, 3, 6, 256, 2)


def test_few_and_no_vectors_to_cluster(spark):
    rows = [(i, [float(i % 3), -0.3]) for i in range(7)]
    found = sc.cluster(table(spark, rows), k=40, width=2)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_clusters(rows, 40, 5, 2, 256, 2)
    assert sc.cluster(table(spark, rows), width=3).count() == 0
    with pytest.raises(Exception, match="too large"):
        sc.cluster(table(spark, [(1, [1e30, 0.0])]), width=2)


def test_bounds_leave_out_centroids_and_never_the_nearest():
    pick = np.random.default_rng(6)
    middle = pick.integers(-2000, 2000, (12, 8))
    x = middle[pick.integers(0, 12, 3000)] + pick.integers(-60, 60, (3000, 8))
    simplex = sc.Simplex(np.concatenate([middle[:1], middle]), 6)  # a pivot given twice is one
    assert len(simplex.pivots) == 6
    number, distance, compared = sc.nearest(x, simplex.apexes(x), middle, simplex)
    all_pairs = sc.squared(x, middle)
    assert (number == all_pairs.argmin(1)).all() and (distance == all_pairs.min(1)).all()
    assert compared < 0.3 * all_pairs.size
