"""Clusters against plain Lloyd rounds, and how many distances the bounds save."""

import hashlib

import numpy as np
import pytest

from fathom.llm import centroid_clusters as cc


def lloyd(rows, k, rounds, seed=3):
    """Each row's cluster and distance by comparing everything with everything."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = np.array([r[1] for r in order[:k]], dtype=object)
    x = np.array([r[1] for r in rows], dtype=object)
    assign = lambda: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = np.argmin(assign().astype(np.int64), axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = [s // int((own == j).sum()) for s in x[own == j].sum(axis=0)]
    far = assign().astype(np.int64)
    own = np.argmin(far, axis=1)
    return sorted((str(r[0]), int(o), int(d)) for r, o, d in zip(rows, own, far[np.arange(len(x)), own], strict=True)), c


def found(spark, rows, k, rounds, **kw):
    got, c, costs = cc.clustered(spark.createDataFrame(rows, "id long, v array<long>").repartition(3), k, rounds, **kw)
    return sorted((str(r.id), r.cluster, r.distance) for r in got.collect()), c, costs


@pytest.mark.parametrize(("k", "listed", "scale", "copies"), [(1, 3, 50, 0), (2, 3, 3, 0), (8, 3, 1000, 40), (12, 1, 4, 0), (20, 3, 200, 100)])
def test_against_lloyd(spark, k, listed, scale, copies):
    rng = np.random.default_rng(k)
    middles = rng.integers(-3 * scale, 3 * scale, (6, 5))
    x = middles[rng.integers(0, 6, 300)] + rng.integers(-scale, scale + 1, (300, 5))
    rows = [(i, [int(a) for a in v]) for i, v in enumerate(x)] + [(500 + i, rows_v) for i, rows_v in enumerate([[int(a) for a in x[0]]] * copies)]
    rows += [rows[1], (None, rows[2][1])]
    wanted, c = lloyd(rows, k, 6)
    got, centroids, _ = found(spark, rows, k, 6, listed=listed)
    assert got == wanted and (centroids == c.astype(np.int64)).all()


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(1)
    middles = rng.integers(-1000, 1000, (16, 8))
    x = middles[rng.integers(0, 16, 3000)] + rng.integers(-60, 61, (3000, 8))
    rows = [(i, [int(a) for a in v]) for i, v in enumerate(x)]
    wanted, _ = lloyd(rows, 16, 8)
    got, _, costs = found(spark, rows, 16, 8)
    assert got == wanted and costs[0] == 3000 * 16 and sum(costs[1:]) < 0.5 * 3000 * 16 * len(costs[1:])


def test_step_by_step_states_bound_the_distances():
    """Whatever way centroids move, the bounds hold and the own centroid is the nearest."""
    rng = np.random.default_rng(7)
    x, c = rng.integers(-50, 50, (400, 3)), rng.integers(-50, 50, (9, 3))
    state = cc.scanned(x, c, 3)
    for size in (0, 1, 3, 40, 2, 1, 1):
        new = c + rng.integers(-size, size + 1, c.shape)
        steps = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)) * (1 + cc.SLACK) + cc.SLACK
        state, _ = cc.moved(x, state, new, steps)
        c = new
        far = np.sqrt(cc.squared(x, c).astype(float))
        assert (state["own"] == np.argmin(cc.squared(x, c), axis=1)).all()
        assert (state["upper"] >= far[np.arange(400), state["own"]]).all()
        assert (state["lower"] <= np.take_along_axis(far, state["near"].astype(int), 1)).all()
        rest = far.copy()
        np.put_along_axis(rest, np.column_stack([state["own"], state["near"]]).astype(int), np.inf, 1)
        assert (state["rest"] <= rest.min(axis=1)).all()


def test_few_large_and_no_vectors(spark):
    rows = [(1, [5, 5]), (2, [-7, 2])]
    got, c, _ = found(spark, rows, 8, 10)
    assert [r[2] for r in got] == [0, 0] and len(c) == 2
    assert found(spark, [], 8, 10)[0] == []
    with pytest.raises(Exception, match="2 components"):
        found(spark, [(1, [2**40, 1]), (2, [0, 0])], 2, 1)


def test_query_digests_and_sums(spark):
    rows = {r.vec_id: r for r in cc.query(spark, "/root/testdata/sf0.001").collect()}
    table = [(r.vec_id, [int(np.floor(1024 * float(a))) for a in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect() if r.embedding is not None and len(r.embedding) == 64 and all(a is not None and np.isfinite(a) for a in r.embedding)]
    wanted, c = lloyd(table, 8, 10)
    assert sorted((str(k), r.cluster, r.distance) for k, r in rows.items()) == wanted
    for r in rows.values():
        assert r.inertia == sum(d for _, _, d in wanted) and r.cluster_inertia == sum(d for _, o, d in wanted if o == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
