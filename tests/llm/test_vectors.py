"""Clustering and hard negatives against plain versions over all pairs."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascope.llm import gnat, negatives, shallot, vectors

VECTOR_ROWS = "vec_id long, embedding array<double>, label int"


def table_of(spark, rows):
    """A table with columns named like those the operators use."""
    df = spark.createDataFrame(rows, VECTOR_ROWS)
    for name in ("v", "near", "other", "part", "id", "leaf", "key", "ids", "score", "cluster", "x.y"):
        df = df.withColumn(name, F.lit("x"))
    return df


def odd_vectors(n=120, dim=64, seed=3):
    """Clustered vectors on a coarse grid, so with ties, with copies, NULL and repeated ids and unfit rows."""
    rng = random.Random(seed)
    heads = [[rng.choice((-1.0, 0.0, 1.0)) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [x + rng.choice((0.0, 0.0, 0.25, -0.25)) for x in rng.choice(heads)]
        rows.append((i, v, rng.randrange(3)))
    rows += [(200 + i, list(heads[0]), 1) for i in range(40)] + [rows[5], rows[5], (None, list(heads[1]), 2), (None, list(heads[1]), 2)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0] * (dim - 1), 1), (303, [None] + [1.0] * (dim - 1), 1),
             (304, [math.nan] * dim, 1), (305, [math.inf] * dim, 1)]
    return rows


# 11 Shallot search

def plain_kmeans(rows, k, rounds, dim=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    out = []
    for step in range(rounds + 1):
        out = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
        if step < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, out) if c == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own)]
    sums = {j: sum(d for d, c in out if c == j) for j in range(len(centres))}
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, out)), key=repr)


@pytest.mark.parametrize("k,rounds", [(7, 5), (1, 2), (500, 1)])
def test_clusters_equal_plain_kmeans(spark, k, rounds):
    rows = odd_vectors()
    got = shallot.cluster(table_of(spark, rows).repartition(3), k=k, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_kmeans(rows, k, rounds)


def test_no_vectors_no_clusters(spark):
    assert shallot.cluster(table_of(spark, [])).collect() == []
    assert shallot.cluster(table_of(spark, [(1, None, 1), (2, [1.0], 0)])).collect() == []


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="component"):
        shallot.cluster(table_of(spark, [(1, [1e9] * 64, 0)])).collect()


def test_bounds_leave_the_nearest_centroid_unchanged():
    """Reassigning by bounds over several moves equals comparing all."""
    rng = np.random.default_rng(5)
    v = rng.integers(-200, 200, (400, 64)) + rng.choice([-900, 0, 900], (400, 1))
    at = v[:12].astype(np.int64)
    near, other = np.zeros(400, np.int32), np.ones(400, np.int32)
    upper, lower, moved = np.full(400, np.inf), np.zeros(400), np.zeros(12)
    for _ in range(6):
        near, other, upper, lower = shallot.reassign(v, near, other, upper, lower, shallot.Net.of(at), moved)
        d = np.stack([shallot.squared(v, c) for c in at], 1)
        assert (near == d.argmin(1)).all() and (near != other).all()
        new = at + rng.integers(-30, 30, at.shape)
        moved, at = np.sqrt(((new - at) ** 2).sum(1).astype(float)), new


# 13 hard negatives

def plain_negatives(rows, n_pos, n_neg, least=50, most=95):
    kept = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(256 * x) for x in r[1]] for r in kept]
    last = lambda i: (i is None, i)
    out = []
    for a, (i, _, label) in enumerate(kept):
        if i is None or i % 10:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(ints[a], ints[b])), last(kept[b][0]), kept[b][2]) for b in range(len(kept)) if b != a))
        for score, p, _ in [s for s in scored if s[2] == label][:n_pos]:
            window = [s for s in scored if s[2] != label and -least * score <= -100 * s[0] <= -most * score][:n_neg]
            out += [(i, p[1], rank + 1, q[1], -score, -s) for rank, (s, q, _) in enumerate(window)]
    return sorted(out, key=repr)


def mined(spark, rows, **args):
    df = table_of(spark, rows)
    fit = df.filter(vectors.all_finite(F.col("embedding"))).withColumn("vector", vectors.scaled(F.col("embedding")))
    return negatives.mine(fit.repartition(3), F.col("vec_id") % 10 == 0, **args)


@pytest.mark.parametrize("seed,args", [(3, {}), (4, {"n_positives": 2, "n_negatives": 4}), (5, {"least": 20, "most": 100})])
def test_negatives_equal_all_pairs(spark, monkeypatch, seed, args):
    """With small leaves and blocks, so that the tree has several levels."""
    monkeypatch.setattr(negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(negatives, "FANOUT", 3)
    monkeypatch.setattr(negatives, "QUERY_ROWS", 5)
    rows = odd_vectors(seed=seed)
    got = mined(spark, rows, **args)
    want = plain_negatives(rows, args.get("n_positives", 5), args.get("n_negatives", 3), args.get("least", 50), args.get("most", 95))
    assert want and sorted(map(tuple, got.collect()), key=repr) == want


def test_large_numbers_and_labels_alone(spark):
    assert mined(spark, []).collect() == []
    assert mined(spark, [(i, [1.0, 2.0], 1) for i in range(30)]).collect() == []
    rows = [(i, [7.0e4 * (1 + i % 7), 1.0e5, 3.0e5 - i], i % 2) for i in range(40)]
    assert sorted(map(tuple, mined(spark, rows).collect()), key=repr) == plain_negatives(rows, 5, 3)


def test_tree_reaches_every_row_of_an_annulus():
    rng = np.random.default_rng(7)
    heads = rng.integers(-300, 300, (20, 16))
    rows = heads[rng.integers(0, 20, 3000)] + rng.integers(-40, 40, (3000, 16))
    top = int((rows * rows).sum(1).max())
    tree = gnat.Tree.grow(rows[:500], top, 4, 3)
    points = gnat.raised(rows, top)
    leaf = tree.leaf_of(points)
    spans = {}
    for node, i, j, low, high in [*tree.spans(points[:1500]), *tree.spans(points[1500:])]:
        a, b = spans.get((node, i, j), (low, high))
        spans[node, i, j] = min(a, low), max(b, high)
    for key, span in spans.items():
        tree.note(*key, *span)
    queries = np.column_stack([rows[:40].astype(float), np.zeros(40)])
    d = gnat.apart(queries, points)
    inner, outer = np.quantile(d, 0.01, axis=1), np.quantile(d, 0.05, axis=1)
    reached = {(int(q), leaf_) for leaf_, who in tree.reached(queries, inner, outer, np.full(40, 1e-3)) for q in who}
    inside = {(q, int(leaf[r])) for q, r in zip(*np.nonzero((d >= inner[:, None]) & (d <= outer[:, None])))}
    assert inside <= reached and len(reached) < 0.7 * 40 * tree.leaves
