"""Centroid clustering against a statement of its rules in Python's integers."""

import hashlib
import random
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from litsieve.llm import clustering


def plain(rows, k, rounds, dims):
    kept = [(i, [floor(Fraction(x) * 64) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and abs(x) < inf for x in v)]
    mark = lambda r: hashlib.sha256(("1:" + ("" if r[0] is None else str(r[0]))).encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (mark(r), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((away(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    cost = {}
    for _, d, c in found:
        cost[c] = cost.get(c, 0) + d
    most = lambda x: min(x, 2**63 - 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, most(d), most(cost[c]), most(sum(cost.values())), sha[c]) for i, d, c in found), key=str)


def told(spark, rows, dims, k=3, rounds=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cluster", "distance", "vector", "label")})
    out = clustering.centroid_clusters(df.repartition(3), k, rounds, dims)
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_clusters_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) + 3 * (i % 4) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (None, [0.5, -0.25, 1.0, 0.0]), ((1 << 60) + 1, [-0.0, 0.0, 0.0, 0.0])]
    assert told(spark, rows, 4, k=5) == plain(rows, 5, 3, 4)


def test_odd_vectors_and_ties(spark):
    odd = [(1, None), (2, []), (3, [1.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0])]
    assert told(spark, odd, 2) == []
    assert told(spark, [], 2) == []
    same = [(i, [1.0, -1.0]) for i in range(9)]  # all centroids are alike: the first takes every vector, the others stay
    assert told(spark, odd + same, 2) == plain(odd + same, 3, 3, 2)
    assert {r[1] for r in told(spark, same, 2)} == {0}
    two = [(1, [0.0, 0.0]), (2, [5.0, 5.0])]  # fewer vectors than centroids
    assert told(spark, two, 2) == plain(two, 3, 3, 2)


def test_large_components_are_exact(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([1e300, -1e300, 3e9, 2.0**53 + 2, 0.3]) * rnd.random() for _ in range(3)]) for i in range(30)]
    assert told(spark, rows, 3, k=4) == plain(rows, 4, 3, 3)


def test_sums_come_in_parts():
    for value in (0, -1, 5, -(1 << 40), 3 << 90, -12345678901234567890):
        assert sum(part << (clustering.PART_BITS * place) for place, part in clustering.parts(value)) == value
    batch = clustering.integers(pd.Series([np.array([0.99, -0.001])]))
    assert batch.tolist() == [[63, -1]]
