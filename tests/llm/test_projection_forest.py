import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgflow.llm import projection_forest as P


def plain(rows, is_query, k):
    """{query: [(id, score), ...]} by brute force; rows are distinct (id, vector)."""
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    wide = max((len(v) for _, v in rows), default=0)
    full = {i: [*v, *[0.0] * (wide - len(v))] for i, v in rows}

    def score(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    return {q: sorted(((score(full[q], v), i) for i, v in full.items() if i != q), key=lambda r: (-r[0], r[1]))[:k] for q in full if is_query(q)}


def got(spark, rows, k, schema="id long, vec array<double>, rank string", every=20):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(4)
    out = {}
    for r in P.nearest(df, "id", "vec", F.col("id") % every == 0, k).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.id)
    return {q: [hits[i] for i in range(1, len(hits) + 1)] for q, hits in out.items()}


def recall(found, true):
    return sum(len({i for _, i in found[q]} & {i for _, i in hits}) for q, hits in true.items()) / sum(map(len, true.values()))


@pytest.mark.parametrize("kind", ["without structure", "clusters", "lengths"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(3000, 24))
    if kind == "clusters":
        rows = rows * 0.1 + rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)]
    if kind == "lengths":
        rows *= rng.exponential(size=(3000, 1))
    rows = [(i, r.tolist()) for i, r in enumerate(rows)]
    found, true = got(spark, rows, 20), plain(rows, lambda q: q % 20 == 0, 20)
    assert found.keys() == true.keys() and recall(found, true) >= 0.9
    score = {q: dict((i, s) for s, i in plain(rows, lambda x: x == q, 3000)[q]) for q in (0, 500)}
    for q, scores in score.items():
        assert all(scores[i] == s for s, i in found[q]) and found[q] == sorted(found[q], key=lambda r: (-r[0], r[1]))


def test_copies_ties_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(0, 400, 2)] + [(i, [0.5, 1.0, 0.0]) for i in range(1, 60, 2)]
    rows += [(1000, None), (1020, []), (1040, [0.0, 0.0]), (1060, [1.0, None]), (1080, [nan, 1.0]), (1100, [inf]), (None, [1.0, 1.0]), (1120, [2.0])]
    true = plain(rows, lambda q: q % 20 == 0, 7)
    assert got(spark, rows + rows[:50], 7) == true and true[1120][0] == (2.0, 0)


def test_few_rows_and_none(spark):
    assert got(spark, [(0, [1.0])], 5) == {}
    assert got(spark, [(0, [1.0]), (1, [-2.0])], 5) == {0: [(-2.0, 1)]}
    assert got(spark, [(1, [1.0]), (2, [1.0])], 5) == {} and got(spark, [], 5) == {}


def test_other_types_of_id_and_number(spark):
    df = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(30)], "id string, vec array<float>")
    rows = P.nearest(df, "id", "vec", F.col("id") == "v3", 2).collect()
    assert [(r.query_id, r["rank"], r.id, r.score) for r in rows] == [("v3", 1, "v29", 88.0), ("v3", 2, "v28", 85.0)]


def test_the_given_vectors(spark):
    from msgflow.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    true, found = plain(rows, lambda q: q % 20 == 0, 20), {}
    for r in QUERIES["op12_projection_forest"](spark, sf_dir).collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert recall(found, true) >= 0.9 and all(len(hits) == 20 for hits in found.values())


def test_the_queue_opens_every_leaf_once_nearest_first():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 6))
    forest = P.Forest(float(np.sqrt((rows ** 2).sum(1)).max()), 6, [])
    forest = forest._replace(trees=[P.grown(forest.lifted(rows), 20, rng) for _ in range(2)])
    every = [(t, leaf) for t, tree in enumerate(forest.trees) for leaf in range(tree.leaves)]
    for path in forest.opened(rows[:5], 10 ** 6):
        assert sorted(path) == every
    leaves = forest.leaves_of(rows)
    assert all(np.bincount(leaves[:, t], minlength=tree.leaves).min() > 0 for t, tree in enumerate(forest.trees))
    assert P.grown(np.ones((50, 3)), 5, rng).leaves == 1
