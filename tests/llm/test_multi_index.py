import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgflow.llm import multi_index as M


def plain(rows, is_anchor, positives=5, negatives=5, part=80, whole=100):
    rows = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    rows = [r for r in rows if sum(x * x for x in r[2]) < 1 << 54]
    out = set()
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [(n, k) for n, k, other in scored if other != label and part * -s <= whole * -n <= whole * -s]
            out |= {(i, j, at, k, -s, -n) for at, (n, k) in enumerate(fits[:negatives], 1)}
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def got(spark, rows, schema="id long, label int, vec array<double>, block string", every=10, **limits):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(4)
    found = M.hard_negatives(df, "id", "label", "vec", F.col("id") % every == 0, **limits).collect()
    assert len(found) == len(set(found))
    return {tuple(r[c] for c in COLUMNS) for r in found}


@pytest.mark.parametrize("kind", ["without structure", "clusters"])
def test_random_vectors(spark, kind):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(1500, 10)) / 4
    if kind == "clusters":
        vecs = vecs * 0.3 + rng.normal(size=(12, 10))[rng.integers(0, 12, 1500)]
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(vecs)]
    true = plain(rows, lambda i: i % 50 == 0)
    assert got(spark, rows, every=50) == true and len(true) > 100


def test_copies_ties_and_unusable_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 2), [rng.choice([0.0, 0.25, 0.5]), rng.choice([0.25, -0.5])]) for i in range(150)]
    rows += [(i, i % 2, [0.5, 0.25]) for i in range(200, 400)] + [(500, 1, [0.0, 0.0]), (510, None, [1.0, 1.0]), (None, 1, [1.0, 1.0])]
    rows += [(520, 1, None), (530, 1, [1.0, None]), (540, 1, [float("nan"), 1.0]), (550, 1, [float("inf"), 1.0]), (560, 1, [1e300, 1.0])]
    assert got(spark, rows + rows[:40]) == plain(rows, lambda i: i % 10 == 0)
    # A vector is filled up with zeros.
    assert got(spark, rows + [(600, 0, [0.5]), (601, 0, [])]) == plain(rows + [(600, 0, [0.5, 0.0]), (601, 0, [0.0, 0.0])], lambda i: i % 10 == 0)


def test_large_numbers_and_other_limits(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, (v * 150_000).tolist()) for i, v in enumerate(rng.uniform(0.2, 1, size=(200, 3)))]
    assert got(spark, rows, positives=2, negatives=7, part=95) == plain(rows, lambda i: i % 10 == 0, 2, 7, 95)


def test_few_rows_and_none(spark):
    assert got(spark, []) == set() and got(spark, [(0, 1, [1.0])]) == set()
    assert got(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]) == {(0, 1, 1, 2, 65536, 256 * 230)}
    assert got(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == set()


def test_labels_and_ids_of_other_types(spark):
    rows = [(f"a{i}", "xy"[i % 2], [1.0 - i / 50, i / 50]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, label string, vec array<float>")
    found = {tuple(r) for r in M.hard_negatives(df, "id", "label", "vec", F.col("id") == "a7").select(*COLUMNS).collect()}
    single = [(i, label, np.array(v, np.float32).astype(float).tolist()) for i, label, v in rows]
    assert found == plain(single, lambda i: i == "a7") and found


def test_cells_come_by_falling_bounds_and_bounds_hold():
    rng = np.random.default_rng(8)
    rows = np.floor(rng.normal(size=(400, 8)) * 100)
    books = tuple(M.codebook(half, 6, rng) for half in (rows[:, :4], rows[:, 4:]))
    none = np.zeros(0, np.int32)
    codes, _ = M.Index(8, books, none, none, none, none).coded(rows)
    block = M.Block(np.arange(400), np.zeros(400), rows, codes, books)
    for anchor in rows[:20]:
        seen, last = 0, math.inf
        for bound, a, z in block.visited(anchor):
            assert bound <= last and (block.rows[a:z] @ anchor).max() <= bound
            seen, last = seen + z - a, bound
        assert seen == 400
