"""The search kernel over sparse vectors, without Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest

from msgflow.operators import retrieval as R


def arrow(rows):
    return pa.StructArray.from_arrays([pa.array([sorted(r) for r in rows], pa.list_(pa.int64())),
                                       pa.array([[r[i] for i in sorted(r)] for r in rows], pa.list_(pa.float64()))], ["indices", "values"])


def brute(asked, docs, k):
    found = []
    for a in asked:
        scores = sorted((-round(sum(x * b.get(i, 0.0) for i, x in a.items()), 6), d) for d, b in enumerate(docs))
        found += [(d, -s) for s, d in scores[:k]]
    return found


def searched(docs, asked, k, parts=None):
    index, search = R._kernel(True, k)
    _, _, doc, score, built = search(index(pa.array(range(len(docs)), pa.int64()), arrow(docs), parts), arrow(asked))
    return [(int(d), float(s) + 0.0) for d, s in zip(doc, score)], built


def test_documents_below_the_rarest_terms_best_are_not_looked_at():
    """A frequent term that could add much but seldom does: only documents that reach the k-th best are candidates."""
    docs = [{0: 0.9 if i == 77 else 0.1, 1 + i % 500: 0.9} for i in range(4000)]
    asked = [{0: 0.6, 1 + i: 0.3} for i in range(40)]
    got, built = searched(docs, asked, 3, np.arange(4000) // 10)
    assert got == brute(asked, docs, 3) and built.max() <= 10


@pytest.mark.parametrize("signed", [False, True])
@pytest.mark.parametrize("k", [1, 4, 90])
def test_kernel_equals_brute_force(signed, k):
    """Long and short lists, terms without documents, equal scores, queries without terms, more asked than there are."""
    rng = random.Random(k)
    weight = lambda: rng.choice([0.25, 0.5, 1.0, -0.5] if signed else [0.25, 0.5, 1.0])
    term = lambda: min(int(rng.paretovariate(0.5)), 400)
    docs = [{term(): weight() for _ in range(rng.randrange(9))} for _ in range(600 if k < 90 else 60)]
    asked = [{term(): weight() for _ in range(rng.randrange(12))} for _ in range(60)] + [{}, {9999: 1.0}, {1: 1e-7}]
    want = [(d, s + 0.0) for d, s in brute(asked, docs, k)]
    assert searched(docs, asked, k)[0] == want
