import random

import pytest
from pyspark.sql import functions as F

from msgflow.operators import retrieval as R

BLOCKS = {"broadcast_bytes": 0, "block_bytes": 400, "chunk_bytes": 500}


def brute(queries, docs, k):
    found = {}
    for q, a in queries.items():
        scores = [(-round(sum(x * b.get(i, 0.0) for i, x in a.items()), 6), d) for d, b in docs.items()]
        found[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return found


def vectors(rng, n, dim, zero_share=0.5):
    return {i: {j: rng.choice([0.25, 0.5, 1.0]) for j in range(dim) if rng.random() > zero_share} for i in range(n)}


def frame(spark, data, key, sparse, dim):
    if sparse:
        rows = [(i, (sorted(v), [v[j] for j in sorted(v)])) for i, v in data.items()]
        return spark.createDataFrame(rows, f"{key} long, embedding struct<indices:array<int>,values:array<double>>")
    return spark.createDataFrame([(i, [v.get(j, 0.0) for j in range(dim)]) for i, v in data.items()],
                                 f"{key} long, embedding array<float>")


@pytest.mark.parametrize("limits", [{}, BLOCKS], ids=["broadcast", "blocks"])
@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_k_equals_brute_force(spark, limits, sparse, k):
    rng = random.Random(k)
    docs = vectors(rng, 40, 6)
    queries = vectors(rng, 30, 8 if sparse else 6)  # unknown terms in sparse queries
    queries[0] = {}                                  # and a query without any term
    found = R.top_k(frame(spark, queries, "query_id", sparse, 6), frame(spark, docs, "doc_id", sparse, 6), k, **limits)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.similarity_score))
    want = brute(queries, docs, k)
    assert got == want
    assert all(len(v) == min(k, 40) for v in got.values())


@pytest.mark.parametrize("limits", [{}, BLOCKS], ids=["broadcast", "blocks"])
@pytest.mark.parametrize("sparse", [True, False])
def test_repeated_ids_and_missing_embeddings(spark, limits, sparse):
    rng = random.Random(4)
    docs, queries = vectors(rng, 12, 5), vectors(rng, 6, 5)
    q, d = frame(spark, queries, "query_id", sparse, 5), frame(spark, docs, "doc_id", sparse, 5)
    q = q.withColumn("query_id", F.lit(3).cast("long")).unionByName(q)
    gone = F.lit(None)
    q = q.unionByName(q.limit(1).withColumn("query_id", F.lit(99).cast("long")).withColumn("embedding", gone.cast(q.schema["embedding"].dataType)))
    d = d.unionByName(d.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("embedding", gone.cast(d.schema["embedding"].dataType)))
    got = sorted(tuple(r) for r in R.top_k(q, d, 2, **limits).collect())
    one = brute(queries, docs, 2)
    want = [(i, n + 1, *hit) for i, hits in one.items() for n, hit in enumerate(hits)]
    assert got == sorted(want + [(3, n, doc, score) for _, n, doc, score in want])


def test_embeddings_of_different_lengths_are_named(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (7, [1.0])], "doc_id long, embedding array<double>")
    with pytest.raises(ValueError, match="document 7 has 1 numbers, document 1 has 2"):
        R.top_k(d.withColumnRenamed("doc_id", "query_id"), d, 1)


def test_index_is_built_once(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    index = R.VectorIndex.of(d)
    for k in (1, 2):
        assert R.top_k(d.withColumnRenamed("doc_id", "query_id"), index, k).count() == 2 * k


def test_hot_term_and_long_queries(spark):
    """One term in every text: scores still come per block, not as pairs."""
    docs = {i: {0: 0.5, i % 50 + 1: 0.5} for i in range(3000)}
    queries = {i: {0: 1.0, i % 50 + 1: 1.0} for i in range(900)}
    q, d = frame(spark, queries, "query_id", True, 0), frame(spark, docs, "doc_id", True, 0)
    a = R.top_k(q, d, 2).collect()
    b = R.top_k(q, d, 2, broadcast_bytes=0, block_bytes=30_000, chunk_bytes=10_000).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 1800
    assert all(r.similarity_score == 1.0 and r.doc_id == r.query_id % 50 + 50 * (r["rank"] - 1) for r in a)


def test_cells_below_the_threshold_are_not_built(spark):
    """Texts of eight kinds that share no term: a query only goes to blocks of its own kind, and to all if it meets nothing."""
    from pyspark.sql import Observation

    rng = random.Random(8)
    docs = {i: {100 * (i % 8) + j: rng.choice([0.25, 0.5, 1.0]) for j in rng.sample(range(12), 5)} for i in range(400)}
    queries = {i: {100 * (i % 8) + j: 1.0 for j in range(12)} for i in range(64)} | {64: {}, 65: {5000: 1.0}}
    q, d = frame(spark, queries, "query_id", True, 0), frame(spark, docs, "doc_id", True, 0)
    seen = Observation("cells")
    got = {}
    for r in sorted(R.top_k(q, d, 3, **BLOCKS, cells=seen).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.similarity_score))
    assert got == brute(queries, docs, 3)
    assert seen.get["built"] < 0.5 * seen.get["all"]


@pytest.mark.parametrize("sparse", [True, False])
def test_negative_weights_in_blocks(spark, sparse):
    rng = random.Random(9)
    signed = lambda n: {i: {j: rng.choice([-1.0, -0.5, 0.5, 1.0]) for j in range(6) if rng.random() > 0.4} for i in range(n)}
    docs, queries = signed(60), signed(40)
    got = {}
    for r in sorted(R.top_k(frame(spark, queries, "query_id", sparse, 6), frame(spark, docs, "doc_id", sparse, 6), 7, **BLOCKS).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.similarity_score))
    assert got == brute(queries, docs, 7)


def test_documents_and_checks(spark):
    kb = spark.createDataFrame([(i, f"q{i}", f"r{i}", "in", "REFUND" if i < 2 else "ORDER") for i in range(4)],
                               "doc_id long, instruction string, response string, intent string, category string")
    hits = spark.createDataFrame([(7, 1, 2, 0.9), (7, 2, 0, 0.5), (8, 1, 1, 0.4), (8, 2, 3, 0.6)],
                                 "query_id long, rank int, doc_id long, similarity_score double")
    docs = {r.query_id: r.retrieved_documents for r in R.with_documents(hits, kb).collect()}
    assert [tuple(d) for d in docs[7]] == [(2, "q2", "r2", "in", "ORDER", 0.9), (0, "q0", "r0", "in", "REFUND", 0.5)]
    checked = R.retrieval_checks(hits.join(kb, "doc_id"), F.col("category") == "REFUND").orderBy("query_id").collect()
    assert [tuple(r) for r in checked] == [(7, 2, True, 0.5), (8, 2, False, 0.5)]
    one = R.retrieval_checks(hits.where("rank = 1").join(kb, "doc_id"), F.col("category") == "REFUND").orderBy("query_id").collect()
    assert [tuple(r) for r in one] == [(7, 1, True, 0.0), (8, 1, True, 1.0)]


def test_measured_size(spark):
    dense = frame(spark, {1: {0: 1.0}, 2: {}}, "doc_id", False, 4)
    sparse = frame(spark, {1: {0: 1.0, 3: 1.0}, 2: {}}, "doc_id", True, 4)
    assert R.vector_bytes(dense) == 2 * (4 * 8 + 8) and R.vector_bytes(sparse) == 2 * 16 + 2 * 8


@pytest.mark.parametrize("sparse", [True, False])
def test_a_query_is_shuffled_once_for_each_stripe(spark, sparse, monkeypatch):
    """Many blocks, few stripes, several shares of the queries: a row for each query and stripe, and the same hits."""
    from msgflow.operators import vector_blocks as B

    monkeypatch.setattr(B, "STRIPE_BYTES", 4000)
    monkeypatch.setattr(B, "ASKED_BYTES", 1000)
    rng = random.Random(11)
    docs = {i: {min(int(rng.paretovariate(0.7)), 60): rng.choice([0.25, 0.5, 1.0]) for _ in range(12)} for i in range(300)}
    queries = {i: {min(int(rng.paretovariate(0.7)), 60): rng.choice([0.25, 0.5, 1.0]) for _ in range(12)} for i in range(80)}
    q, d = frame(spark, queries, "query_id", sparse, 61), frame(spark, docs, "doc_id", sparse, 61)
    index = R.VectorIndex.of(d, 0, 400)
    stripes = -(-index.blocks.n_blocks // index.blocks.per_stripe)
    assert 1 < stripes < index.blocks.n_blocks / 4
    met = index.blocks._cells(q.withColumn("_row", F.col("query_id")).select("_row", "embedding"), 3, 500).where("doc_id is null")
    assert met.count() == 80 * stripes
    got = {}
    for r in sorted(R.top_k(q, index, 3).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.similarity_score))
    assert got == brute(queries, docs, 3)


def test_frequent_terms_are_left_to_the_documents_in_reach():
    """A query of one rare and many frequent terms: the kernel gives the brute-force hits and meets few blocks."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    docs = [{0: 0.1, 1: 0.1, 2: 0.1, 3 + i % 400: 0.9} for i in range(4000)]
    for d in docs[::7]:
        d.update({i: rng.choice([0.05, 0.1]) for i in range(3)})
    asked = [{0: 0.1, 1: 0.1, 2: 0.1, 3 + i: 0.9} for i in range(40)] + [{0: 1.0}, {}, {9999: 1.0}]

    def arrow(rows):
        return pa.StructArray.from_arrays([pa.array([sorted(r) for r in rows], pa.list_(pa.int64())),
                                           pa.array([[r[i] for i in sorted(r)] for r in rows], pa.list_(pa.float64()))], ["indices", "values"])

    index, search = R._kernel(True, 3)
    row, rank, doc, score, built = search(index(pa.array(range(4000), pa.int64()), arrow(docs), np.arange(4000) // 10), arrow(asked))
    want = brute(dict(enumerate(asked)), dict(enumerate(docs)), 3)
    assert [(int(d), float(s)) for d, s in zip(doc, score)] == [hit for i in range(len(asked)) for hit in want[i]]
    assert built[:40].max() <= 12 and list(rank[:3]) == [1, 2, 3]


def test_the_search_runs_once_before_documents_are_fetched(spark):
    """Hits are read twice, found once."""
    kb = spark.createDataFrame([(1, "q", "r", "in", "X")], "doc_id long, instruction string, response string, intent string, category string")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    hits = spark.createDataFrame([(i, 1, 1, 0.5) for i in range(20)], "query_id long, rank int, doc_id long, similarity_score double").mapInArrow(
        run, "query_id long, rank int, doc_id long, similarity_score double")
    assert R.with_documents(hits, kb).count() == 20 and seen.value == 20


@pytest.mark.parametrize("sparse", [True, False])
def test_copies_of_a_document_count_once_in_blocks(spark, sparse):
    rng = random.Random(13)
    docs, queries = vectors(rng, 40, 6), vectors(rng, 10, 6)
    q, d = frame(spark, queries, "query_id", sparse, 6), frame(spark, docs, "doc_id", sparse, 6)
    got = {}
    for r in sorted(R.top_k(q, d.unionByName(d.where("doc_id % 3 = 0")), 4, **BLOCKS).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.doc_id, r.similarity_score))
    assert got == brute(queries, docs, 4)
