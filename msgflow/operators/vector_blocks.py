"""Exact search in a vector table of any size: blocks, dealt out in stripes, each met by every query once.

The vectors are grouped around pivots, a few of their own, and each group is cut into blocks of
bounded size.  Neighbouring blocks make up a stripe of at most STRIPE_BYTES, and a task takes one stripe
and one part of the queries, so a query is shuffled once for each stripe and not for each block.
Within the task bounds tell which vectors can be among the k best so far: blocks and
vectors that cannot are not scored, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from msgflow.staging import stage

PIVOTS = 64         # groups at most
PIVOT_TERMS = 4096  # numbers of a sparse vector that stand for it as a pivot
STRIPE_BYTES = 64 * 1024 * 1024  # vectors that a task holds, or one block if that is larger
ASKED_BYTES = 8 * 1024 * 1024    # queries that a task takes, at least


@dataclass
class Blocks:
    """A vector table in blocks, made once and searched many times."""

    vectors: DataFrame    # doc_id, embedding, _block
    n_blocks: int
    per_stripe: int       # blocks of a stripe
    size: Column          # bytes of an embedding
    kernel: Callable
    sparse: bool

    @classmethod
    def of(cls, vectors: DataFrame, kernel: Callable, sparse: bool, size: Column, total_bytes: int, block_bytes: int) -> Blocks:
        spark = vectors.sparkSession
        n_groups = min(PIVOTS, max(1, -(-total_bytes // block_bytes)))
        some = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_groups)
        if sparse:
            heaviest = F.slice(F.reverse(F.array_sort(F.arrays_zip(F.col("embedding.values").alias("v"), F.col("embedding.indices").alias("i")))), 1, PIVOT_TERMS)
            some = some.select("doc_id", heaviest.alias("_top")).select("doc_id", F.struct(
                F.transform("_top", lambda x: x["i"]).alias("indices"), F.transform("_top", lambda x: x["v"]).alias("values")).alias("embedding"))
        table = some.toArrow()  # at most PIVOTS vectors of a bounded length
        pivots = spark.sparkContext.broadcast(table["embedding"])
        grouped = stage(_grouped(vectors, pivots, kernel, sparse), "vector-groups")
        parts = [1] * n_groups
        for r in grouped.groupBy("_group").agg(F.sum(size).alias("bytes")).collect():  # a row per group
            parts[r["_group"]] = max(1, -(-r["bytes"] // block_bytes))
        first = [sum(parts[:g]) for g in range(n_groups)]
        of_group = lambda numbers: F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("_group") + 1)
        block = of_group(first) + F.pmod(F.xxhash64("doc_id"), of_group(parts))
        placed = grouped.select("doc_id", "embedding", block.cast("int").alias("_block"))
        return cls(placed, sum(parts), max(1, STRIPE_BYTES // block_bytes), size, kernel, sparse)

    def search(self, queries: DataFrame, k: int, query_id: str, chunk_bytes: int, cells: Observation | None = None) -> DataFrame:
        """(query_id, rank, doc_id, similarity_score); ``cells`` observes ``built`` and ``all`` cells of (query, block)."""
        # The rows are numbered once and staged, so that ids may repeat.
        rows = stage(queries.select(query_id, "embedding").withColumn("_row", F.monotonically_increasing_id()), "query-rows")
        found = self._cells(rows, k, chunk_bytes)
        if cells is not None:
            met = F.col("doc_id").isNull()  # a row for each query and stripe that counts its blocks
            found = found.observe(cells, F.coalesce(F.sum(F.when(met, F.col("_all"))), F.lit(0)).alias("all"),
                                  F.coalesce(F.sum(F.when(met, F.col("_built"))), F.lit(0)).alias("built"))
        found = found.where(F.col("doc_id").isNotNull()).select("_row", "doc_id", "similarity_score").distinct()
        order = Window.partitionBy("_row").orderBy(F.desc("similarity_score"), "doc_id")
        hits = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return hits.join(rows.select("_row", query_id), "_row").select(query_id, "rank", "doc_id", "similarity_score")

    def _cells(self, rows: DataFrame, k: int, chunk_bytes: int) -> DataFrame:
        """The ``k`` best of each query in each stripe: a task reads its stripe, then the queries of its share."""
        index, search = self.kernel(self.sparse, k)
        kind = self.vectors.schema["embedding"].dataType
        stripes = -(-self.n_blocks // self.per_stripe)
        asked_bytes = rows.agg(F.coalesce(F.sum(self.size), F.lit(0))).first()[0]
        # A small table of vectors is copied to several tasks, so that all cores have queries to answer.
        cores = rows.sparkSession.sparkContext.defaultParallelism
        shares = max(1, min(-(-2 * cores // stripes), -(-asked_bytes // ASKED_BYTES)))
        stripe = (F.col("_block") / F.lit(self.per_stripe)).cast("int") * shares
        docs = self.vectors.select(F.explode(F.sequence(stripe, stripe + shares - 1)).alias("_task"), F.lit(0).alias("_turn"), "_block",
                                   F.col("doc_id").alias("_id"), "embedding")
        share = F.pmod(F.xxhash64("_row"), F.lit(shares)).cast("int")
        tasks = F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda s: s * shares + share)
        asked = rows.select(F.explode(tasks).alias("_task"), F.lit(1).alias("_turn"), F.lit(0).alias("_block"),
                            F.col("_row").alias("_id"), F.col("embedding").cast(kind).alias("embedding"))
        both = docs.unionByName(asked).repartitionById(max(2, stripes * shares), F.col("_task"))
        both = both.sortWithinPartitions("_task", "_turn", "_block")

        def run(batches):
            import numpy as np
            import pyarrow as pa

            key, held, block = None, [], None
            for batch in batches:
                where = np.stack([batch.column(i).to_numpy() for i in range(2)])
                edges = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(axis=0), True])
                for a, z in zip(edges[:-1], edges[1:]):
                    some = batch.slice(a, z - a)
                    if key != where[0, a]:
                        key, held, block = where[0, a], [], None
                    if where[1, a] == 0:
                        held.append(some)
                        continue
                    if held:
                        table = pa.Table.from_batches(held)
                        held = []
                        number = np.unique(table["_block"].to_numpy(), return_inverse=True)[1]
                        block = index(table["_id"].combine_chunks(), table["embedding"].combine_chunks(), number)
                        del table
                    if block is None:
                        continue
                    step = max(1, chunk_bytes * some.num_rows // max(1, some.nbytes))
                    for start in range(0, some.num_rows, step):
                        asked = some.slice(start, step)
                        row, _, doc, score, built = search(block, asked.column(4))
                        n, none = asked.num_rows, pa.nulls
                        yield pa.RecordBatch.from_arrays(
                            [asked.column(3).take(pa.array(row)), pa.array(doc, pa.int64()), pa.array(score, pa.float64()),
                             none(len(row), pa.int64()), none(len(row), pa.int64())], names)
                        yield pa.RecordBatch.from_arrays(
                            [asked.column(3), none(n, pa.int64()), none(n, pa.float64()), pa.array(built, pa.int64()),
                             pa.array(np.full(n, block["n_parts"]), pa.int64())], names)

        names = ["_row", "doc_id", "similarity_score", "_built", "_all"]
        return both.mapInArrow(run, "_row long, doc_id long, similarity_score double, _built long, _all long")


def _grouped(vectors: DataFrame, pivots: Broadcast, kernel: Callable, sparse: bool) -> DataFrame:
    """Adds ``_group``, the pivot with the largest inner product."""
    index, search = kernel(sparse, 1)
    schema = T.StructType([*vectors.schema.fields, T.StructField("_group", T.IntegerType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        embeddings = pivots.value
        block = index(pa.chunked_array([pa.array(range(len(embeddings)), pa.int64())]), embeddings)
        for batch in batches:
            row, _, group, _, _ = search(block, batch.column(1))
            own = np.zeros(batch.num_rows, np.int32)
            own[row] = group
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], [f.name for f in schema.fields])

    return vectors.mapInArrow(run, schema)
