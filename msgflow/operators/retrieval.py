"""Exact top-k retrieval over a vector table (doc_id, embedding).

An embedding is an array of numbers, or struct(indices, values) when sparse; an
index is any 64-bit number.  Scores are inner products, rounded to six decimals
before ranking, with ties by doc_id, so they do not depend on the order of
summation.  Documents without an embedding are never found; a query without one
finds nothing.  Query ids may repeat: every row of the queries has its own hits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from msgflow import values
from msgflow.operators.vector_blocks import Blocks
from msgflow.staging import stage

SALTS = 16  # ways that the hits of one document are spread when its text is fetched

BROADCAST_BYTES = 16 * 1024 * 1024   # vector tables up to this size go to every executor, and to each of its Python workers
BLOCK_BYTES = 64 * 1024 * 1024       # larger ones are searched in blocks of about this size
CHUNK_BYTES = 64 * 1024 * 1024       # by pieces of queries of about this size


def _kernel(sparse: bool, k: int) -> tuple[Callable, Callable]:
    """(index, search) over Arrow arrays; self-contained, so executors need only numpy.

    A search leaves out what a bound shows to stand behind the k best: whole pieces of dense
    vectors by the distance from their centre, sparse ones by the most that the query's frequent
    terms can add. ``slack`` keeps all that could round to the same score.
    """
    slack, piece_rows, query_rows = 2e-6, 1024, 2000

    def ragged(column):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        parts = ([pc.struct_field(column, name) for name in ("indices", "values")]
                 if sparse else [column])
        lengths = pc.list_value_length(parts[0]).fill_null(0).to_numpy(zero_copy_only=False)
        flat = [pc.list_flatten(p).to_numpy(zero_copy_only=False) for p in parts]
        return lengths.astype(np.int64), [flat[0].astype(np.int64) if sparse else flat[0].astype(np.float64),
                                          *[f.astype(np.float64) for f in flat[1:]]]

    def index(doc_ids, embeddings, parts=None):
        """Documents made ready to search; ``parts`` numbers the block of each, from 0.

        With ``parts`` so many hits are found that, an id's copies counted once, the k best are among them.
        """
        import numpy as np

        ids = doc_ids.to_numpy().astype(np.int64)
        copies = 1 if parts is None or not len(ids) else int(np.unique(ids, return_counts=True)[1].max())
        parts = np.zeros(len(ids), np.int32) if parts is None else parts
        n_parts = int(parts.max()) + 1 if len(ids) else 0
        lengths, flat = ragged(embeddings)
        if not sparse:
            order = np.lexsort((ids, parts))
            parts, matrix = parts[order], flat[0].reshape(len(ids), -1)[order]
            edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True]) if len(ids) else np.zeros(1, np.int64)
            starts = [np.arange(a, z, piece_rows) for a, z in zip(edges[:-1], edges[1:])]
            starts = np.append(np.concatenate(starts), len(ids)) if starts else np.zeros(1, np.int64)
            pieces = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
            centres = np.array([matrix[a:z].mean(0) for a, z in pieces]).reshape(len(pieces), -1)
            far = np.array([np.sqrt(((matrix[a:z] - c) ** 2).sum(1).max()) for (a, z), c in zip(pieces, centres)])
            return {"ids": ids[order], "copies": copies, "matrix": matrix, "part": parts, "n_parts": n_parts, "pieces": pieces, "centres": centres, "far": far}
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(place, lengths)
        by_term = np.lexsort((doc, flat[0]))
        term, doc, weight = flat[0][by_term], doc[by_term], flat[1][by_term]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, np.int64)
        if len(first) < len(term):  # an index that a document names twice counts with the sum
            term, doc, weight = term[first], doc[first], np.add.reduceat(weight, first)
        terms, starts, which = np.unique(term, return_index=True, return_inverse=True)
        by_doc = np.argsort(doc, kind="stable")
        most = np.maximum.reduceat(weight, starts) if len(terms) else np.zeros(0)
        return {"ids": ids[order], "copies": copies, "terms": terms, "starts": np.append(starts, len(term)), "doc": doc.astype(np.int32), "weight": weight,
                "most": most, "plain": not (weight < 0).any(), "part": parts[order], "n_parts": n_parts,
                "row_starts": np.searchsorted(doc[by_doc], np.arange(len(ids) + 1)), "row_term": which[by_doc].astype(np.int32), "row_weight": weight[by_doc]}

    def dense(block, embeddings):
        """(query row, document, rounded score, blocks met) of pieces of bounded size."""
        import numpy as np

        lengths, flat = ragged(embeddings)
        wide, keep = block["matrix"].shape[1], min(k * block["copies"], len(block["ids"]))
        if len(lengths) and not (lengths == wide).all():
            raise ValueError(f"A query has {int(lengths[lengths != wide][0])} numbers, the documents have {wide}.")
        every, ids = flat[0].reshape(len(lengths), -1), block["ids"]

        def best(found, n):
            row, doc, score = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((ids[doc], -score, row))
            row, doc, score = row[order], doc[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            some = rank < keep
            row, doc, score, last = row[some], doc[some], score[some], rank[some] == keep - 1
            least = np.full(n, -np.inf)
            least[row[last]] = score[last] / 1e6
            return (row, doc, score), least

        for at in range(0, len(every), query_rows):
            asked = every[at:at + query_rows]
            n = len(asked)
            bounds = asked @ block["centres"].T + np.sqrt((asked ** 2).sum(1))[:, None] * block["far"] + slack
            least, met, found, held = np.full(n, -np.inf), np.zeros((n, block["n_parts"]), bool), [], 0
            for p in np.argsort(-bounds.mean(0), kind="stable"):
                a, z = block["pieces"][p]
                active = np.flatnonzero(~(bounds[:, p] < least))
                if not len(active):
                    continue
                met[active, block["part"][a]] = True
                scores = asked[active] @ block["matrix"][a:z].T
                floor = least[active]
                if z - a >= keep and np.isneginf(floor).any():
                    floor = np.maximum(floor, np.partition(scores, z - a - keep, axis=1)[:, z - a - keep])
                row, doc = np.nonzero(~(scores < (floor - slack)[:, None]))
                found.append((active[row], doc + a, np.rint(scores[row, doc] * 1e6).astype(np.int64)))
                held += len(row)
                if held > 4 * n * keep:
                    one, least = best(found, n)
                    found, held = [one], len(one[0])
            (row, doc, score), _ = best(found, n)
            yield at + row, doc, score, met.sum(1)

    def met(block, embeddings):
        """The same for sparse vectors: a query's rare terms first, until no other document can reach the k best."""
        import numpy as np

        ids, weights, docs, starts = block["ids"], block["weight"], block["doc"], block["starts"]
        n_docs, n_terms = len(ids), len(block["terms"])
        keep = min(k * block["copies"], n_docs)
        lengths, (term, weight) = ragged(embeddings)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.minimum(np.searchsorted(block["terms"], term), max(n_terms - 1, 0))
        known = block["terms"][place] == term if n_terms else np.zeros(len(term), bool)
        place, weight, row = place[known], weight[known], row[known]
        ends = np.searchsorted(row, np.arange(len(lengths) + 1)).tolist()
        scores, of_term, pads = np.zeros(n_docs), np.zeros(n_terms), np.arange(keep)

        def postings(first, n):
            return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))

        def add(w, begin, n):
            """The terms' part of the scores: short lists together, long ones as they lie."""
            short = n < 256
            which = postings(begin[short], n[short])
            np.add.at(scores, docs[which], np.repeat(w[short], n[short]) * weights[which])
            for x, a, m in zip(w[~short].tolist(), begin[~short].tolist(), n[~short].tolist()):
                np.add.at(scores, docs[a:a + m], x * weights[a:a + m])

        def one(at, w):
            """(documents that may be among the k best, their scores)"""
            begin = starts[at]
            n = starts[at + 1] - begin
            order = np.argsort(n, kind="stable")
            at, w, begin, n = at[order], w[order], begin[order], n[order]
            cost = np.cumsum(n)
            plain = block["plain"] and not (w < 0).any()
            rest = np.append(np.cumsum((w * block["most"][at])[::-1])[::-1], 0.0)  # what the terms from here on can add
            scores.fill(0.0)
            a, early, least = 0, docs[:0], -np.inf
            while a < len(at):
                z = max(a + 1, int(np.searchsorted(cost, max(256, 4 * cost[a - 1] if a else 0), side="right")))
                add(w[a:z], begin[a:z], n[a:z])
                a = z
                if len(early) < keep:  # documents of the rarest terms: the k-th best of them is a bound for the k-th best of all
                    early = np.unique(np.concatenate([early, *[docs[x:x + min(m, 256 + keep)] for x, m in zip(begin[:z][::-1][:32], n[:z][::-1][:32])]]))
                if len(early) < keep:
                    continue
                reached = scores[early]
                least = np.partition(reached, len(early) - keep)[len(early) - keep] - slack
                if not plain or a >= len(at) or rest[a] >= least:
                    continue
                some = np.flatnonzero(scores >= least - rest[a])
                sizes = block["row_starts"][some + 1] - block["row_starts"][some]
                if 2 * int(sizes.sum()) > cost[-1] - cost[a - 1]:
                    continue  # the other terms cost less than these documents
                which = postings(block["row_starts"][some], sizes)
                np.add.at(of_term, at, w)
                value = np.bincount(np.repeat(np.arange(len(some)), sizes), of_term[block["row_term"][which]] * block["row_weight"][which], len(some))
                of_term[at] = 0.0
                return some, value
            if plain and least <= 0:  # documents without any of the terms may be among the best
                some = np.union1d(np.flatnonzero(scores), pads)
            else:
                some = np.flatnonzero(scores >= least)
            return some, scores[some]

        for i in range(len(lengths)):
            some, value = one(place[ends[i]:ends[i + 1]], weight[ends[i]:ends[i + 1]])
            blocks_met = len(np.unique(block["part"][some])) if block["n_parts"] > 1 else 1
            if len(some) > 4 * keep:
                few = value >= np.partition(value, len(value) - keep)[len(value) - keep] - slack
                some, value = some[few], value[few]
            rounded = np.rint(value * 1e6).astype(np.int64)
            best = np.lexsort((some, -rounded))[:keep]
            yield np.full(keep, i), some[best], rounded[best], np.array([blocks_met])

    def search(block, embeddings):
        """(query row, rank, doc_id, score) arrays of the k best documents of each query, and for each query how many blocks were met."""
        import numpy as np

        n_docs = len(block["ids"])
        found = list((met if sparse else dense)(block, embeddings)) if n_docs else []
        if not found:
            none = np.empty(0, dtype=np.int64)
            return none, none, none, none.astype(np.float64), none
        row, doc, score, built = (np.concatenate(parts) for parts in zip(*found))
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        return row, rank, block["ids"][doc], score / 1e6, built

    return index, search


def is_sparse(df: DataFrame, embedding: str = "embedding") -> bool:
    return isinstance(df.schema[embedding].dataType, T.StructType)


def vector_bytes(vectors: DataFrame, embedding: str = "embedding") -> int:
    """The memory the vector table takes as numbers: 8 bytes each, and 8 per index."""
    return vectors.agg(F.coalesce(F.sum(_numbers(is_sparse(vectors, embedding), embedding)), F.lit(0))).first()[0]


def _numbers(sparse: bool, embedding: str = "embedding") -> Column:
    size = F.coalesce(F.size(f"{embedding}.indices") if sparse else F.size(embedding), F.lit(0))
    return size.cast("bigint") * (16 if sparse else 8) + 8


def checked_vectors(vectors: DataFrame) -> DataFrame:
    """(doc_id, embedding) without null embeddings; an error that names a document if dense ones differ in length."""
    vectors = vectors.select(F.col("doc_id").cast("bigint"), "embedding").where(F.col("embedding").isNotNull())
    if is_sparse(vectors):
        return vectors
    size = F.size("embedding")
    sizes = vectors.agg(F.min(size).alias("a"), F.max(size).alias("z"), F.min_by("doc_id", size).alias("short"),
                        F.max_by("doc_id", size).alias("long")).first()
    if sizes["a"] != sizes["z"]:
        raise ValueError(f"Embeddings differ in length: document {sizes['short']} has {sizes['a']} numbers, "
                         f"document {sizes['long']} has {sizes['z']}.")
    return vectors


@dataclass
class VectorIndex:
    """A vector table made ready once and searched many times, for example by every micro-batch of a stream."""

    vectors: DataFrame
    size: int
    block: Broadcast | None  # the whole table, if it is small
    blocks: Blocks | None    # else the table in blocks

    @classmethod
    def of(cls, vectors: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES) -> VectorIndex:
        vectors = checked_vectors(vectors)
        size, block, blocks = vector_bytes(vectors), None, None
        if size <= broadcast_bytes:
            index, _ = _kernel(is_sparse(vectors), 1)
            table = vectors.toArrow()  # its size has just been checked
            block = vectors.sparkSession.sparkContext.broadcast(index(table["doc_id"], table["embedding"]))
        else:
            sparse = is_sparse(vectors)
            blocks = Blocks.of(vectors, _kernel, sparse, _numbers(sparse), size, block_bytes)
        return cls(vectors, size, block, blocks)


def _hits_schema(queries: DataFrame, query_id: str) -> T.StructType:
    return T.StructType([queries.schema[query_id], T.StructField("rank", T.IntegerType()),
                         T.StructField("doc_id", T.LongType()), T.StructField("similarity_score", T.DoubleType())])


def _top_k_broadcast(queries: DataFrame, sparse: bool, block: Broadcast, k: int, query_id: str) -> DataFrame:
    _, search = _kernel(sparse, k)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row, rank, doc, score, _ = search(block.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(rank, pa.int32()), pa.array(doc, pa.int64()),
                 pa.array(score, pa.float64())], names=[query_id, "rank", "doc_id", "similarity_score"])

    return queries.select(query_id, "embedding").mapInArrow(run, _hits_schema(queries, query_id))


def top_k(queries: DataFrame, vectors: DataFrame | VectorIndex, k: int = values.SEARCH_TOP_K, query_id: str = "query_id",
          broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES,
          chunk_bytes: int = CHUNK_BYTES, cells: Observation | None = None) -> DataFrame:
    """(query_id, rank, doc_id, similarity_score): the k best documents of each row of the queries.

    Fewer than k rows only if the table holds fewer than k documents with an
    embedding, and none for a query without one.  The vector table is measured
    first (or once, by :class:`VectorIndex`): a small one goes to every executor
    and the queries stay where they are, a larger one is searched in stripes of blocks
    (see :mod:`msgflow.operators.vector_blocks`; ``cells`` observes how many pairs of a query
    and a block had a document that the bounds did not rule out).  Both ways give the same rows.
    """
    index = vectors if isinstance(vectors, VectorIndex) else VectorIndex.of(vectors, broadcast_bytes, block_bytes)
    queries = queries.where(F.col("embedding").isNotNull())
    if index.block is not None:
        return _top_k_broadcast(queries, is_sparse(index.vectors), index.block, k, query_id)
    return index.blocks.search(queries, k, query_id, chunk_bytes, cells)


def with_documents(hits: DataFrame, knowledge_base: DataFrame, query_id: str = "query_id",
                   output: str = "retrieved_documents", hold: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """(query_id, array of documents, best first), for distinct query ids.

    The hits are read twice, so ``hold`` keeps them: the search runs once.  Texts are fetched after the top-k, for hits only.  A document that a third of
    all queries hit is met in SALTS tasks: hits are dealt by their query, documents
    copied to each.
    """
    doc = F.struct("rank", "doc_id", "instruction", "response", "intent", "category", "similarity_score")
    hits = hold(hits, "hits")
    dealt = hits.withColumn("_salt", F.pmod(F.xxhash64(query_id), F.lit(SALTS)).cast("int"))
    texts = knowledge_base.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = texts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = dealt.join(texts, ["doc_id", "_salt"]).groupBy(query_id).agg(F.array_sort(F.collect_list(doc)).alias("_docs"))
    return found.select(query_id, F.transform("_docs", lambda d: d.dropFields("rank")).alias(output))


def retrieval_checks(hits: DataFrame, expected: Column, query_id: str = "query_id") -> DataFrame:
    """(query_id, n_hits, descending, precision): ``expected`` says whether a hit is on topic."""
    by_rank = F.array_sort(F.collect_list(F.struct("rank", F.col("similarity_score").alias("s"))))
    found = hits.withColumn("_hit", expected.cast("int")).groupBy(query_id).agg(
        F.count("*").alias("n_hits"), by_rank.alias("_ranked"), F.avg("_hit").alias("precision"))
    pairs = F.zip_with(F.slice("_ranked", 1, F.size("_ranked") - 1), F.slice("_ranked", 2, F.size("_ranked")),
                       lambda a, b: a["s"] >= b["s"])
    return found.select(query_id, "n_hits", F.forall(pairs, lambda ok: ok).alias("descending"), "precision")
