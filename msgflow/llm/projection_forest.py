"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

*Trees.*  Vectors are lifted to one norm by a further component, sqrt(R^2 - |x|^2) with R the
largest norm, so that the largest inner product is the smallest angle.  Each tree
halves a bounded sample again and again by the direction between two means.  Every row
of the table is then sent down every tree.

*Search.*  A query's way down the trees is a single priority queue over all of them: the
leaf whose worst hyperplane on its path is nearest comes next.  How many leaves a
query opens is measured, not given: for a bounded sample of queries the true
neighbours are found by one pass over the whole table, and the number of leaves is the
smallest that finds ``recall`` of them.  So data that fall into clusters cost few
leaves, and data without structure as many as they need.

*Reranking.*  Leaves are packed into blocks of bounded size, one task each; a leaf of more
rows than a block is split.  A query goes to the blocks of its leaves, where the
candidates are scored with the original vectors.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from msgflow.llm.vectors import Shipped, finite, from_bytes, matrix, not_zero, packed, part_of, to_bytes, width_of
from msgflow.staging import stage

#: Rows that the trees are grown on, and the fewest of them in a leaf; so a tree has at most SAMPLE / LEAST leaves.
SAMPLE, LEAST = 1 << 15, 8
#: Rows of the whole table that a leaf should have.
LEAF = 256
TREES = 2
#: Queries whose true neighbours set the number of leaves to open, and the part of them to be found.
PROBES, RECALL = 256, 0.96
#: A block holds at most so many rows, or a part in SHARES of the table if that is less.
BLOCK, SHARES = 1 << 17, 8
#: Numbers in a task's table of scores.
SCORES = 1 << 22
#: Scores nearer than this part of the norms may be equal; they are summed again in the order of components.
SLACK = 1e-9


class Tree(NamedTuple):
    """Inner nodes: a plane, its offset, and two children, which are nodes or, if negative, leaves (~number)."""

    plane: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    root: int
    leaves: int


class Forest(NamedTuple):
    reach: float
    width: int
    trees: list[Tree]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.reach ** 2 - np.einsum("ij,ij->i", rows, rows), 0)
        return np.c_[rows, np.sqrt(rest)]

    def aimed(self, rows: np.ndarray) -> np.ndarray:
        """Queries on the sphere of the lifted rows."""
        norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        return np.c_[rows * (self.reach / norm)[:, None], np.zeros(len(rows))]

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        points = self.lifted(rows)
        out = np.zeros((len(rows), len(self.trees)), np.int32)
        for t, tree in enumerate(self.trees):
            node = np.full(len(rows), tree.root)
            while len(at := np.flatnonzero(node >= 0)):
                on = node[at]
                side = np.einsum("ij,ij->i", points[at], tree.plane[on]) >= tree.offset[on]
                node[at] = tree.child[on, side.astype(int)]
            out[:, t] = ~node
        return out

    def opened(self, queries: np.ndarray, visits: int):
        """For each query the ``visits`` leaves (tree, leaf) that a queue shared by all trees opens, in its order."""
        points, children = self.aimed(queries), [tree.child.tolist() for tree in self.trees]
        for start in range(0, len(points), 256):
            some = points[start:start + 256]
            margins = [(some @ tree.plane.T - tree.offset).tolist() for tree in self.trees]
            for i in range(len(some)):
                yield self._walk([m[i] for m in margins], children, visits)

    def _walk(self, margins: list[list[float]], children: list, visits: int) -> list[tuple[int, int]]:
        queue, found = [(0.0, t, tree.root) for t, tree in enumerate(self.trees)], []
        while queue and len(found) < visits:
            away, t, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[t][node]
                near, far = (1, 0) if margin >= 0 else (0, 1)
                heapq.heappush(queue, (max(away, abs(margin)), t, children[t][node][far]))
                node = children[t][node][near]
            found.append((t, ~node))
        return found


def _halving(points: np.ndarray, rng) -> tuple[np.ndarray, float] | None:
    """A plane between two means of ``points`` that leaves about half on each side; None if they are all alike."""
    for _ in range(4):
        a, b = points[rng.choice(len(points), 2, replace=False)]
        for _ in range(3):
            nearer = ((points - a) ** 2).sum(1) < ((points - b) ** 2).sum(1)
            if nearer.all() or not nearer.any():
                break
            a, b = points[nearer].mean(0), points[~nearer].mean(0)
        plane = b - a
        norm = np.sqrt(plane @ plane)
        if norm == 0:
            continue
        plane = plane / norm
        along = points @ plane
        middle = np.median(along)
        if not (along < middle).any():
            above = along[along > middle]
            if not len(above):
                continue
            middle = above.min()
        return plane, float(middle)
    return None


def grown(points: np.ndarray, leaf: int, rng) -> Tree:
    """A tree over ``points``, whose leaves hold about ``leaf`` of them."""
    planes, offsets, children, leaves, root = [], [], [], 0, 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, above, side = todo.pop()
        cut = _halving(points[rows], rng) if len(rows) > max(leaf, 2) else None
        if cut is None:
            name, leaves = ~leaves, leaves + 1
        else:
            name = len(planes)
            planes.append(cut[0])
            offsets.append(cut[1])
            children.append([0, 0])
            right = points[rows] @ cut[0] >= cut[1]
            todo += [(rows[~right], name, 0), (rows[right], name, 1)]
        if above < 0:
            root = name
        else:
            children[above][side] = name
    wide = points.shape[1]
    return Tree(np.array(planes).reshape(-1, wide), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), root, leaves)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, summed in the order of components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def best(owner: np.ndarray, score: np.ndarray, keep: int, slack: float = 0.0) -> np.ndarray:
    """The rows whose score is among the ``keep`` best of their owner, or nearer to those than ``slack``."""
    order = np.lexsort((-score, owner))
    starts = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(order)])
    last = order[np.minimum(starts + keep, starts + sizes) - 1]
    least = np.repeat(score[last], sizes) - slack
    return order[score[order] >= least]


# -------------------------------------------------------------- plan, in steps


def _points(rows: DataFrame, row_id: str, vector: str, keep: int) -> DataFrame:
    """(id, vec): of rows with equal vectors those of the ``keep`` smallest ids, each once, staged.

    No other of them can be among the ``keep`` - 1 nearest of any query, so a vector of
    any number of copies costs ``keep`` rows.  ``place`` counts them, from 1.
    """
    usable = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("vec")).where(
        F.col("id").isNotNull() & finite(F.col("vec")) & not_zero(F.col("vec"))).distinct()
    same = Window.partitionBy("vec").orderBy("id")
    ranked = usable.withColumn("place", F.row_number().over(same)).where(F.col("place") <= keep)
    return stage(ranked, "forest-points")


def _forest(points: DataFrame, width: int, n: int) -> Forest:
    """Trees over a sample of at most SAMPLE rows, which is all that comes to the driver."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    reach = points.agg(F.max(norm)).first()[0]
    sample = points.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    rows, rng = matrix(sample["vec"], width), np.random.default_rng(7)
    forest = Forest(float(reach), width, [])
    lifted = forest.lifted(rows)
    leaf = max(LEAST, LEAF * len(rows) // n)
    return forest._replace(trees=[grown(lifted, leaf, rng) for _ in range(TREES)])


def _visits(points: DataFrame, asked: DataFrame, forest: Forest, k: int, recall: float) -> int:
    """The number of leaves that finds ``recall`` of the true neighbours of a bounded sample of queries."""
    probes = asked.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(PROBES).toArrow()
    own, wanted = probes["rep"].to_numpy(), matrix(probes["vec"], forest.width)
    spark = points.sparkSession
    shared = Shipped(spark, (forest, own, wanted))  # PROBES vectors and a bounded forest

    def run(batches):
        trees, ids, queries = shared.value
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, row_ids = matrix(batch.column(1), trees.width), batch.column(0).to_numpy(zero_copy_only=False)
            scores, few = rows @ queries.T, min(k + 1, len(rows))
            r, q = np.nonzero(scores >= np.partition(scores, -few, axis=0)[-few])
            mine = row_ids[r] != ids[q]
            r, q = r[mine], q[mine]
            leaves = np.zeros((len(rows), len(trees.trees)), np.int32)
            met = np.unique(r)
            leaves[met] = trees.leaves_of(rows[met])
            found = (q, row_ids[r], scores[r, q], leaves[r])
            held = found if held is None else tuple(np.concatenate(x) for x in zip(held, found))
            at = best(held[0], held[2], k)
            held = tuple(x[at] for x in held)
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held[0], pa.int32()), pa.array(held[1]), pa.array(held[2]), pa.array(list(held[3]), pa.list_(pa.int32()))],
                ["q", "id", "score", "leaves"])

    id_type = points.schema["id"].dataType.simpleString()
    near = points.select("id", "vec").mapInArrow(run, f"q int, id {id_type}, score double, leaves array<int>")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k).select("q", "leaves").collect()
    every = sum(t.leaves for t in forest.trees)
    order = [{leaf: i for i, leaf in enumerate(path)} for path in forest.opened(wanted, every)]
    needed = sorted(min(order[r.q][t, leaf] for t, leaf in enumerate(r.leaves)) + 1 for r in near)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def nearest(rows: DataFrame, row_id: str, vector: str, is_query: Column, k: int, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, <row_id>, score): the ``k`` nearest found of each row that ``is_query`` (on ``rows``) selects.

    Nearness is the inner product in double precision, ties go to the smaller id, and a
    row is not its own neighbour.  Rows take no part whose id or vector is null, or
    whose vector is empty, all zero, or holds a null or non-finite component.  A vector
    shorter than the longest counts as filled up with zeros.  Repeated rows count once;
    an id with several vectors is as near as its nearest one, and as a query it finds
    what any of its vectors finds.  Other columns are not read; no usable row, or no query, gives no rows.
    """
    spark = rows.sparkSession
    id_type = rows.schema[row_id].dataType.simpleString()
    wide = rows.schema[vector].dataType.elementType.simpleString() != "float"
    dtype = np.float64 if wide else np.float32
    points = _points(rows, row_id, vector, k + 1)
    chosen = rows.where(is_query).select(F.col(row_id).alias("query_id"), F.col(vector).alias("vec")).where(F.col("query_id").isNotNull())
    first = points.where("place = 1").select(F.col("id").alias("rep"), "vec")
    named = stage(chosen.join(first, "vec").select("query_id", "rep").distinct(), "forest-queries")
    asked = stage(first.join(named.select("rep").distinct(), "rep", "left_semi"), "forest-asked")
    n = points.count()
    schema = f"query_id {id_type}, rank int, `{row_id}` {id_type}, score double"
    if not n or asked.isEmpty():
        return spark.createDataFrame([], schema)
    width = width_of(points, "vec")
    forest = _forest(points, width, n)
    visits = _visits(points, asked, forest, k, recall)
    blocks = _blocks(points, forest, n)
    shared = Shipped(spark, (forest, blocks))
    layout = f"block int, part int, turn int, leaves array<int>, id {id_type}, vec binary"

    def batch_of(block, part, turn, leaves, ids, vecs):
        return pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(block), turn), pa.int32()),
             leaves, ids, to_bytes(vecs.astype(dtype))], ["block", "part", "turn", "leaves", "id", "vec"])

    def one_each(values):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1), pa.int32()), pa.array(values, pa.int32()))

    def index(batches):
        trees, (block_of, parts_of) = shared.value
        for batch in batches:
            vecs, ids = matrix(batch.column(1), trees.width), batch.column(0)
            leaves = trees.leaves_of(vecs)
            keys = batch.column(2).to_numpy()
            for t in range(len(trees.trees)):
                at = leaves[:, t]
                yield batch_of(block_of[t][at], part_of(keys, parts_of[t][at]), 0, one_each(at), ids, vecs)

    def ask(batches):
        trees, (block_of, parts_of) = shared.value
        for batch in batches:
            vecs = matrix(batch.column(1), trees.width)
            for start in range(0, len(vecs), 512):
                who, block, part, leaves = [], [], [], []
                for i, path in enumerate(trees.opened(vecs[start:start + 512], visits), start):
                    to: dict = {}
                    for t, leaf in path:
                        for p in range(parts_of[t][leaf]):
                            to.setdefault((int(block_of[t][leaf]), p), []).append(leaf)
                    for (b, p), own in to.items():
                        who.append(i)
                        block.append(b)
                        part.append(p)
                        leaves.append(own)
                yield batch_of(block, part, 1, pa.array(leaves, pa.list_(pa.int32())), batch.column(0).take(pa.array(who, pa.int64())), vecs[who])

    def search(batches):
        key, held, ready = None, [], None
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(axis=0), True])
            for a, z in zip(edges[:-1], edges[1:]):
                some, turn = batch.slice(a, z - a), where[2, a]
                if key != (where[0, a], where[1, a]):
                    key, held, ready = (where[0, a], where[1, a]), [], None
                if turn == 0:
                    held.append(some)
                    continue
                if ready is None:
                    ready, held = _ready(held, width, dtype), []
                if ready is not None:
                    yield from _scored(some, ready, width, dtype, k + 1)

    groups = int(sum(p.sum() for p in blocks[1]))
    dealt = points.select("id", "vec", F.xxhash64("id")).mapInArrow(index, layout).unionByName(asked.select("rep", "vec").mapInArrow(ask, layout))
    dealt = dealt.repartition(min(groups, 8192), "block", "part").sortWithinPartitions("block", "part", "turn")
    # One shuffle serves both steps: a query's hits are few, at most k + 1 from each block it goes to.
    found = dealt.mapInArrow(search, f"rep {id_type}, id {id_type}, score double").repartition("rep")
    found = found.groupBy("rep", "id").agg(F.max("score").alias("score"))
    of_rep = Window.partitionBy("rep").orderBy(F.desc("score"), "id")
    found = stage(found.withColumn("place", F.row_number().over(of_rep)).where(F.col("place") <= k + 1), "forest-found")
    hits = named.join(found, "rep").where(F.col("id") != F.col("query_id")).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(row_id), "score")


def _blocks(points: DataFrame, forest: Forest, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each tree the block and the number of parts of each leaf, by the leaves' sizes (a row each on the driver)."""
    shared = Shipped(points.sparkSession, forest)

    def run(batches):
        counts = [np.zeros(t.leaves, np.int64) for t in shared.value.trees]
        for batch in batches:
            leaves = shared.value.leaves_of(matrix(batch.column(0), shared.value.width))
            for t, c in enumerate(counts):
                c += np.bincount(leaves[:, t], minlength=len(c))
        for t, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at])], ["tree", "leaf", "n"])

    counts = [np.zeros(t.leaves, np.int64) for t in forest.trees]
    sizes = points.select("vec").mapInArrow(run, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    for r in sizes.collect():
        counts[r.tree][r.leaf] = r.n
    blocks, parts, first = [], [], 0
    for c in counts:
        block, part = packed(c, max(1, min(BLOCK, -(-n // SHARES))))
        blocks.append(block + first)
        parts.append(part)
        first += int(block.max(initial=0)) + 1
    return blocks, parts


def _ready(held: list, width: int, dtype):
    """The rows of a block by leaf: ids, matrix, and {leaf: (start, stop)}."""
    if not held:
        return None
    table = pa.Table.from_batches(held).combine_chunks()
    leaf = table["leaves"].combine_chunks().flatten().to_numpy()
    order = np.argsort(leaf, kind="stable")
    rows = from_bytes(table["vec"].combine_chunks(), width, dtype)[order].astype(np.float64)
    names, starts = np.unique(leaf[order], return_index=True)
    stops = np.r_[starts[1:], len(order)]
    return table["id"].combine_chunks().take(pa.array(order)), rows, {int(x): (int(a), int(z)) for x, a, z in zip(names, starts, stops)}


def _scored(some: pa.RecordBatch, ready, width: int, dtype, keep: int):
    """The ``keep`` best rows of the leaves that each query opens in this block."""
    ids, rows, places = ready
    queries = from_bytes(some.column(5), width, dtype).astype(np.float64)
    slack = SLACK * np.sqrt((queries ** 2).sum(1).max()) * np.sqrt((rows ** 2).sum(1).max())
    by_leaf: dict = {}
    for i, leaves in enumerate(some.column(3).to_pylist()):
        for leaf in leaves:
            by_leaf.setdefault(leaf, []).append(i)
    q, c, s = [], [], []
    for leaf, who in by_leaf.items():
        if leaf not in places:
            continue
        a, z = places[leaf]
        step = max(1, SCORES // (z - a))
        for start in range(0, len(who), step):
            asking = np.array(who[start:start + step])
            scores = queries[asking] @ rows[a:z].T
            if z - a > keep:
                r, at = np.nonzero(scores >= np.partition(scores, -keep, axis=1)[:, -keep, None] - slack)
            else:
                r, at = np.divmod(np.arange(scores.size), z - a)
            q.append(asking[r])
            c.append(a + at)
            s.append(scores[r, at])
    if not q:
        return
    q, c, s = np.concatenate(q), np.concatenate(c), np.concatenate(s)
    near = best(q, s, keep, slack)
    q, c = q[near], c[near]
    exact = exact_products(queries[q], rows[c])
    yield pa.RecordBatch.from_arrays([some.column(4).take(pa.array(q)), ids.take(pa.array(c)), pa.array(exact)], ["rep", "id", "score"])
