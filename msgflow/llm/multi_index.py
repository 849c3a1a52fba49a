"""Hard negatives by inner product, exactly: an inverted multi-index searched with certified windows.

*Index.*  Components become integers.  Each half of the vectors has a codebook (k-means on
a bounded sample); a row's cell is its pair of nearest codes.  Cells are packed into
blocks of bounded size, one task each; a cell of more rows than a block is split.

*Search.*  A window asks for the best rows with the anchor's label, or with another one,
whose score lies between two bounds.  Inside a block the two lists of half-scores,
each raised by the radius of its code, are walked by a multi-sequence heap: the cell
whose summed bound is largest comes next.  A window is certified, and the walk stops,
once no cell that is left can reach its lower bound or its last result so far.

*Blocks.*  An anchor is first searched in the block it falls into.  What it finds there
raises the lower bounds of its windows, and only blocks that some cell's bound lets
reach one of them are searched then.  Nothing is dropped, so the rows are exact.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from msgflow.llm.vectors import Shipped, finite, from_bytes, matrix, packed, part_of, to_bytes, width_of
from msgflow.staging import stage

#: Rows that the codebooks are fitted on, rounds of fitting, and the most codes of a half.
SAMPLE, ROUNDS, CODES = 1 << 13, 6, 64
#: Rows that a cell should have.
CELL = 256
#: A block holds at most so many rows, or a part in SHARES of the table if that is less.
BLOCK, SHARES = 1 << 17, 32
#: Squared lengths from here on take no part: their scores, times ``whole``, could leave 64 bits.
_LONGEST = float(1 << 54)
#: Bounds are raised by this part of the lengths, more than they lose by rounding.
_SLACK = 1e-9
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Index(NamedTuple):
    """Two codebooks, and of every cell that has rows: codes, radii, block and parts, in the order of blocks."""

    width: int
    books: tuple[np.ndarray, np.ndarray]
    codes: np.ndarray  # (cells, 2)
    radii: np.ndarray  # (cells, 2)
    block: np.ndarray
    parts: np.ndarray

    def halves(self, rows: np.ndarray):
        cut = self.width // 2
        return rows[:, :cut], rows[:, cut:]

    def coded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest code of each half, and the distances from them."""
        codes, far = [], []
        for half, book in zip(self.halves(rows), self.books):
            apart = np.sqrt(np.maximum((half ** 2).sum(1)[:, None] - 2 * half @ book.T + (book ** 2).sum(1), 0))
            codes.append(apart.argmin(1))
            far.append(np.sqrt(((half - book[codes[-1]]) ** 2).sum(1)))
        return np.stack(codes, 1), np.stack(far, 1)

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """(rows, blocks): no row of a block scores more than this with an anchor."""
        total = np.zeros((len(rows), len(self.codes)))
        for h, (half, book) in enumerate(zip(self.halves(rows), self.books)):
            norm = np.sqrt((half ** 2).sum(1))
            total += (half @ book.T)[:, self.codes[:, h]] + norm[:, None] * self.radii[:, h]
        size = np.sqrt((rows ** 2).sum(1)) * (max(np.sqrt((b ** 2).sum(1)).max(initial=0) for b in self.books) + self.radii.max(initial=0))
        return np.maximum.reduceat(total, self.starts, axis=1) + _SLACK * size[:, None]

    @property
    def starts(self) -> np.ndarray:
        """The first cell of each block."""
        return np.flatnonzero(np.r_[True, np.diff(self.block) != 0])

    @property
    def block_parts(self) -> np.ndarray:
        return np.maximum.reduceat(self.parts, self.starts)

    def cell_of(self, codes: np.ndarray) -> np.ndarray:
        """The cell's place in the index, or -1 if it has no rows."""
        wide = len(self.books[1])
        names = self.codes[:, 0] * wide + self.codes[:, 1]
        place = np.minimum(np.searchsorted(names, asked := codes[:, 0] * wide + codes[:, 1]), len(names) - 1)
        return np.where(names[place] == asked, place, -1)


def codebook(points: np.ndarray, codes: int, rng) -> np.ndarray:
    """At most ``codes`` means of ``points`` by Lloyd's rounds."""
    distinct = np.unique(points, axis=0)
    book = distinct[rng.permutation(len(distinct))[:codes]]
    for _ in range(ROUNDS):
        nearest = ((book ** 2).sum(1) - 2 * points @ book.T).argmin(1)
        count = np.bincount(nearest, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, nearest, points)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


class Block:
    """The rows of a block by cell, ready to be searched."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, codes: np.ndarray, books):
        order = np.lexsort((codes[:, 1], codes[:, 0]))
        self.ids, self.labels, self.rows, codes = ids[order], labels[order], rows[order].astype(np.float64), codes[order]
        self.cut = rows.shape[1] // 2
        self.longest = float(np.sqrt((self.rows ** 2).sum(1)).max())
        self.names, self.means, self.radii = [], [], []
        for h, half in enumerate((self.rows[:, :self.cut], self.rows[:, self.cut:])):
            names, which = np.unique(codes[:, h], return_inverse=True)
            radius = np.zeros(len(names))
            np.maximum.at(radius, which, np.sqrt(((half - books[h][codes[:, h]]) ** 2).sum(1)))
            self.names.append(names.tolist())
            self.means.append(books[h][names])
            self.radii.append(radius)
        edges = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1), True]).tolist()
        self.cells = {(int(codes[a, 0]), int(codes[a, 1])): (a, z) for a, z in zip(edges[:-1], edges[1:])}

    def visited(self, anchor: np.ndarray):
        """(bound, start, stop) of the cells, the largest bound first: the multi-sequence heap."""
        lists = []
        for half, mean, radius, names in zip((anchor[:self.cut], anchor[self.cut:]), self.means, self.radii, self.names):
            bound = mean @ half + np.sqrt(half @ half) * radius
            order = np.argsort(-bound)
            lists.append((bound[order].tolist(), [names[i] for i in order]))
        (one, first), (two, second) = lists
        slack = _SLACK * np.sqrt(anchor @ anchor) * (self.longest + max(one[0], two[0], 0) ** 0.5)
        heap, reached = [(-one[0] - two[0], 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(one) and b < len(two) and (a, b) not in reached:
                    reached.add((a, b))
                    heapq.heappush(heap, (-one[a] - two[b], a, b))
            if (cell := self.cells.get((first[i], second[j]))) is not None:
                yield slack - bound, *cell

    def scores(self, start: int, stop: int, anchor: np.ndarray) -> np.ndarray:
        """Exact scores: doubles hold all sums below 2^53; beyond that integers are multiplied."""
        if self.longest * np.sqrt(anchor @ anchor) < 1 << 52:
            return (self.rows[start:stop] @ anchor).astype(np.int64)
        return self.rows[start:stop].astype(np.int64) @ anchor.astype(np.int64)

    def search(self, own, label, anchor: np.ndarray, low: list[int], high: list[int], same: bool, need: int) -> list[tuple]:
        """(window, score, id) of the ``need`` best rows of each window."""
        found: list[list] = [[] for _ in low]
        least = list(low)  # what a row must reach to count, by window
        for bound, start, stop in self.visited(anchor):
            if bound < min(least):
                break
            scores = self.scores(start, stop, anchor)
            at = np.flatnonzero((scores >= min(least)) & ((self.labels[start:stop] == label) == same) & (self.ids[start:stop] != own))
            rows = list(zip((-scores[at]).tolist(), self.ids[start + at].tolist()))
            for w, (a, z) in enumerate(zip(least, high) if rows else ()):
                if new := [r for r in rows if a <= -r[0] <= z]:
                    found[w] = sorted({*found[w], *new})[:need]
                    if len(found[w]) == need:
                        least[w] = max(least[w], -found[w][-1][0])
        return [(w, -s, i) for w, mine in enumerate(found) for s, i in mine]


# -------------------------------------------------------------- plan, in steps


def _usable(rows: DataFrame, row_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, mark, vec): a hash of the label and a vector of integers."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = rows.where(F.col(row_id).isNotNull() & F.col(label).isNotNull() & finite(F.col(vector)))
    square = F.aggregate(F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return rows.where(square < _LONGEST).select(F.col(row_id).alias("id"), F.xxhash64(label).alias("mark"), whole.alias("vec"))


def _points(rows: DataFrame, copies: int) -> DataFrame:
    """Of rows with equal vectors and labels those of the least ids, each once, staged.

    A window returns at most ``copies`` - 1 of them, the least ids first, so the others are never needed.
    """
    same = Window.partitionBy("mark", "vec").orderBy("id")
    ranked = rows.distinct().withColumn("place", F.row_number().over(same)).where(F.col("place") <= copies)
    return stage(ranked.drop("place"), "mining-points")


def _index(rows: DataFrame, n: int, width: int, dtype) -> tuple[Index, DataFrame]:
    """The index, and the rows with their codes, staged. A bounded sample and a row per cell come to the driver."""
    sample = rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    points, rng = matrix(sample["vec"], width), np.random.default_rng(11)
    codes = 1 << int(np.clip(round(np.log2(max(1.0, n / CELL)) / 2), 1, np.log2(CODES)))
    books = tuple(codebook(half, codes, rng) for half in (points[:, :width // 2], points[:, width // 2:]))
    none = np.zeros(0, np.int32)
    bare = Index(width, books, none, none, none, none)
    shared = Shipped(rows.sparkSession, bare)  # at most 2 x CODES means
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            vecs = matrix(batch.column(2), width, np.int64)
            found, far = shared.value.coded(vecs.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], to_bytes(vecs.astype(dtype)), batch.column(3), pa.array(found[:, 0], pa.int32()),
                 pa.array(found[:, 1], pa.int32()), pa.array(far[:, 0]), pa.array(far[:, 1])],
                ["id", "mark", "vec", "key", "i", "j", "d", "e"])

    coded = rows.select("id", "mark", "vec", F.xxhash64("id").alias("key")).mapInArrow(
        run, f"id {id_type}, mark long, vec binary, key long, i int, j int, d double, e double")
    coded = stage(coded, "mining-coded")
    cells = coded.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max("e").alias("e")).orderBy("i", "j").collect()
    block, parts = packed(np.array([c.n for c in cells]), max(1, min(BLOCK, -(-n // SHARES))))
    return bare._replace(codes=np.array([(c.i, c.j) for c in cells]), radii=np.array([(c.d, c.e) for c in cells]), block=block, parts=parts), coded


def _number(rows: DataFrame):
    """The narrowest integers that hold all components."""
    most = rows.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()[0] or 0
    return np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64


def _searched(index: Index, coded: DataFrame, anchors: DataFrame, same: bool, need: int, dtype) -> DataFrame:
    """(anchor, window, score, id): the best rows of each window of the anchors (id, mark, vec, home, low, high)."""
    anchors = stage(anchors, "mining-windows")
    home = _visit(index, coded, anchors, same, need, dtype, home=True)
    home = stage(home, "mining-home")
    best = home.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= need)
    raised = best.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("raised"))
    left = anchors.join(raised.withColumnRenamed("anchor", "id"), "id", "left")
    low = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.col("raised")[w], x)))
    rest = _visit(index, coded, left.withColumn("low", low).drop("raised"), same, need, dtype, home=False)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    both = home.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return stage(both.where(F.col("rank") <= need), "mining-found")


def _visit(index: Index, coded: DataFrame, anchors: DataFrame, same: bool, need: int, dtype, home: bool) -> DataFrame:
    shared = Shipped(coded.sparkSession, index)  # a row per cell, at most CODES * CODES
    id_type = coded.schema["id"].dataType.simpleString()
    layout = f"block int, part int, turn int, id {id_type}, mark long, vec binary, i int, j int, low array<long>, high array<long>"
    names = ["block", "part", "turn", "id", "mark", "vec", "i", "j", "low", "high"]
    width, cut = index.width, index.width // 2

    def dealt(batches):
        for batch in batches:
            codes = np.stack([batch.column(4).to_numpy(), batch.column(5).to_numpy()], 1)
            cell = shared.value.cell_of(codes)
            none = pa.nulls(len(cell), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shared.value.block[cell]), pa.array(part_of(batch.column(3).to_numpy(), shared.value.parts[cell])),
                 pa.array(np.zeros(len(cell), np.int32)), *batch.columns[:3], *batch.columns[4:6], none, none], names)

    def sent(batches):
        parts = shared.value.block_parts
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                own = batch.column(5).to_numpy()
                if home:
                    who, block = np.arange(len(own)), own
                else:
                    vecs = from_bytes(batch.column(2), width, dtype).astype(np.float64)
                    least = np.array([min(x) for x in batch.column(3).to_pylist()], np.float64)
                    who, block = np.nonzero((shared.value.bounds(vecs) >= least[:, None]) & (np.arange(len(parts)) != own[:, None]))
                who, block = np.repeat(who, parts[block]), np.repeat(block, parts[block])
                part = np.arange(len(who)) - np.searchsorted(who * len(parts) + block, who * len(parts) + block)
                rows = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int32()), pa.array(part, pa.int32()), pa.array(np.ones(len(who), np.int32)),
                     *[batch.column(i).take(rows) for i in range(3)], pa.nulls(len(who), pa.int32()), pa.nulls(len(who), pa.int32()),
                     batch.column(3).take(rows), batch.column(4).take(rows)], names)

    def search(batches):
        key, held, ready = None, [], None
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(axis=0), True])
            for a, z in zip(edges[:-1], edges[1:]):
                some = batch.slice(a, z - a)
                if key != (where[0, a], where[1, a]):
                    key, held, ready = (where[0, a], where[1, a]), [], None
                if where[2, a] == 0:
                    held.append(some)
                    continue
                if ready is None and held:
                    ready, held = _block(held, shared.value, dtype), []
                if ready is not None:
                    yield _answers(some, ready, shared.value.width, dtype, same, need)

    groups = int(index.block_parts.sum())
    rows = coded.mapInArrow(dealt, layout).unionByName(anchors.select("id", "mark", "vec", "low", "high", "home").mapInArrow(sent, layout))
    rows = rows.repartition(min(groups, 8192), "block", "part").sortWithinPartitions("block", "part", "turn")
    return rows.mapInArrow(search, f"anchor {id_type}, window int, score long, id {id_type}")


def _block(held: list, index: Index, dtype) -> Block:
    table = pa.Table.from_batches(held).combine_chunks()
    codes = np.stack([table["i"].to_numpy(), table["j"].to_numpy()], 1)
    return Block(table["id"].to_numpy(), table["mark"].to_numpy(), from_bytes(table["vec"].combine_chunks(), index.width, dtype), codes, index.books)


def _answers(some: pa.RecordBatch, block: Block, width: int, dtype, same: bool, need: int) -> pa.RecordBatch:
    vecs = from_bytes(some.column(5), width, dtype).astype(np.float64)
    ids, marks = some.column(3).to_numpy(zero_copy_only=False), some.column(4).to_numpy()
    out: tuple[list, ...] = ([], [], [], [])
    for k, (low, high) in enumerate(zip(some.column(8).to_pylist(), some.column(9).to_pylist())):
        for found in block.search(ids[k], marks[k], vecs[k], low, high, same, need):
            for column, value in zip(out, (k, *found)):
                column.append(value)
    return pa.RecordBatch.from_arrays(
        [some.column(3).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
         pa.array(out[3], some.schema.field(3).type)], ["anchor", "window", "score", "id"])


def hard_negatives(rows: DataFrame, row_id: str, label: str, vector: str, is_anchor: Column, positives: int = 5, negatives: int = 5,
                   part: int = 80, whole: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), by the rule below, exactly.

    A component x counts as floor(scale * x); a score is the integer inner product with
    the anchor; higher scores come first, ties by the smaller id.  An anchor's positives are the first
    ``positives`` other rows of its label.  For each of them the first ``negatives`` rows
    of other labels are returned with part * positive_score <= whole * negative_score <= whole * positive_score.

    Rows take no part whose id, label or vector is null, or whose vector holds a null or
    non-finite component; nor those whose length after scaling is 2^27 or more, for their
    scores could leave 64 bits.  A vector shorter than the longest, also an empty one, counts
    as filled up with zeros.  Rows equal in id, label and vector count once; of an id with several
    labels or vectors each row takes part, but never as a partner of its own id, and
    as an anchor the first of them in Spark's order.  Labels are compared by a 64-bit hash.
    Other columns are not read; without an anchor, or partners, there are no rows.
    """
    id_type = rows.schema[row_id].dataType.simpleString()
    spark = rows.sparkSession
    schema = f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score long, negative_score long"
    points = _points(_usable(rows, row_id, label, vector, scale), max(positives, negatives) + 1)
    n = points.count()
    if not n:
        return spark.createDataFrame([], schema)
    width, dtype = width_of(points, "vec"), _number(points)
    index, coded = _index(points, n, width, dtype)
    shared = Shipped(spark, index)

    def compact(batches):
        for batch in batches:
            vecs = matrix(batch.column(2), width, np.int64)
            codes, _ = shared.value.coded(vecs.astype(np.float64))
            home = shared.value.block[shared.value.cell_of(codes)]  # any block would do
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], to_bytes(vecs.astype(dtype)), pa.array(home, pa.int32())],
                                             ["id", "mark", "vec", "home"])

    asked = _usable(rows.where(is_anchor), row_id, label, vector, scale).groupBy("id").agg(F.min(F.struct("mark", "vec")).alias("own"))
    anchors = asked.select("id", "own.mark", "own.vec").mapInArrow(compact, f"id {id_type}, mark long, vec binary, home int")
    anchors = stage(anchors, "mining-anchors")
    every = anchors.select("*", F.array(F.lit(_LOW)).alias("low"), F.array(F.lit(_HIGH)).alias("high"))
    best = _searched(index, coded, every, True, positives, dtype)
    scores = best.groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("high"))  # at most ``positives``

    def least(p):
        """The least score that is ``part`` / ``whole`` of p or more; none if that is above p."""
        up = (p * part + F.pmod(-p * part, F.lit(whole))) / whole
        return F.when(p * part > p * whole, F.lit(_HIGH)).otherwise(up.cast("long"))

    windows = anchors.join(scores.withColumnRenamed("anchor", "id"), "id").withColumn("low", F.transform("high", least))
    found = _searched(index, coded, windows, False, negatives, dtype)
    wanted = best.join(scores, "anchor").select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"),
                                                (F.array_position("high", F.col("score")) - 1).cast("int").alias("window"))
    return wanted.join(found, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
