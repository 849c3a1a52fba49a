"""Multinomial logistic regression over a table of sparse vectors of any size.

The rows are packed once into blocks of arrays, which the executors keep; every step is one
pass over the blocks, which adds up the loss and the gradient in a tree.  The driver holds
the coefficients and the last few steps.  The search is L-BFGS on the coefficients as they
are: Spark's own optimiser works on features scaled to unit variance, where the penalty of
a rare term is steep, and needs several times as many passes for the same objective.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

CELLS = 1 << 17  # numbers of the vectors that are worked on at a time, so that they stay in a core's cache
PAIRS = 10       # steps that the search remembers


def packed(vectors: DataFrame) -> RDD:
    """``vectors`` (features, target, weight) as blocks of arrays, one after the other in each partition."""
    at_once = CELLS

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            features = batch.column(0)
            indices, numbers = pc.struct_field(features, "indices"), pc.struct_field(features, "values")
            target, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            ends = np.r_[0, np.cumsum(pc.list_value_length(indices).to_numpy(zero_copy_only=False).astype(np.int64))]
            idx, value = (pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (indices, numbers))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + at_once, side="right")) - 1)
                some = slice(ends[at], ends[stop])
                block = (ends[at:stop + 1] - ends[at], idx[some], value[some], target[at:stop].astype(np.int32), weight[at:stop])
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])
                at = stop

    return vectors.select("features", "target", "weight").mapInArrow(run, "block binary").rdd.map(lambda r: bytes(r[0]))


def _loss(block: bytes, coefficients, intercepts, gradient) -> float:
    """The weighted loss of a block; its gradient is added to ``gradient``, a row for each class, the intercept last."""
    ends, idx, value, target, weight = pickle.loads(block)
    lengths = np.diff(ends)
    some = np.flatnonzero(lengths)
    scores = np.tile(intercepts, (len(target), 1))
    if len(some):
        for k, own in enumerate(coefficients):
            scores[some, k] += np.add.reduceat(own.take(idx) * value, ends[some])
    scores -= scores.max(1, keepdims=True)
    share = np.exp(scores)
    total = share.sum(1)
    row = np.arange(len(target))
    loss = float(weight @ (np.log(total) - scores[row, target]))
    share /= total[:, None]
    share[row, target] -= 1.0
    share *= weight[:, None]
    for k in range(len(gradient)):
        gradient[k, :-1] += np.bincount(idx, np.repeat(share[:, k], lengths) * value, gradient.shape[1] - 1)
    gradient[:, -1] += share.sum(0)
    return loss


def _added(blocks: RDD, theta: np.ndarray, depth: int) -> tuple[float, np.ndarray]:
    """Loss and gradient over all blocks."""
    at_hand = blocks.context.broadcast(theta)

    def run(part):
        theta = at_hand.value
        loss, gradient = 0.0, np.zeros(theta.shape)
        coefficients, intercepts = np.ascontiguousarray(theta[:, :-1]), theta[:, -1]
        for block in part:
            loss += _loss(block, coefficients, intercepts, gradient)
        yield loss, gradient

    try:
        return blocks.mapPartitions(run).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), depth)
    finally:
        at_hand.destroy()


def fit_softmax(vectors: DataFrame, n_terms: int, class_weights: np.ndarray, penalty: float, max_iter: int, tol: float,
                depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients by class and term, intercepts by class) that minimise the mean weighted loss + penalty * |coefficients|^2 / 2."""
    total = class_weights.sum()
    theta = np.zeros((len(class_weights), n_terms + 1))
    theta[:, -1] = np.log1p(class_weights)
    blocks = packed(vectors).persist(StorageLevel.MEMORY_AND_DISK)

    def measure(theta):
        loss, gradient = _added(blocks, theta, depth)
        gradient /= total
        gradient[:, :-1] += penalty * theta[:, :-1]
        return loss / total + penalty / 2 * float((theta[:, :-1] ** 2).sum()), gradient

    try:
        theta = minimised(measure, theta, max_iter, tol)
    finally:
        blocks.unpersist()
    # As with Spark's model: shifting all classes by the same amount changes no probability, so the mean is 0.
    return theta[:, :-1], theta[:, -1] - theta[:, -1].mean()


def minimised(measure: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS from ``theta``, for a convex function.

    It ends as Spark's does: when ten steps together gain less than ``tol`` of the first value, or the gradient is that small.
    """
    value, gradient = measure(theta)
    first, seen, steps = abs(value), [value], []
    for _ in range(max_iter):
        if np.sqrt((gradient ** 2).sum()) <= max(tol * abs(value), 1e-8):
            break
        way, parts = -gradient, []
        for step, turn, scale in reversed(steps):
            parts.append((step * way).sum() / scale)
            way = way - parts[-1] * turn
        if steps:
            _, turn, scale = steps[-1]
            way = way * (scale / (turn ** 2).sum())
        else:
            way = way / max(1.0, np.sqrt((way ** 2).sum()))
        for (step, turn, scale), part in zip(steps, reversed(parts)):
            way = way + (part - (turn * way).sum() / scale) * step
        slope, length = float((gradient * way).sum()), 1.0
        while True:
            after, its = measure(theta + length * way)
            if after <= value + 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        if not after < value:
            break
        step, turn = length * way, its - gradient
        scale = float((step * turn).sum())
        if scale > 0:
            steps = [*steps, (step, turn, scale)][-PAIRS:]
        theta, value, gradient = theta + step, after, its
        seen = [*seen, value][-11:]
        if len(seen) == 11 and seen[0] - value <= tol * first:
            break
    return theta
