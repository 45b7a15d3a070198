"""Linear classifiers over sparse rows, fitted to convergence.

Rows are held as blocks of sparse numpy arrays in a persisted RDD.  One job evaluates loss and gradient of all problems
that are being fitted (classes, folds) at their own trial points.  A task hands on only those blocks of columns that its
rows touch, and they are added up in a tree, so the driver receives one gradient, not one per task.  Weights of columns
without any entry stay zero and are never sent."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.sql import DataFrame

COLUMN_BLOCK = 4096
ROWS_PER_TASK = 1000
TASKS_PER_CORE = 2
CHUNK_ENTRIES = 200_000

#: (margins of some rows, their labels, their folds) -> (loss per problem, derivative of the loss by each margin)
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class Chunk:
    """Some rows, by column, so that an entry is 12 bytes: every job has Spark hand all of them to Python again.  The last column
    of all is the intercept's, 1 in every row."""

    label: np.ndarray
    fold: np.ndarray
    columns: np.ndarray  # the distinct columns
    column_begins: np.ndarray  # first entry of each, and the end
    row: np.ndarray  # row of each entry, in order of the column
    value: np.ndarray

    @staticmethod
    def of(rows: Sequence[tuple[int, int, np.ndarray, np.ndarray]], columns: np.ndarray) -> Chunk:
        sizes = np.asarray([len(r[2]) + 1 for r in rows])
        column = np.concatenate([np.append(np.searchsorted(columns, r[2]), len(columns)) for r in rows])
        by_column = np.argsort(column, kind="stable")
        distinct, column_begins = np.unique(column[by_column], return_index=True)
        return Chunk(
            np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows]), distinct, np.append(column_begins, len(column)),
            np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[by_column], np.concatenate([np.append(r[3], 1.0) for r in rows])[by_column])

    def margins(self, weights: np.ndarray) -> np.ndarray:
        sizes, row = np.diff(self.column_begins), self.row.astype(np.intp)
        return np.stack([
            np.bincount(row, self.value * np.repeat(w, sizes), len(self.label)) for w in np.ascontiguousarray(weights[self.columns].T)], axis=1)

    def add_gradient(self, by_margin: np.ndarray, to: np.ndarray) -> None:
        for k, d in enumerate(np.ascontiguousarray(by_margin.T)):
            to[self.columns, k] += np.add.reduceat(self.value * d.take(self.row), self.column_begins[:-1])


class SparseRows:
    """Labelled sparse rows (label number, fold, feature vector) ready for fitting; ``close`` gives their storage back."""

    def __init__(self, rows: DataFrame, width: int):
        """``rows``: columns y (label number), fold, features (a sparse vector)."""
        self.width, self.context = width, rows.sparkSession.sparkContext
        plain = rows.select("y", "fold", "features").rdd.map(lambda r: (int(r[0]), int(r[1]), *_entries(r[2]))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = plain.mapPartitions(lambda part: _touched(part, width)).treeReduce(_union)
            self.columns, self.count = found[0], found[1]
            known = self.context.broadcast(self.columns)  # at most ``width`` numbers

            def chunks(part: Iterable) -> Iterator[Chunk]:
                held, entries = [], 0
                for r in part:
                    held.append(r)
                    entries += len(r[2]) + 1
                    if entries >= CHUNK_ENTRIES:
                        yield Chunk.of(held, known.value)
                        held, entries = [], 0
                if held:
                    yield Chunk.of(held, known.value)

            # Every task of a job sends a gradient on, so there are no more of them than keep the cores busy.
            most = TASKS_PER_CORE * self.context.defaultParallelism
            parts = max(1, min(plain.getNumPartitions(), -(-self.count // ROWS_PER_TASK), most))
            self.chunks: RDD = plain.coalesce(parts).mapPartitions(chunks).persist(StorageLevel.MEMORY_AND_DISK)
            sums = self.chunks.map(_class_counts).treeReduce(_padded_sum)
            self.per_fold = sums  # rows by fold and label
        finally:
            plain.unpersist()

    def close(self) -> None:
        self.chunks.unpersist()

    def evaluate(self, weights: np.ndarray, loss: Loss) -> tuple[np.ndarray, np.ndarray]:
        """(loss of every problem, gradient), summed over all rows; ``weights``: touched columns and intercept x problems."""
        sent = self.context.broadcast(weights)
        problems = weights.shape[1]

        def part(chunks: Iterable[Chunk]) -> Iterator[tuple[np.ndarray, dict[int, np.ndarray]]]:
            total, gradient, seen = 0.0, np.zeros_like(sent.value), set()
            for c in chunks:
                value, by_margin = loss(c.margins(sent.value), c.label, c.fold)
                total = total + value
                c.add_gradient(by_margin, gradient)
                seen.update(np.unique(c.columns // COLUMN_BLOCK).tolist())
            if seen:
                yield total, {b: gradient[b * COLUMN_BLOCK : (b + 1) * COLUMN_BLOCK] for b in seen}

        try:
            total, blocks = self.chunks.mapPartitions(part).treeReduce(_added)
        finally:
            sent.destroy()
        gradient = np.zeros((len(self.columns) + 1, problems))
        for b, g in blocks.items():
            gradient[b * COLUMN_BLOCK : b * COLUMN_BLOCK + len(g)] = g
        return np.asarray(total), gradient

    def spread(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients, problems x width; intercepts) of weights of touched columns."""
        full = np.zeros((weights.shape[1], self.width))
        full[:, self.columns] = weights[:-1].T
        return full, weights[-1].copy()


def _entries(v) -> tuple[np.ndarray, np.ndarray]:
    if hasattr(v, "indices"):
        return np.asarray(v.indices, np.int64), np.asarray(v.values, float)
    dense = np.asarray(v.toArray())
    at = np.flatnonzero(dense)
    return at.astype(np.int64), dense[at]


def _touched(rows: Iterable, width: int) -> Iterator[tuple[np.ndarray, int]]:
    found, n = np.zeros(width, bool), 0
    for r in rows:
        found[r[2]] = True
        n += 1
    yield np.flatnonzero(found), n


def _union(a: tuple, b: tuple) -> tuple:
    return np.union1d(a[0], b[0]), a[1] + b[1]


def _class_counts(c: Chunk) -> np.ndarray:
    out = np.zeros((int(c.fold.max()) + 1, int(c.label.max()) + 1))
    np.add.at(out, (c.fold, c.label), 1)
    return out


def _padded_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(np.maximum(a.shape, b.shape))
    out[: a.shape[0], : a.shape[1]] += a
    out[: b.shape[0], : b.shape[1]] += b
    return out


def _added(a: tuple, b: tuple) -> tuple:
    blocks = dict(a[1])
    for k, v in b[1].items():
        blocks[k] = blocks[k] + v if k in blocks else v
    return a[0] + b[0], blocks


# --- optimiser ---------------------------------------------------------------------------------------

def _minimise(start: np.ndarray, tolerance: float, most: int, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, int]]:
    """L-BFGS with backtracking as a coroutine: yields trial points, is sent (value, gradient), returns the point and the
    number of iterations.  Ends when no derivative exceeds ``tolerance`` times the first one (or 1)."""
    x = start
    value, slope = yield x
    limit = tolerance * max(1.0, float(np.abs(slope).max(initial=0.0)))
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for n in range(most):
        if np.abs(slope).max(initial=0.0) <= limit:
            return x, n
        direction, taken = slope.copy(), []
        for s, y, r in reversed(pairs):
            a = r * np.vdot(s, direction)
            direction -= a * y
            taken.append(a)
        if pairs:
            s, y, _ = pairs[-1]
            direction *= np.vdot(s, y) / np.vdot(y, y)
        else:
            direction /= max(1.0, float(np.linalg.norm(slope)))
        for (s, y, r), a in zip(pairs, reversed(taken)):
            direction += (a - r * np.vdot(y, direction)) * s
        fall, step = np.vdot(slope, direction), 1.0
        for _ in range(40):
            trial = x - step * direction
            new_value, new_slope = yield trial
            if new_value <= value - 1e-4 * step * fall:
                break
            step /= 2
        else:
            return x, n  # no progress within the precision of the sums
        s, y = trial - x, new_slope - slope
        if (curve := np.vdot(s, y)) > 1e-12 * np.vdot(y, y):
            pairs = [*pairs[1 - memory :], (s, y, 1.0 / curve)]
        x, value, slope = trial, new_value, new_slope
    return x, most


def _fit(rows: SparseRows, widths: Sequence[int], loss_of: Callable[[list[int]], Loss], penalised_intercept: bool, tolerance: float, most: int) -> tuple[list[np.ndarray], list[int]]:
    """Fit problems of ``widths`` columns of weights each, all of those not yet done in every job."""
    size = len(rows.columns) + 1
    running = [_minimise(np.zeros((size, w)), tolerance, most) for w in widths]
    asked = {i: next(g) for i, g in enumerate(running)}
    done: dict[int, tuple[np.ndarray, int]] = {}
    while asked:
        order = sorted(asked)
        total, gradient = rows.evaluate(np.hstack([asked[i] for i in order]), loss_of(order))
        at = 0
        for k, i in enumerate(order):
            x, own = asked[i], gradient[:, at : at + widths[i]]
            at += widths[i]
            held = x if penalised_intercept else np.vstack([x[:-1], np.zeros((1, x.shape[1]))])
            try:
                asked[i] = running[i].send((float(total[k]) + 0.5 * float(np.vdot(held, held)), own + held))
            except StopIteration as end:
                done[i] = end.value
                del asked[i]
    return [done[i][0] for i in range(len(widths))], [done[i][1] for i in range(len(widths))]


# --- models ------------------------------------------------------------------------------------------

def balanced(counts: np.ndarray) -> np.ndarray:
    """n / (k * n_label) per label, 0 for labels without rows; k counts those with rows."""
    return np.where(counts > 0, counts.sum() / np.maximum((counts > 0).sum() * counts, 1e-300), 0.0)


def fit_softmax(rows: SparseRows, classes: int, tolerance: float = 1e-4, most: int = 1000) -> tuple[np.ndarray, np.ndarray, int]:
    """(coefficients, intercepts, iterations) of a balanced multinomial logistic model: weighted log losses plus half the
    squared coefficients; intercepts are free."""
    counts = np.zeros(classes)
    found = rows.per_fold.sum(axis=0)
    counts[: len(found)] = found
    weight = balanced(counts)

    def loss(margins: np.ndarray, label: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = margins.max(axis=1, keepdims=True)
        e = np.exp(margins - top)
        total = e.sum(axis=1, keepdims=True)
        here, w = np.arange(len(label)), weight[label]
        p = e / total
        value = np.vdot(w, (top + np.log(total))[:, 0] - margins[here, label])
        p[here, label] -= 1.0
        return np.asarray([value]), w[:, None] * p

    (weights,), (n,) = _fit(rows, [classes], lambda order: loss, False, tolerance, most)
    return (*rows.spread(weights), n)


def fit_margins(rows: SparseRows, folds: int, classes: int, tolerance: float = 1e-4, most: int = 2000) -> tuple[np.ndarray, list[int]]:
    """Weights (touched columns and intercept x folds * classes, fold by fold) of one squared-hinge classifier per fold and
    class, which does not see the rows of its fold.

    Rows of the class have the balanced weight of their label, others 1; half the squared weights, the intercept's
    included, are added."""
    counts = np.zeros((folds, classes))
    counts[: rows.per_fold.shape[0], : rows.per_fold.shape[1]] = rows.per_fold
    weight = np.asarray([balanced(counts.sum(axis=0) - counts[f]) for f in range(folds)])

    def loss_of(order: list[int]) -> Loss:
        out_of, of = np.asarray(order) // classes, np.asarray(order) % classes

        def loss(margins: np.ndarray, label: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = label[:, None] == of
            w = np.where(own, weight[out_of, of], 1.0) * (fold[:, None] != out_of)
            sign = np.where(own, 1.0, -1.0)
            short = np.maximum(1.0 - sign * margins, 0.0)
            return (w * short * short).sum(axis=0), -2.0 * w * sign * short

        return loss

    weights, steps = _fit(rows, [1] * (folds * classes), loss_of, True, tolerance, most)
    return np.hstack(weights), steps


def fit_sigmoids(rows: SparseRows, weights: np.ndarray, folds: int, classes: int, most: int = 100) -> np.ndarray:
    """(folds * classes) x 2: slope and offset of the logistic curve of each margin, fitted on the rows of its fold only.

    Targets are drawn in by the numbers of rows in and out of the class, so separable margins have finite curves.
    Newton steps; every one sums six numbers per curve."""
    sent = rows.context.broadcast(weights)
    margins = rows.chunks.map(lambda c: (_held_out(c.margins(sent.value), c.fold, classes), c.label, c.fold)).persist(StorageLevel.MEMORY_AND_DISK)
    counts = np.zeros((folds, classes))
    counts[: rows.per_fold.shape[0], : rows.per_fold.shape[1]] = rows.per_fold
    inside = counts
    outside = counts.sum(axis=1, keepdims=True) - counts
    high, low = (inside + 1.0) / (inside + 2.0), 1.0 / (outside + 2.0)
    curve = np.stack([np.zeros((folds, classes)), np.log((inside + 1.0) / (outside + 1.0))], axis=-1)

    def sums(at: np.ndarray) -> np.ndarray:
        def one(part: tuple) -> np.ndarray:
            f, label, fold = part
            a, b = at[fold, :, 0], at[fold, :, 1]
            z = a * f + b
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
            t = np.where(label[:, None] == np.arange(classes), high[fold], low[fold])
            q = p * (1.0 - p)
            value = np.logaddexp(0.0, z) - t * z
            each = np.stack([value, (p - t) * f, p - t, q * f * f, q * f, q], axis=-1)
            out = np.zeros((folds, classes, 6))
            np.add.at(out, fold, each)
            return out

        return margins.map(one).treeReduce(np.add)

    try:
        now = sums(curve)
        for _ in range(most):
            _, g1, g2, h11, h12, h22 = np.moveaxis(now, -1, 0)
            h11, h22 = h11 + 1e-12, h22 + 1e-12
            det = h11 * h22 - h12 * h12
            step = np.stack([(h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det], axis=-1)
            going = np.maximum(np.abs(g1), np.abs(g2)) > 1e-7 * (1.0 + counts.sum(axis=1, keepdims=True))
            if not going.any():
                break
            scale = np.where(going, 1.0, 0.0)
            for _ in range(30):
                trial = curve - scale[..., None] * step
                new = sums(trial)
                worse = (new[..., 0] > now[..., 0] + 1e-12) & (scale > 0)
                if not worse.any():
                    break
                scale = np.where(worse, scale / 2, scale)
            else:
                break
            curve, now = trial, new
    finally:
        margins.unpersist()
        sent.destroy()
    return curve.reshape(folds * classes, 2)


def _held_out(margins: np.ndarray, fold: np.ndarray, classes: int) -> np.ndarray:
    """Of all margins of each row those of the classifiers that have not seen its fold."""
    return margins.reshape(len(fold), -1, classes)[np.arange(len(fold)), fold]


def margin_model(context: SparkContext, coefficients: np.ndarray, intercepts: np.ndarray):
    """A Spark ML model whose rawPrediction holds one margin per row of ``coefficients``: scoring stays in the JVM."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import DenseMatrix, Vectors

    n, width = coefficients.shape
    java = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "grade_margins", _py2java(context, DenseMatrix(n, width, coefficients.ravel(order="F"))), _py2java(context, Vectors.dense(intercepts)), n, True)
    return LogisticRegressionModel(java)
