"""Weights ``(src_id, dst_id, weight)`` of models whose features are all other items: no k cut.

All targets of a block are right-hand sides of one iteration, in which vectors go through the ratings
and back (X'Xw), so neither a Gram table nor a target's square system is made. The dense vectors of a
block never leave their task: a task holds a few arrays of items x targets, TASK_BYTES at most each, and
meets the ratings as a stream of row blocks that Spark has written to the shared folder (kept from step to
step if they are small). Blocks of targets are independent, so a lost executor costs the blocks it had.

Ratings must be unique per user and item, without nulls; an empty table gives no weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from recjobs.functions.kernels import logistic_terms, squared_hinge_terms
from recjobs.functions.storage import materialize, parquet_batches
from recjobs.operators.prep import dense_index

TASK_BYTES = 16 << 20  # of one array of items x targets
HELD_BYTES = 64 << 20  # of ratings that a task keeps; it reads more of them anew in each step
ROWS = 512  # profiles met at a time
DENSE_SHARE = 0.01  # of cells rated, from which on a block of rows is multiplied as a whole
TOLERANCE = 1e-9  # of a residual, relative to the right side
WEIGHTS = "src_id long, dst_id long, weight double"


class Rows:
    """Some users' rows of the rating matrix."""

    def __init__(self, first: np.ndarray, items: np.ndarray, values: np.ndarray, n: int):
        self.first, self.items, self.values, self.m = first, items, values, len(first) - 1
        self.row = np.repeat(np.arange(self.m), np.diff(first))
        self.dense = None
        if len(items) >= DENSE_SHARE * self.m * n:
            self.dense = np.zeros((self.m, n))
            self.dense[self.row, items] = values
        else:
            self.order = np.argsort(items, kind="stable")
            self.met, self.at = np.unique(items[self.order], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ w
        return np.add.reduceat(w[self.items] * self.values[:, None], self.first[:-1], axis=0)

    def add_back(self, z: np.ndarray, out: np.ndarray) -> None:
        """out += X'z"""
        if self.dense is not None:
            out += self.dense.T @ z
        else:
            out[self.met] += np.add.reduceat(z[self.row[self.order]] * self.values[self.order][:, None], self.at, axis=0)

    def columns(self, place: np.ndarray, t: int) -> np.ndarray:
        """The columns of t items; ``place[i]`` is item i's column among them, or -1."""
        out, own = np.zeros((self.m, t)), place[self.items] >= 0
        out[self.row[own], place[self.items[own]]] = self.values[own]
        return out


class RowBlocks:
    """All rating rows, block by block, from the files that Spark wrote."""

    def __init__(self, files: list[str], n: int):
        self.files, self.n, self.held = files, n, None

    def _read(self) -> Iterator[Rows]:
        for batch in parquet_batches(self.files, ROWS):
            items, values = batch.column(0), batch.column(1)
            first = items.offsets.to_numpy().astype(np.int64)
            yield Rows(first - first[0], items.flatten().to_numpy(), values.flatten().to_numpy(), self.n)

    def __iter__(self) -> Iterator[Rows]:
        if self.held is not None:
            yield from self.held
            return
        kept, size = [], 0
        for rows in self._read():
            size += (24 * len(rows.items)) if rows.dense is None else rows.dense.nbytes
            kept = [*kept, rows] if kept is not None and size <= HELD_BYTES else None
            yield rows
        self.held = kept

    def gram_times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros_like(w)
        for rows in self:
            rows.add_back(rows.times(w), out)
        return out

    def largest_eigenvalue(self) -> float:
        """Of X'X, by the power method, with a margin of 2 %."""
        v, value = np.full((self.n, 1), 1 / math.sqrt(self.n)), 0.0
        while True:
            u = self.gram_times(v)
            now = float(np.linalg.norm(u))
            if abs(now - value) <= 1e-4 * now:
                return 1.02 * now
            v, value = u / now, now


def conjugate_gradients(times: Callable[[np.ndarray], np.ndarray], right: np.ndarray) -> np.ndarray:
    """Solve A w = right for all columns at once, A being symmetric and positive."""
    w, r = np.zeros_like(right), right.copy()
    p, size = r.copy(), (r * r).sum(0)
    enough = TOLERANCE**2 * size
    for _ in range(10 * len(right) + 100):
        open_ = size > enough
        if not open_.any():
            return w
        q = times(p)
        rate = np.where(open_, size / np.where(open_, (p * q).sum(0), 1.0), 0.0)
        w += rate * p
        r -= rate * q
        now = np.where(open_, (r * r).sum(0), size)
        p = r + np.where(open_, now / np.where(open_, size, 1.0), 0.0) * p
        size = now
    raise RuntimeError("conjugate gradients did not converge")


def accelerated(slope: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int], steep: float, l1: float = 0.0, positive: bool = False, tolerance: float = TOLERANCE, most: int = 20_000) -> np.ndarray:
    """Minimise f(w) + l1 |w| for all columns by proximal gradient steps with momentum, which starts anew
    in a column whose last step went against it. ``slope(w, columns)`` is f's, ``steep`` bounds its
    change; columns that have settled are left out of further steps."""
    w = np.zeros(shape)
    columns = np.arange(shape[1])
    now, ahead, t = w.copy(), w.copy(), np.ones(shape[1])
    scale = None
    for _ in range(most):
        g = slope(ahead, columns)
        if scale is None:
            scale = np.maximum(np.abs(g).max(0), 1e-300)  # the slope at 0
        step = ahead - g / steep
        step = np.maximum(step - l1 / steep, 0.0) if positive else np.sign(step) * np.maximum(np.abs(step) - l1 / steep, 0.0) if l1 else step
        moved = steep * np.abs(step - ahead).max(0)
        back = ((ahead - step) * (step - now)).sum(0) > 0
        after = np.where(back, 1.0, (1 + np.sqrt(1 + 4 * t * t)) / 2)
        ahead = step + np.where(back, 0.0, (t - 1) / after) * (step - now)
        now, t = step, after
        settled = moved <= tolerance * scale
        if settled.any():
            w[:, columns[settled]] = now[:, settled]
            columns, now, ahead, t, scale = columns[~settled], now[:, ~settled], ahead[:, ~settled], t[~settled], scale[~settled]
            if not len(columns):
                return w
    raise RuntimeError(f"{len(columns)} targets did not settle in {most} steps")


def _without_own(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A target is no feature of its own."""
    x[own, np.arange(len(own))] = 0.0
    return x


def _place(own: np.ndarray, n: int) -> np.ndarray:
    place = np.full(n, -1)
    place[own] = np.arange(len(own))
    return place


def _right(blocks: RowBlocks, own: np.ndarray, sign: bool = False) -> np.ndarray:
    """X'y of each target's column y; ``sign``: y is 1 if rated, else -1."""
    out, place = np.zeros((blocks.n, len(own))), _place(own, blocks.n)
    for rows in blocks:
        y = rows.columns(place, len(own))
        rows.add_back(np.where(y != 0, 1.0, -1.0) if sign else y, out)
    return _without_own(out, own)


Solver = Callable[[RowBlocks, np.ndarray], np.ndarray]


def ridge_solver(alpha: float, sign: bool = False) -> Solver:
    """|y - Xw|^2 + alpha |w|^2"""
    return lambda blocks, own: conjugate_gradients(lambda p: _without_own(blocks.gram_times(p) + alpha * p, own), _right(blocks, own, sign))


def elastic_net_solver(n_users: int, l1: float, l2: float, positive: bool) -> Solver:
    """|y - Xw|^2 / 2n + l1 |w|_1 + l2 |w|^2 / 2"""

    def solve(blocks: RowBlocks, own: np.ndarray) -> np.ndarray:
        right = _right(blocks, own)
        slope = lambda w, c: _without_own((blocks.gram_times(w) - right[:, c]) / n_users + l2 * w, own[c])
        return accelerated(slope, right.shape, blocks.largest_eigenvalue() / n_users + l2, l1, positive)

    return solve


def classifier_solver(kind: str, c: float) -> Solver:
    """|w|^2 / 2 + c times the sum of the losses "rated or not" over users."""
    terms, factor, bend = {"logistic": (logistic_terms, 1.0, 0.25), "svm": (squared_hinge_terms, 2.0, 1.0)}[kind]

    def solve(blocks: RowBlocks, own: np.ndarray) -> np.ndarray:
        def slope(w: np.ndarray, some: np.ndarray) -> np.ndarray:
            pull, place = np.zeros_like(w), _place(own[some], blocks.n)
            for rows in blocks:
                y = np.where(rows.columns(place, len(some)) != 0, 1.0, -1.0)
                rows.add_back(y * terms(y * rows.times(w))[1], pull)
            return _without_own(w - factor * c * pull, own[some])

        # the penalty bends every direction by 1, so weights are as near as the slope is to 0
        return accelerated(slope, (blocks.n, len(own)), 1 + c * factor * bend * blocks.largest_eigenvalue(), tolerance=1e-7)

    return solve


def fit_all(ratings: DataFrame, solver: Solver, targets: DataFrame | None = None, positive: bool = True) -> DataFrame:
    """Weights of all other items into each target (all rated items, unless ``targets(item_id)`` are
    given); ``positive``: weights above 0 stay, else all but 0. Targets that nobody rated have none."""
    index = materialize(dense_index(ratings.select("item_id").distinct(), "item_id").select("item_id", F.col("idx").cast("int").alias("idx")), "items")
    n = index.count()
    # a profile is at most as long as the catalogue, as is a column of the task's arrays
    cells = ratings.join(index, "item_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("rating").cast("double").alias("rating")))).alias("x"))
    profiles = materialize(cells.select("x.idx", "x.rating"), "profiles").inputFiles()
    numbers = index.inputFiles()

    asked = index if targets is None else index.join(targets.select("item_id").distinct(), "item_id", "left_semi")
    # blocks are bounded in bytes, and as many as tasks at least
    tasks = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_asked = asked.count()
    per_block = max(1, min(TASK_BYTES // max(8 * n, 1), -(-n_asked // tasks)))
    placed = dense_index(asked.select("idx").withColumnRenamed("idx", "own"), "own")
    blocks = placed.groupBy(F.floor(F.col("idx") / per_block).alias("block")).agg(F.sort_array(F.collect_list("own")).alias("own"))  # per_block at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, ids = None, np.zeros(n, np.int64)
        for pdf in batches:
            if rows is None and len(pdf):
                rows = RowBlocks(profiles, n)
                for batch in parquet_batches(numbers, 1 << 16):
                    ids[batch.column(1).to_numpy()] = batch.column(0).to_numpy()
            for own in pdf["own"]:
                w = solver(rows, np.asarray(own))
                i, j = np.nonzero(w > 0 if positive else w)
                yield pd.DataFrame({"src_id": ids[i], "dst_id": ids[np.asarray(own)[j]], "weight": w[i, j]})

    return blocks.repartition(max(1, -(-n_asked // per_block)), "block").select("own").mapInPandas(run, WEIGHTS)


def slim_ridge_all(ratings: DataFrame, alpha: float, targets: DataFrame | None = None, positive: bool = True) -> DataFrame:
    """Regress each target's column on all others."""
    return fit_all(ratings, ridge_solver(alpha), targets, positive)


def slim_elastic_net_all(ratings: DataFrame, l1: float, l2: float, targets: DataFrame | None = None) -> DataFrame:
    """Non-negative, penalties l1 and l2."""
    return fit_all(ratings, elastic_net_solver(ratings.select("user_id").distinct().count(), l1, l2, True), targets)


def slim_lasso_all(ratings: DataFrame, alpha: float, targets: DataFrame | None = None) -> DataFrame:
    """Penalty alpha |w|_1 alone; weights > 0 stay."""
    return fit_all(ratings, elastic_net_solver(ratings.select("user_id").distinct().count(), alpha, 0.0, False), targets)


def user_slim_all(ratings: DataFrame, alpha: float) -> DataFrame:
    """Weights between users: the roles swapped, all other users as features."""
    return slim_ridge_all(ratings.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "rating"), alpha)


def scm_all(ratings: DataFrame, kind: str, c: float, targets: DataFrame | None = None) -> DataFrame:
    """Classifiers "rated or not" by the ratings of all other items: ``kind`` ridge (c is its penalty),
    logistic or svm (squared hinge). A target that all users rated has no model."""
    n_users = ratings.select("user_id").distinct().count()
    two = ratings.groupBy("item_id").agg(F.count("*").alias("n")).filter(F.col("n") < n_users).select("item_id")
    targets = two if targets is None else targets.join(two, "item_id", "left_semi")
    return fit_all(ratings, ridge_solver(c, True) if kind == "ridge" else classifier_solver(kind, c), targets)
