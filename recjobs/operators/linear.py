"""Learned weights ``(src_id, dst_id, weight)``: one small model per target, from Gram tables.

Neighbour tables ``(i, j)`` say which features j a target i may use. A target's system is gathered by
its pairs of features and solved in one group, so a group is as large as the square of its features:
bound them by a k cut (``similarity.nearest``, ``strongest``). Empty tables give no weights; ratings
must be unique per user and item, without nulls (``prep.max_per_pair`` makes them so).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recjobs.functions.columns import best, rounded
from recjobs.functions.kernels import enet_gram, logistic_terms, ragged, squared_hinge_terms
from recjobs.functions.storage import materialize
from recjobs.operators import pairs
from recjobs.operators.similarity import weights_to_neighbours

STACK_BYTES = 32 << 20  # of targets' blocks solved at a time
USERS_A_PART = 4096  # of a target's users in one task of scm
WEIGHTS = "src_id long, dst_id long, weight double"


def gram(ratings: DataFrame) -> DataFrame:
    """``(i, j, g)``: sums of products of rating columns over users, the diagonal included. Tasks add up the
    rows of some items each (``pairs``); what isn't materialized is added up in every reading."""
    return pairs.gram(ratings)


def gram_added(gram_table: DataFrame, ratings: DataFrame, added: DataFrame) -> DataFrame:
    """The Gram table after new cells (``added``, none of them in ``ratings``): only these meet profiles,
    so the rows joined are the cells added times the profiles that they are added to."""
    x = added.select("user_id", F.col("item_id").alias("i"), F.col("rating").alias("ri"))
    y = lambda df: df.select("user_id", F.col("item_id").alias("j"), F.col("rating").alias("rj"))
    product = (F.col("ri") * F.col("rj")).alias("g")
    old, new = (x.join(y(df), "user_id").select("i", "j", product) for df in (ratings, added))
    every = gram_table.unionByName(new).unionByName(old).unionByName(old.select(F.col("j").alias("i"), F.col("i").alias("j"), "g"))
    return every.groupBy("i", "j").agg(F.sum("g").alias("g"))


def corated(gram_table: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Features of a target: all items rated together with it."""
    pairs = gram_table.filter("i <> j and g > 0").select("i", "j")
    return pairs if targets is None else pairs.join(targets.select(F.col("item_id").alias("i")), "i", "left_semi")


def strongest(gram_table: DataFrame, k: int) -> DataFrame:
    """Of the items rated together with a target the k of largest Gram entry (ties to the smaller id)."""
    return best(gram_table.filter("i <> j and g > 0"), "i", "g", "j", k).select("i", "j", "rank")


def popular_targets(popularity: DataFrame, items: DataFrame, k_top: int) -> DataFrame:
    """The k_top most popular active items; fewer if there are not so many."""
    active = popularity.join(items.filter("active"), "item_id", "left_semi")
    return active.orderBy("rank").limit(k_top).select("item_id")


def one_feature_ridge(neighbours: DataFrame, gram_table: DataFrame, alpha: float) -> DataFrame:
    """The closed form for one neighbour a target: g / (G + alpha). A target without neighbours has none."""
    one = neighbours.filter("rank = 1").select(F.col("i").alias("dst_id"), F.col("j").alias("src_id"))
    cross = gram_table.select(F.col("i").alias("dst_id"), F.col("j").alias("src_id"), F.col("g").alias("cross"))
    own = gram_table.filter("i = j").select(F.col("i").alias("src_id"), F.col("g").alias("own"))
    joined = one.join(cross, ["dst_id", "src_id"]).join(own, "src_id")
    return joined.select("src_id", "dst_id", rounded(F.col("cross") / (F.col("own") + F.lit(float(alpha)))).alias("weight")).filter("weight > 0")


def _systems(neighbours: DataFrame, gram_table: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """``(t, i, j, g)``: the lower half of the block of each target's neighbours; j = null rows hold the
    right side, ``right(t, i, g)`` or the Gram entry of feature and target.

    A target's features are paired first, so Gram entries that no target needs are met by no row."""
    own = neighbours.filter("i <> j").select(F.col("i").alias("t"), F.col("j").alias("f")).distinct()
    pairs = own.select("t", F.col("f").alias("i")).join(own.select("t", F.col("f").alias("j")), "t").filter("i >= j")
    block = pairs.join(gram_table, ["i", "j"]).select("t", "i", "j", "g")
    if right is None:
        right = gram_table.select(F.col("i").alias("t"), F.col("j").alias("i"), "g")
    side = own.select("t", F.col("f").alias("i")).join(right, ["t", "i"], "left").select("t", "i", F.lit(None).cast("long").alias("j"), F.coalesce("g", F.lit(0.0)).alias("g"))
    return block.unionByName(side)


Stack = Callable[[np.ndarray, np.ndarray], np.ndarray]  # (m, k, k) blocks, (m, k) right sides -> (m, k)


def _each(solver: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Stack:
    return lambda g, c: np.stack([solver(*x) for x in zip(g, c)])


def _ridge(alpha: float) -> Stack:
    return lambda g, c: np.linalg.solve(g + alpha * np.eye(g.shape[1]), c[:, :, None])[:, :, 0]


def _solve(systems: DataFrame, solver: Stack, positive: bool = True) -> DataFrame:
    """Targets are gathered as arrays, and those of a batch with equally many features are solved as one
    stack (STACK_BYTES of blocks at a time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets = np.array(batch.column(0))
            cut = batch.column(1).offsets.to_numpy().astype(np.int64)
            i, g = (np.array(batch.column(c).flatten()) for c in (1, 3))
            j = batch.column(2).flatten()
            side, j = np.array(j.is_null()), np.array(j.fill_null(0))
            of = np.repeat(np.arange(len(targets)), np.diff(cut))
            names = np.unique(i)
            code = lambda t, x: t * len(names) + np.searchsorted(names, x)
            order = np.argsort(code(of[side], i[side]))
            feature, right, owner = code(of[side], i[side])[order], g[side][order], of[side][order]
            first = np.searchsorted(owner, np.arange(len(targets) + 1))
            block = ~side
            place = [np.searchsorted(feature, code(of[block], x[block])) - first[of[block]] for x in (i, j)]
            entry = np.searchsorted(of[block], np.arange(len(targets) + 1))
            k = np.diff(first)
            for size in np.unique(k).tolist():
                some = np.flatnonzero(k == size)
                step = max(1, STACK_BYTES // (8 * size * size))
                for part in (some[x : x + step] for x in range(0, len(some), step)):
                    blocks = np.zeros((len(part), size, size))
                    at = ragged(entry[part], entry[part + 1] - entry[part])
                    n = np.repeat(np.arange(len(part)), entry[part + 1] - entry[part])
                    rows, columns, values = place[0][at], place[1][at], g[block][at]
                    blocks[n, rows, columns] = blocks[n, columns, rows] = values
                    own = first[part][:, None] + np.arange(size)
                    w = solver(blocks, right[own])
                    keep = w > 0 if positive else w != 0
                    yield pa.RecordBatch.from_arrays([pa.array(names[feature[own] % len(names)][keep]), pa.array(np.broadcast_to(targets[part][:, None], w.shape)[keep]), pa.array(w[keep])], ["src_id", "dst_id", "weight"])

    gathered = systems.groupBy("t").agg(F.collect_list(F.struct("i", "j", "g")).alias("x"))  # k x k of a target
    return gathered.select("t", "x.i", "x.j", "x.g").mapInArrow(run, WEIGHTS)


def slim_ridge(neighbours: DataFrame, gram_table: DataFrame, alpha: float, positive: bool = True) -> DataFrame:
    """Regress each target's column on its neighbours'; weights > 0 stay."""
    return _solve(_systems(neighbours, gram_table), _ridge(alpha), positive)


def slim_elastic_net(neighbours: DataFrame, gram_table: DataFrame, n_users: int, l1: float, l2: float, positive: bool = True) -> DataFrame:
    """Penalties l1 and l2: strength l1 + l2, ratio l1 / (l1 + l2)."""
    return _solve(_systems(neighbours, gram_table), _each(lambda g, c: enet_gram(g, c, n_users, l1 + l2, l1 / (l1 + l2), positive)))


def slim_lasso(neighbours: DataFrame, gram_table: DataFrame, n_users: int, alpha: float) -> DataFrame:
    """Penalty alpha |w|_1 alone; weights > 0 stay."""
    return _solve(_systems(neighbours, gram_table), _each(lambda g, c: enet_gram(g, c, n_users, alpha, 1.0, False)))


def slim_ridge_of(neighbours: DataFrame, ratings: DataFrame | pairs.Profiles, alpha: float, positive: bool = True) -> DataFrame:
    """``slim_ridge`` from the ratings: systems are added up in tasks, so no Gram table is made."""
    return pairs.fitted(neighbours, ratings, _ridge(alpha), positive)


def one_feature_ridge_of(neighbours: DataFrame, ratings: DataFrame | pairs.Profiles, alpha: float) -> DataFrame:
    """``one_feature_ridge`` from the ratings."""
    found = pairs.fitted(neighbours.filter("rank = 1"), ratings, lambda g, c: c / (g[:, :, 0] + alpha))
    return found.withColumn("weight", rounded(F.col("weight"))).filter("weight > 0")


def user_slim(ratings: DataFrame, alpha: float, k: int | None = None) -> DataFrame:
    """Weights between users: the roles swapped. Features are the k users of largest Gram entry, or all
    that share an item (small tables)."""
    swapped = ratings.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "rating")
    table = gram(swapped)
    table = materialize(table, "gram")
    return slim_ridge(corated(table) if k is None else strongest(table, k), table, alpha)


def scm_ridge(neighbours: DataFrame, ratings: DataFrame, gram_table: DataFrame, alpha: float) -> DataFrame:
    """Ridge classifier "rated or not": X'y = 2 * (sum over the target's raters) - column sum."""
    targets = ratings.select("user_id", F.col("item_id").alias("t"))
    together = targets.join(ratings.select("user_id", F.col("item_id").alias("i"), "rating"), "user_id").groupBy("t", "i").agg(F.sum("rating").alias("both"))
    total = ratings.groupBy(F.col("item_id").alias("i")).agg(F.sum("rating").alias("total"))
    right = neighbours.select(F.col("i").alias("t"), F.col("j").alias("i")).join(together, ["t", "i"], "left").join(total, "i").select("t", "i", (2 * F.coalesce("both", F.lit(0.0)) - F.col("total")).alias("g"))
    return _solve(_systems(neighbours, gram_table, right), _ridge(alpha))


def scm(neighbours: DataFrame, ratings: DataFrame, kind: str, c: float) -> DataFrame:
    """Logistic or squared-hinge classifiers. Users without any of a target's features only add a
    constant to its loss (there is no intercept), so they are not sent; a target that all or none of
    its users rated has no model.

    Newton rounds over all targets at once: a task meets one part of a target's users, and what is
    gathered for a target is its k x k Hessian, k being its features."""
    terms, factor, steps = {"logistic": (logistic_terms, 1.0, 50), "svm": (squared_hinge_terms, 2.0, 100)}[kind]
    own = neighbours.select(F.col("i").alias("t"), F.col("j").alias("item_id")).distinct()
    cells = own.join(ratings, "item_id").select("t", "user_id", "item_id", "rating")
    raters = ratings.select(F.col("item_id").alias("t"), "user_id", F.lit(1).alias("rated"))
    rows = materialize(cells.join(raters, ["t", "user_id"], "left").fillna(0, ["rated"]), "cells")
    fitted = rows.groupBy("t").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.min("rated").alias("least"), F.max("rated").alias("most")).filter("least < most")
    n_parts = 1 + ratings.select("user_id").distinct().count() // USERS_A_PART
    cell = F.collect_list(F.struct("user_id", "item_id", "rating", "rated"))
    parts = rows.groupBy("t", F.pmod(F.xxhash64("user_id"), F.lit(n_parts)).alias("part")).agg(cell.alias("cell"))
    parts = materialize(parts.select("t", *(F.col("cell")[x].alias(x) for x in ("user_id", "item_id", "rating", "rated"))), "parts")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                users, at = np.unique(r.user_id, return_inverse=True)
                x, sign = np.zeros((len(users), len(r.items))), np.full(len(users), -1.0)
                x[at, np.searchsorted(r.items, r.item_id)] = r.rating
                sign[at[np.asarray(r.rated) == 1]] = 1.0
                loss, slope, bend = terms(sign * (x @ r.trial))
                used = np.flatnonzero(x.any(0))
                h = (x[:, used].T * bend) @ x[:, used]
                i, j = np.divmod(np.arange(h.size), max(len(used), 1))
                i, j = np.concatenate([[-1], used, used[i]]), np.concatenate([[-1], np.full(len(used), -1), used[j]])
                out.append((np.full(len(i), r.t), i, j, np.concatenate([[loss.sum()], x[:, used].T @ (sign * slope), h.ravel()])))
            if out:
                yield pd.DataFrame(dict(zip(("t", "i", "j", "v"), map(np.concatenate, zip(*out)))))

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [moved(r) for r in pdf.itertuples(index=False)]
            if rows:
                yield pd.DataFrame(rows, columns=["t", "items", "w", "trial", "step", "loss", "rate", "rounds", "done"])

    def moved(r) -> tuple:
        """A target's state after one trial, from the sums over its parts."""
        i, j, v, k = np.asarray(r.i), np.asarray(r.j), np.asarray(r.v), len(r.items)
        w, trial, step, rate, done = np.asarray(r.w), np.asarray(r.trial), np.asarray(r.step), r.rate, False
        total, rounds = 0.5 * trial @ trial + c * v[i < 0].sum(), r.rounds
        if rate > 1e-6 and total > r.loss + 1e-10 * abs(r.loss):  # too far, beyond rounding: half the step
            rate, loss = rate / 2, r.loss
        else:
            w, loss, rate, rounds, slope, bend = trial, total, 1.0, rounds + 1, np.zeros(k), np.zeros((k, k))
            side = (i >= 0) & (j < 0)
            slope[i[side]] = v[side]
            bend[i[j >= 0], j[j >= 0]] = v[j >= 0]
            gradient = w - factor * c * slope
            step = np.linalg.solve(np.eye(k) + factor * c * bend, gradient)
            done = bool(np.abs(step).max(initial=0) < 1e-8 or rounds > steps)
        return r.t, r.items, w, w - rate * step, step, float(loss), rate, rounds, done

    zero = F.transform("items", lambda x: F.lit(0.0))
    state = materialize(fitted.select("t", "items", zero.alias("w"), zero.alias("trial"), zero.alias("step"), F.lit(float("inf")).alias("loss"), F.lit(1.0).alias("rate"), F.lit(0).alias("rounds"), F.lit(False).alias("done")), "fits")
    found = state.limit(0)
    while not state.isEmpty():
        each = parts.join(state.select("t", "items", "trial"), "t").select("t", "user_id", "item_id", "rating", "rated", "items", "trial")
        sums = each.mapInPandas(measure, "t long, i long, j long, v double").groupBy("t", "i", "j").agg(F.sum("v").alias("v"))
        cells = sums.groupBy("t").agg(F.collect_list(F.struct("i", "j", "v")).alias("s")).select("t", "s.i", "s.j", "s.v")  # k x k of a target
        state = materialize(state.join(cells, "t").mapInPandas(move, state.schema), "fits")
        found, state = found.unionByName(state.filter("done")), state.filter("not done")
    weights = found.select(F.col("t").alias("dst_id"), F.explode(F.arrays_zip("items", "w")).alias("x"))
    return weights.select(F.col("x.items").alias("src_id"), "dst_id", F.col("x.w").alias("weight")).filter("weight > 0")


def refit(weights: DataFrame, table: DataFrame | pairs.Profiles, alpha: float, k: int, phases: int, fit: Callable[..., DataFrame] = slim_ridge) -> DataFrame:
    """Fit again on the k largest weights of the phase before, phase by phase; ``table`` is what ``fit``
    takes (a Gram table, or ratings for ``slim_ridge_of``)."""
    for _ in range(phases):
        weights = materialize(fit(weights_to_neighbours(weights, k), table, alpha), "weights")
    return weights
