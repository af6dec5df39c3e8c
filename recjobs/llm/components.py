"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recjobs.functions.storage import materialize

TASK_EDGES = 200_000  # that one task contracts at a time
HOT_SHARE = 5_000  # a key of more than this fraction of all rows is hot, so at most so many keys are


def hot_limit(n_rows: int) -> int:
    """Rows of one key from which on it is met by broadcast."""
    return max(2_000, n_rows // HOT_SHARE)


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], limit: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (a written one), which has one row a key and the count of its
    rows, ``n_rows``.

    Keys of more than ``limit`` rows (``hot_limit``: a bounded number of keys) travel to the rows, so
    that no task meets all rows of one of them; the other keys are joined by shuffle. Without such
    keys it is a plain join.
    """
    if table.filter(F.col("n_rows") > limit).isEmpty():
        return rows.join(table.drop("n_rows"), keys, how)
    hot = F.broadcast(table.filter(F.col("n_rows") > limit).drop("n_rows"))
    rest = rows.join(F.broadcast(table.filter(F.col("n_rows") > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(table.filter(F.col("n_rows") <= limit).drop("n_rows"), keys, how))


def _star(edges: DataFrame, small: bool, limit: int) -> DataFrame:
    """Hang each node's neighbours on its least neighbour: the larger ones, or it and the smaller ones.
    Written, so that plans stay short."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n_rows")), "least")
    joined = split_join(both, least, ["a"], limit)
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(moved.filter("a > b").distinct(), "edges")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the least node of each component among at most TASK_EDGES edges at a time."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while (up := parent.get(top, top)) != top:
            top = up
        while v != top:
            parent[v], v = top, parent.get(v, v)
        return top

    def hung() -> pa.RecordBatch:
        nodes = [v for v in parent if root(v) != v]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], ["a", "b"])

    n = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
            n += 1
            if n == TASK_EDGES:
                yield hung()
                parent, n = {}, 0
    yield hung()


def _settled(edges: DataFrame) -> bool:
    """Each node hangs on one node, which hangs on none."""
    hung = edges.groupBy("a").agg(F.count("*").alias("n"))
    top = edges.select(F.col("b").alias("a")).distinct()
    return hung.join(top.withColumn("top", F.lit(True)), "a", "left").filter("n > 1 or top").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` longs -> ``(node, component)``, the component being its least node.

    Self-loops and repeated edges are allowed, edges with a null end are left out; nodes without an
    edge to another node are not returned, so an empty table gives no rows. Tasks first contract what
    they hold, TASK_EDGES edges at a time, and at most so many that are left go to one task. Else
    rounds grow with the logarithm of the longest path; each round's table is written to the shared
    folder, and nothing of it reaches the driver. Nodes of very many edges are met by broadcast (``split_join``).
    """
    schema = "a long, b long"
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").mapInArrow(_forest, schema), "edges")
    for _ in range(max_rounds):
        n = now.count()
        if n <= TASK_EDGES:  # what is left fits one task
            now = materialize(now.coalesce(1).mapInArrow(_forest, schema), "edges")
            break
        if _settled(now):
            break
        now = _star(_star(now, False, hot_limit(n)), True, hot_limit(n))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
