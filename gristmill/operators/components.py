"""Connected components of an edge table by repeated contraction.

Every round each node hooks onto the smallest node next to it, chains of hooks are shortened by
pointer jumps, and the edges are rewritten to the new labels. Edges inside a component vanish, so a
hub with very many neighbours costs one round: its edges become loops and are dropped. The number of
rounds grows with the logarithm of the longest chain, since later rounds jump farther. A round writes its step and its edges; steps
are composed once, at the end. A caller may name a number of edges from which on one task finishes the
rest, which saves rounds of small jobs; the labels are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut, drop

JUMPS, LONGEST = 1, 12


def _follow(nodes: DataFrame, step: DataFrame, column: str) -> DataFrame:
    """``nodes`` with ``column`` moved on by a step; values without one stay."""
    on = step.select(F.col("node").alias(column), F.col("up").alias("_to"))
    return nodes.join(on, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def smallest_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 .. n - 1 the smallest node it can reach over edges a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        moved = root.copy()
        np.minimum.at(moved, root[a], low)
        np.minimum.at(moved, root[b], low)
        while (moved[moved] != moved).any():
            moved = moved[moved]
        if (moved == root).all():
            return root
        root = moved


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of the nodes of a bounded number of edges."""
    tables = [pa.Table.from_batches([batch]) for batch in batches if batch.num_rows]
    if tables:
        edges = pa.concat_tables(tables)
        coded = pa.concat_arrays([*edges.column(0).chunks, *edges.column(1).chunks]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        a, b = np.split(place[coded.indices.to_numpy()], 2)
        nodes = coded.dictionary.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(smallest_reachable(a, b, len(order))))], ["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = 0) -> DataFrame:
    """Map every node that has an edge to the smallest node it can reach: columns ``node``, ``root``.

    ``small``: so many different edges, or fewer, are finished in one task.

    Null ends and loops count for nothing. An empty edge table gives an empty result. The result is a
    table in the shared folder.
    """
    left, right = F.col(a), F.col(b)
    live = edges.where(left.isNotNull() & right.isNotNull() & (left != right))
    live = cut(live.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while left := live.count() if small else int(not live.isEmpty()):
        if left <= small:
            kind = dict(live.dtypes)["a"]
            steps.append(cut(live.coalesce(1).mapInArrow(_finished, f"node {kind}, root {kind}").withColumnRenamed("root", "up"), "step"))
            break
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        step = hook
        for _ in range(JUMPS):
            step = _follow(step, hook, "up")
        step = cut(step.select("node", "up"), "step")
        for _ in range(min(LONGEST, max(0, len(steps) - 3))):  # long chains of ascending nodes: each jump doubles the way
            step, short = cut(_follow(step, step, "up").select("node", "up"), "step"), step
            drop(short)
        steps.append(step)
        moved = _follow(_follow(live, step, "a"), step, "b").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        after = cut(moved.distinct(), "edges")
        drop(live)
        live = after
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = steps[0].select("node", F.col("up").alias("root"))
    if small and len(steps) == 1:
        drop(live)
        return labels
    for n, step in enumerate(steps[1:], 1):
        labels = _follow(labels, step, "root")
        if n % LONGEST == 0:
            labels = cut(labels.select("node", "root"), "labels")
    out = cut(labels.select("node", "root"), "labels")
    drop(live, *steps)
    return out
