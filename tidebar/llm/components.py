"""Connected components of a graph of links, as joins and aggregates."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.sources.scratch import drop, materialize


def _flatten(parent: DataFrame) -> DataFrame:
    """Follow parents to the root: the depth halves with each join. Parents are smaller than
    their children, so there is no cycle."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = materialize(parent.join(up, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"),
            (F.coalesce("above", "parent") != F.col("parent")).alias("moved")), "roots")
        moved = not step.filter("moved").isEmpty()
        drop(parent)
        parent = step.select("node", "parent")
        if not moved:
            return parent


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, parent)`` with the smallest node of the component as parent, of the links of one task."""
    above, kind = {}, None

    def root(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    if above:
        yield pa.record_batch([pa.array(list(above), kind), pa.array([root(x) for x in above], kind)], ["node", "parent"])


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the component's smallest node.

    Each round hooks every node under its smallest neighbour, flattens these trees by pointer
    jumping and contracts the graph to the roots. A root has a child at least, so the nodes halve
    each round. Neighbours are met by a min aggregate with map-side combine, so a hub is no hot
    group. Loops, repeated links and null ends are allowed and change nothing.

    A contracted graph of ``small`` links at most is finished by one task, which spares the rounds' many short jobs."""
    live = materialize(edges.filter("a <> b").select("a", "b").distinct(), "links")
    label = None
    while not live.isEmpty():
        last = small > 0 and live.count() <= small
        if last:
            kind = live.schema["a"].dataType.simpleString()
            parent = materialize(live.repartition(1).mapInArrow(_roots, f"node {kind}, parent {kind}"), "parents")
        else:
            ends = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            parent = _flatten(materialize(
                ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                .select("node", F.least("node", "least").alias("parent")), "parents"))
        if last and label is None:
            drop(live)
            return parent.select("node", F.col("parent").alias("root"))
        if label is None:
            fresh = materialize(parent.select("node", F.col("parent").alias("root")), "labels")
        else:
            up = parent.select(F.col("node").alias("root"), F.col("parent").alias("above"))
            fresh = materialize(label.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
            drop(label)
        label = fresh
        if last:
            drop(live, parent)
            return label
        left = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        shrunk = materialize(live.join(left, "a").join(right, "b").filter("pa <> pb")
                             .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "links")
        drop(live, parent)
        live = shrunk
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label
