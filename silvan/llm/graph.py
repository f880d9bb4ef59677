"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Links that one task connects by itself.
LOCAL = 1 << 18


def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of the nodes of all links (a, b): the smallest node that it is connected with."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        end = x
        while (up := top.setdefault(end, end)) != end:
            end = up
        while x != end:
            top[x], x = end, top[x]
        return end

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    nodes = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "to"])


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node that it is connected with.

    While there are more than `local` links, each round points every node at its smallest neighbour (or itself) and at what
    that one points at, then replaces the ends of all links by what they point at. Links within a node go, so the graph
    shrinks with each round; the smallest node of a component always stays. The links that are left are connected by one
    task. Each round is written to the shared folder, and only the number of links comes to the driver.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while (many := edges.count()) > local:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        low = cut(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")))
        further = low.select(F.col("node").alias("mid"), F.col("to").alias("last"))
        step = cut(low.join(further, F.col("to") == F.col("mid")).select("node", F.col("last").alias("to")))
        of = lambda end: step.select(F.col("node").alias(f"{end}_node"), F.col("to").alias(f"{end}_to"))  # noqa: E731,B023
        moved = edges.join(of("a"), F.col("a") == F.col("a_node")).join(of("b"), F.col("b") == F.col("b_node"))
        fewer = cut(moved.where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        after = _moved(found, step)
        drop(edges, found, low, step)
        edges, found = fewer, after
    if many or found is None:
        step = edges.select("a", "b").coalesce(1).mapInArrow(connected, "node long, to long")
        after = _moved(found, step)
        drop(found)
        found = after
    drop(edges)
    return found


def _moved(found: DataFrame | None, step: DataFrame) -> DataFrame:
    """What found's components, or at first the nodes themselves, point at."""
    if found is None:
        return cut(step.select("node", F.col("to").alias("component")))
    to = step.select(F.col("node").alias("step_node"), F.col("to").alias("step_to"))
    return cut(found.join(to, F.col("component") == F.col("step_node"), "left").select("node", F.coalesce("step_to", "component").alias("component")))
