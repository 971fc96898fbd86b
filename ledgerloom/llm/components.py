"""Connected components of an edge table by contraction in partitions and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def contracted(edges: DataFrame) -> DataFrame:
    """Stars (a, b, own, open) with the components of every partition of edges (a, b, open).

    A node of the partition's edges as `a` has its star edge as its own; open are the edges
    that are not and those of a component with an open one. Changes no partitioning.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(len(p) for p in parts):
            return
        whole = pa.Table.from_batches(parts)
        n = len(whole)
        codes = pa.chunked_array([*whole["a"].chunks, *whole["b"].chunks]).combine_chunks().dictionary_encode()
        names = codes.dictionary
        order = pc.array_sort_indices(names)
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        at = rank[codes.indices.to_numpy()]
        label = _least(len(names), at[:n], at[n:])
        own = np.zeros(len(names), bool)
        own[at[:n]] = True
        nodes = np.flatnonzero(label != np.arange(len(names)))
        names = names.take(order)
        moved = np.zeros(len(names), bool)
        moved[label[at[:n][whole["open"].to_numpy()]]] = True
        unsettled = ~own[nodes] | moved[label[nodes]]
        out = [names.take(pa.array(nodes)), names.take(pa.array(label[nodes])), pa.array(own[nodes]), pa.array(unsettled)]
        table = pa.Table.from_arrays(out, ["a", "b", "own", "open"])
        yield from table.to_batches()

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b", "open").mapInArrow(stars, f"a {kind}, b {kind}, own boolean, open boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); the label is the least node of the component.

    Edges point to the smaller node. A partition replaces its edges by stars around
    the least node of each component in it, so a node has at most one edge per
    partition; then edges are dealt by the larger node and contracted again. So no
    task holds more edges of a node than there are partitions, nor all edges to a
    node that many others point to. Then every edge moves on to where its target
    points to, and all is dealt again; each round is one written table. It ends
    when nothing has moved and every node has its own edge only.
    The targets are joined from the written table, so that the edges to one node
    are split among tasks. Self-links and repeated links are allowed.
    """
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    edges = contracted(edges.filter("a <> b").select(high, low, F.lit(False).alias("open")))
    edges = stage(contracted(edges.withColumn("open", F.lit(False)).repartition("a")), "edges")
    first = True
    while first or edges.filter("open").agg(F.count(F.lit(1))).first()[0]:
        first = False
        target = edges.filter("own").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        moved = edges.join(target, F.col("b") == F.col("_a"), "left")
        further = F.col("_b").isNotNull()
        moved = moved.select("a", F.coalesce("_b", "b").alias("b"), further.alias("open"))
        edges = stage(contracted(moved.repartition("a")), "edges")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
