"""Connected components of a graph of long node ids, by alternating stars.

Large-star and small-star steps (MapReduce connected components, Kiveris et al. 2014) as
aggregations and joins. A node's least neighbour is aggregated with map-side combining and
joined back, so a hub's edges are never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import compact, cut, skew_join


#: Edges of a checkpoint's part. Edges that fit into one part are finished in its task.
ROWS = 100_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node each is connected to."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(nodes))
    x, y = place[: len(a)], place[len(a) :]
    while len(x):
        # each edge links the greater of its ends' roots to the smaller, then every node goes to its root's root
        p, q = low[x], low[y]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]
        x, y = (v[low[x] != low[y]] for v in (x, y))
    return nodes, nodes[low]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*map(np.concatenate, zip(*held, strict=True)))], names=["node", "root"])


def _stars(directed: DataFrame, large: bool) -> DataFrame:
    """directed: (u, v). Large: links larger neighbours of u, small: smaller ones and u, to the least."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = skew_join(directed, least, ["u"])
    out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is the component's least node.

    Self-loops and nulls are ignored; no edges give an empty table.
    """
    now = compact(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), ROWS)
    sign = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen["n"] <= ROWS:
            return cut(now.coalesce(1).mapInArrow(_in_one_task, "node long, root long"))
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
        parts = -(-seen["n"] // ROWS)  # edges get fewer, not more: few of them need few files
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = cut(_stars(_stars(both, True), False).coalesce(parts))
    least = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(least.select(F.col("v").alias("node"), F.col("v").alias("root")))
