"""Connected components of a graph given by its edges, without collecting it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpointed

#: Edges that one task contracts: what it holds does not grow with the graph.
CHUNK = 100_000


def _contract(batches):
    """The components of a task's own edges, as (node, smallest node)."""
    root: dict[int, int] = {}
    for b in batches:
        for v, u in zip(b.column("v").to_pylist(), b.column("u").to_pylist(), strict=True):
            while (r := root.setdefault(v, v)) != v:
                root[v] = v = root.setdefault(r, r)
            while (r := root.setdefault(u, u)) != u:
                root[u] = u = root.setdefault(r, r)
            if v != u:
                root[max(v, u)] = min(v, u)
    out = []
    for v in sorted(root):  # a root is smaller than its nodes: it is settled before them
        root[v] = root[root[v]]
        if root[v] != v:
            out.append((v, root[v]))
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["v", "u"])


def components(edges: DataFrame, step=checkpointed) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): its smallest reachable node.

    Tasks first contract CHUNK edges each to stars, which shortens all paths; a graph
    of no more is done then. Else large-star and small-star steps follow: every node
    links its larger neighbours, then itself and its smaller ones, to the smallest
    node that it knows. Both are repeated until nothing changes and each component is
    a star. A step is a partial aggregation and an equi-join, so a node with very many
    neighbours is summed before the shuffle and split in the join. Each round is
    written by ``step``, which cuts the lineage.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    links = step(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("v <> u").distinct())
    while True:
        size = links.count()
        parts = max(1, -(-size // CHUNK))
        # by row, not by key: a node with many edges may be in every part
        dealt = links.repartition(parts) if parts > 1 else links.coalesce(1)
        stars = step(dealt.mapInArrow(_contract, "v long, u long").distinct())
        if parts == 1:
            links = stars
            break
        new = _stars(stars, step)
        before, links = _print(links), new
        if _print(new) == before:
            break
    roots = links.select(F.col("u").alias("node")).distinct()
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _print(links: DataFrame) -> tuple:
    """Tells one set of edges from another: their number and the sum of their hashes."""
    h = F.xxhash64("v", "u").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h)).first())


def _stars(links: DataFrame, step) -> DataFrame:
    """One large-star and one small-star step."""
    both = links.select("v", "u").unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m"))
    least = step(least.select("v", F.least("v", "m").alias("m")))
    large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    large = step(large.distinct())
    low = step(large.groupBy("v").agg(F.min("u").alias("m")))
    near = large.join(low, "v")
    joined = near.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return step(joined.unionByName(low.select("v", F.col("m").alias("u"))).distinct())
