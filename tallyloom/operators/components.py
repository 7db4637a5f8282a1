"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyloom.operators.store import forgotten, written

#: Edges that one task takes through a graph at most; of more, all tasks do it in rounds.
ONE_TASK = 1 << 18


def components(edges: DataFrame, a: str, b: str, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (the smallest node of it) for all nodes of ``edges``; nodes are numbers, strings, or structs of these.

    Edges are turned into stars by two alternating steps: each node's larger neighbours are linked to the smallest one around
    it, then its smaller neighbours and itself are. The number of edges never rises, and the rounds grow with the logarithm of
    the longest path, not with the path. A node of very many edges is summed up before it is shuffled, and its join is one
    that Spark can split. The driver sees one count and one checksum a round. A graph of few edges is one task's work.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = written(links, "component-edges")
    if links.count() <= one_task:
        kind = links.schema["u"].dataType
        out = StructType([StructField("node", kind), StructField("component", kind)])
        return links.coalesce(1).mapInArrow(_in_one_task, out)
    loops = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    loops, links, last = written(loops, "component-nodes"), links.where("u <> v"), None
    while True:
        large = _star(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        nxt = written(_star(large, larger=False), "component-edges")
        forgotten(links)
        links = nxt
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")).first()
        if now == last:
            break
        last = now
    out = loops.join(links.select(F.col("u").alias("node"), "v"), "node", "left")
    return out.select("node", F.coalesce("v", "node").alias("component"))


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root, kind = {}, None
    plain = lambda x: tuple(x.items()) if isinstance(x, dict) else x

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            x, y = top(plain(u)), top(plain(v))
            root[max(x, y)] = min(x, y)
    if root:
        shown = lambda x: dict(x) if isinstance(x, tuple) else x
        yield pa.RecordBatch.from_arrays([pa.array([shown(x) for x in root], kind), pa.array([shown(top(x)) for x in root], kind)], names=["node", "component"])


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Every node's larger (or its smaller) neighbours linked to the smallest of the node and its neighbours, larger node first."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "component-least")
    out = links.where("v > u" if larger else "v < u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()
