"""Connected components by alternating large-star and small-star steps.

Links stay distributed from end to end. A node that is the centre of very many
links costs no more than its links do: minima are map-side combined, and the
join that hands them out leaves the links of such nodes where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.skew import join_counted
from quillmill.llm.store import drop, materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _all_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links of a task; the smaller of two roots stays."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    roots = [root(x) for x in list(parent)]
    yield pa.RecordBatch.from_arrays([pa.array(np.array(list(parent), dtype=np.int64)), pa.array(np.array(roots, dtype=np.int64))], ["node", "root"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", *, at_once: int = 0) -> DataFrame:
    """``node, root`` for every node of ``links``; root is the smallest node reachable.

    Links with a null end are ignored; self-links give a node its own component.
    Repeated links and either direction are fine. No more than ``at_once`` links are solved by
    one task, which spares the driver the plans of some twenty queries.
    """
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null")
    links = materialize(links, "cc-links")
    if at_once and links.count() <= at_once:
        return links.coalesce(1).mapInArrow(_all_at_once, "node long, root long")
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialize(edges, "cc-0"), None
    for k in count(1):  # the rounds grow with the logarithm of the longest chain
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
        large = join_counted(both.filter("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"cc-large-{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, low, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"cc-{k}")
        drop(large)
        now = _digest(found)
        if k > 1:
            drop(edges)
        edges = found
        if now == before:
            break
        before = now
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = alone.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    return roots.select("node", F.coalesce("root", "node").alias("root"))
