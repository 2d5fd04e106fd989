"""Operator 7: embedding near-duplicates by collision-counting projections.

Unit vectors are projected onto random Gaussian directions. In each of T tables
a vector falls into a cell of ``g`` coarsely cut projections, and inside the
cell all vectors are sorted by one more projection; two vectors collide if one lies in
the query-centred window of the other. Pairs that collide at least ``COUNT``
times are verified by cosine in double precision. ``g`` follows the number of
vectors, so that chance collisions per vector stay constant, and T is the least number of
tables with which a pair exactly at the threshold reaches the count with the asked recall
(see :func:`calibrate`).

Large groups of near copies are not expanded into pairs. Vectors within half the threshold's
angle of a common leader are surely linked with one another (triangle
inequality on the sphere), so such a ball counts as a whole and only pairs
between balls are searched. Bit-equal vectors count as one with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import connected_components
from quillmill.llm.simhash import _groups
from quillmill.llm.skew import join_counted
from quillmill.llm.store import drop, materialize

#: Width of a cell and half width of the window, in standard deviations of a projected unit vector; collisions asked for.
CELL, WINDOW, COUNT = 1.0, 0.5, 2
_CHUNK = 4_000_000


@dataclass(frozen=True)
class Plan:
    cells: int
    tables: int
    p_link: float
    p_chance: float


def _rates(distance: float) -> tuple[float, float]:
    """Chance to fall into one cell, and into the window, for two vectors so far apart."""
    z = (np.arange(200_000) + 0.5) * (8 / 200_000)
    density = 2 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (8 / 200_000)
    cell = float((np.clip(1 - distance * z / CELL, 0, None) * density).sum())
    return cell, math.erf(WINDOW / distance / math.sqrt(2)) if distance else 1.0


def calibrate(n: int, threshold: float, recall: float) -> Plan:
    """Cells and tables for ``n`` vectors; recall is that of a pair exactly at the threshold."""
    near, near_w = _rates(math.sqrt(max(0.0, 2 - 2 * threshold)))
    far, far_w = _rates(math.sqrt(2))
    g = max(1, math.ceil(math.log(max(n, 2) * far_w / 2) / -math.log(far)))
    p = near**g * near_w
    tables = COUNT
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(COUNT)) > 1 - recall:
        tables += 1
    return Plan(g, tables, p, far**g * far_w)


def _directions(dim: int, plan: Plan, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((plan.tables, plan.cells + 1, dim)), rng.uniform(0, CELL, (plan.tables, plan.cells))


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the vectors of one length, and these as unit rows, in double precision."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == dim)
        x = flat[starts[mine][:, None] + np.arange(dim)].astype(np.float64)
        yield mine, x / np.linalg.norm(x, axis=1, keepdims=True)


def cell_rows(reps: DataFrame, plan: Plan, seed: int = 11) -> DataFrame:
    """``cell, at, node, ball``: a row per vector and table."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        mix = np.random.default_rng(seed).integers(1, 1 << 62, plan.cells, dtype=np.int64) | 1
        for batch in batches:
            nodes, balls = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for mine, x in by_length(batch.column(0)):
                dim = x.shape[1]
                a, b = drawn.setdefault(dim, _directions(dim, plan, seed))
                for t in range(plan.tables):
                    y = x @ a[t].T
                    with np.errstate(over="ignore"):
                        cell = (np.floor((y[:, :-1] + b[t]) / CELL).astype(np.int64) * mix).sum(axis=1)
                        cell = (cell ^ (cell >> 29)) * np.int64(-0x61C8864680B583EB) + (np.int64(t) << 16) + dim
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(y[:, -1]), pa.array(nodes[mine]), pa.array(balls[mine])], ["cell", "at", "node", "ball"])

    return reps.select("embedding", "node", "ball").mapInArrow(project, "cell long, at double, node long, ball long")


def _sorted_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell", "at")


def _batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def leader_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``: each vector with the smallest node of its cell. rows: a written table."""
    low = rows.groupBy("cell").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return join_counted(rows.select("cell", F.col("node").alias("b")), low, ["cell"]).filter("a < b").select("a", "b")


def colliding_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``, a < b: pairs of different balls that share a cell and lie within the window, once per table."""

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b, size = [], [], 0
        for g in _groups(batches, ["cell"]):
            node, at, ball = g["node"], g["at"], g["ball"]
            if len(node) < 2 or (ball == ball[0]).all():
                continue
            names, inverse, n = np.unique(ball, return_inverse=True, return_counts=True)
            large = inverse == n.argmax()  # of the largest ball, only pairs with others are looked at
            others = np.flatnonzero(~large)
            step = max(1, _CHUNK // len(node))
            for k in range(0, len(others), step):
                mine = others[k : k + step]
                near = np.abs(at[mine][:, None] - at[None, :]) <= WINDOW
                near &= ball[mine][:, None] != ball[None, :]
                near &= large[None, :] | (node[mine][:, None] < node[None, :])
                i, j = np.nonzero(near)
                x, y = node[mine[i]], node[j]
                out_a.append(np.minimum(x, y))
                out_b.append(np.maximum(x, y))
                size += len(x)
                if size > 200_000:
                    yield _batch(out_a, out_b)
                    out_a, out_b, size = [], [], 0
        if size:
            yield _batch(out_a, out_b)

    return _sorted_cells(rows).mapInArrow(collide, "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine, in double precision, is at least ``threshold``."""
    left = reps.select(F.col("node").alias("a"), F.col("embedding").alias("va"))
    right = reps.select(F.col("node").alias("b"), F.col("embedding").alias("vb"))
    both = pairs.join(left, "a").join(right, "b").filter("size(va) = size(vb)").select("a", "b", "va", "vb")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            for (mine, x), (_, y) in zip(by_length(batch.column(2)), by_length(batch.column(3))):
                ok[mine] = (x * y).sum(axis=1) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(cosine, "a long, b long")


def _valid(v: str) -> F.Column:
    return F.expr(f"coalesce(size({v}) > 0 and forall({v}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({v}, x -> x <> 0), false)")


def embedding_links(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different length. Repeated rows and
    ids count as vectors of their own, except that of rows with one id all are
    kept or none. A null id has no component id but takes part in links. An empty table
    gives an empty result; other columns are ignored.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    base = base.withColumn("valid", _valid("embedding"))
    keys = [F.when(F.col("valid"), F.xxhash64("embedding")).alias("k1"), F.when(F.col("valid"), F.xxhash64(F.reverse("embedding"), F.size("embedding"))).alias("k2")]
    base = materialize(base.select("vec_id", "valid", "embedding", *keys), "emb-base")
    reps = base.filter("valid").groupBy("k1", "k2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "emb-reps")
    plan = calibrate(reps.count(), threshold, recall)

    # leaders: vectors that no smaller vector leads; balls: what lies within half the angle of a leader
    half = math.cos(math.acos(threshold) / 2) + 1e-12
    cells = materialize(cell_rows(reps.withColumn("ball", F.col("node")), plan).select("cell", "node"), "emb-cells")
    led = materialize(verified(leader_pairs(cells).distinct(), reps, half), "emb-led")
    drop(cells)
    followers = led.select(F.col("b").alias("a")).distinct()
    balls = led.join(followers, "a", "left_anti").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))
    reps = reps.join(balls, "node", "left").withColumn("ball", F.coalesce("leader", "node")).drop("leader")
    reps = materialize(reps, "emb-balls")

    counted = colliding_pairs(cell_rows(reps, plan)).groupBy("a", "b").agg(F.count("*").alias("hits")).filter(F.col("hits") >= COUNT)
    links = materialize(verified(counted.select("a", "b"), reps, threshold), "emb-links")

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(reps.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("outside"))
    inside = reps.groupBy("ball").agg(F.sum("n").alias("inside"))
    joined = links.unionByName(reps.filter("node <> ball").select(F.col("node").alias("a"), F.col("ball").alias("b")))
    roots = connected_components(joined)
    found = reps.join(inside, "ball").join(outside, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = found.select("k1", "k2", "root", "least_id", (F.col("inside") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    found = materialize(found, "emb-found")
    found = found.join(found.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("k1", "k2", "n_links", "component_id")

    rows = base.select("vec_id", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
