"""Level-synchronous transitive closure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Levels after which an unbounded closure is taken not to end, and most rows of a frontier that are sent to every task.
FUSE, BROADCAST = 500, 200_000


def closure(edges: DataFrame, seeds: DataFrame, direction: str = "up", max_depth: int | None = None, residual: Callable[[Column, Column], Column] | None = None, until: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every edge that a walk from a seed meets, with the least number of steps.

    edges: edge_id, src_key, dst_key, and with a residual src, dst (node structs); filter and project them before, as the loop reads them at every level.
    seeds: seed_id, key, and with a residual node. direction: "up" walks from dst to src, "down" the other way. residual: what must hold besides equal keys. until: with a
    residual, a condition on nodes; a seed that has met such a node goes no further after that level.

    The keyed edges are checkpointed once, so no level computes them again; a frontier of at most BROADCAST rows is sent to the edges, a larger one is joined by a shuffle. Per level there is one join of the frontier with the edges, a distinct and an anti-join with what was seen, and one checkpoint; a node is expanded once for each seed, so
    cycles end. Many seeds go through the same levels together. Returns seed_id, edge_id, depth (from 1), one row for each seed and edge.
    """
    near, far = ("dst", "src") if direction == "up" else ("src", "dst")
    extra = ["node"] if residual is not None else []
    held = edges.select("edge_id", F.col(f"{near}_key").alias("key"), F.col(f"{far}_key").alias("next_key"), *([F.col(near).alias("near_node"), F.col(far).alias("next_node")] if extra else [])).where("key is not null")
    frontier = cut(seeds.select("seed_id", "key", *extra).distinct())
    if max_depth is None or max_depth > 1:
        held = cut(held)
    seen, found, depth = frontier, [], 0
    while (max_depth is None or depth < max_depth) and (size := frontier.count()):
        depth += 1
        if depth > FUSE:
            raise RuntimeError("the closure does not end")
        step = held.join(F.broadcast(frontier) if size <= BROADCAST else frontier, "key")
        if extra:
            step = step.where(residual(F.col("node"), F.col("near_node")))
        step = cut(step.select("seed_id", "edge_id", F.col("next_key").alias("key"), *([F.col("next_node").alias("node")] if extra else [])).distinct())
        found.append(step.select("seed_id", "edge_id", F.lit(depth).alias("depth")))
        if max_depth is not None and depth >= max_depth:
            break
        reached = step.select("seed_id", "key", *extra).where("key is not null").distinct()
        if until is not None:
            reached = reached.join(step.where(until(F.col("node"))).select("seed_id").distinct(), "seed_id", "left_anti")
        on = [reached[c].eqNullSafe(seen[c]) for c in ("seed_id", "key", *extra)]
        frontier = cut(reached.join(seen, on, "left_anti"))
        seen = seen.unionByName(frontier)
    if not found:
        return step_schema(frontier)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("seed_id", "edge_id").agg(F.min("depth").alias("depth"))


def step_schema(frontier: DataFrame) -> DataFrame:
    return frontier.select("seed_id", F.lit(None).cast("bigint").alias("edge_id"), F.lit(0).alias("depth")).where("false")


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "up", max_depth: int | None = None) -> DataFrame:
    """Nodes reached and their least distance, for plain keys: seed_id, key, depth; the seed itself has depth 0."""
    walked = closure(edges, seeds, direction, max_depth)
    far = "src_key" if direction == "up" else "dst_key"
    hit = walked.join(edges.select("edge_id", F.col(far).alias("key")), "edge_id").select("seed_id", "key", "depth")
    return hit.unionByName(seeds.select("seed_id", "key", F.lit(0).alias("depth"))).groupBy("seed_id", "key").agg(F.min("depth").alias("depth"))


def apart(least: DataFrame) -> DataFrame:
    """a, m with a passed through explode, which hides how it is partitioned: the join shuffles both sides for itself, and adaptive execution can split the neighbours of a hub."""
    return least.select("m", F.explode(F.array("a")).alias("a"))


def label_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components of a, b (any orderable type) by large-star and small-star contraction: node, component (least node). With `nodes` (column
    node) lone ones are there as well."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = None
    while (after := mark(now)) != before and after[0]:
        before = after
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("edge")).select("edge.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(apart(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    tied = now.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component")).distinct()
    if nodes is None:
        return tied
    return nodes.select("node").distinct().join(tied, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
