"""Reachability between files: what a route's code consists of, what a change touches, what a task is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.closure import label_components, reach


def _links(calls: DataFrame, imports: DataFrame | None) -> DataFrame:
    pairs = calls.select(F.col("src_file").alias("src_key"), F.col("dst_file").alias("dst_key"))
    if imports is not None:
        pairs = pairs.unionByName(imports.select(F.col("file").alias("src_key"), F.col("resolved_file").alias("dst_key")))
    return pairs.where("src_key is not null and dst_key is not null and src_key <> dst_key").distinct().withColumn("edge_id", F.xxhash64("src_key", "dst_key"))


def route_core(calls: DataFrame, imports: DataFrame | None, routes: DataFrame) -> DataFrame:
    """The files that the code of a route consists of: its own, and all that calls or relative imports lead to. calls: src_file, dst_file; imports: file, resolved_file;
    routes: seed_id, file. Many routes go through the levels together. Returns seed_id, file."""
    return reach(_links(calls, imports), routes.select("seed_id", F.col("file").alias("key")), "down").select("seed_id", F.col("key").alias("file"))


def impacted_files(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files and the files of everything upstream of their functions. edges: src_key, dst_key, src_file, dst_file, edge_type; changed: file. One closure for all. Returns file."""
    calls = edges.where("edge_type = 'FUNCTION_CALL'").select("src_key", "dst_key", "src_file", "dst_file").withColumn("edge_id", F.xxhash64("src_key", "dst_key"))
    seeds = calls.join(changed.select(F.col("file").alias("dst_file")).distinct(), "dst_file", "left_semi").select(F.lit(0).alias("seed_id"), F.col("dst_key").alias("key")).distinct()
    met = reach(calls.select("src_key", "dst_key", "edge_id").distinct(), seeds, "up").select("key")
    files = calls.select(F.col("src_key").alias("key"), F.col("src_file").alias("file")).where("file is not null").distinct()
    return changed.select("file").unionByName(files.join(met, "key", "left_semi").select("file")).distinct()


def relevant_files(edges: DataFrame, selected: DataFrame, modified: DataFrame) -> DataFrame:
    """Files of a task: those selected, those modified, and those of all nodes connected, in any direction, with a node of a selected file. edges: src_key, dst_key, src_file, dst_file."""
    ends = edges.select(F.col("src_key").alias("node"), F.col("src_file").alias("file")).unionByName(edges.select(F.col("dst_key").alias("node"), F.col("dst_file").alias("file"))).distinct()
    labelled = label_components(edges.select(F.col("src_key").alias("a"), F.col("dst_key").alias("b")), ends.select("node"))
    placed = ends.join(labelled, "node")
    near = placed.join(selected.select("file").distinct(), "file", "left_semi").select("component").distinct()
    connected = placed.join(near, "component", "left_semi").select("file").where("file is not null")
    return selected.select("file").unionByName(modified.select("file")).unionByName(connected).distinct()
