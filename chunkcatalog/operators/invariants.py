"""Data-quality queries that must return no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.functions import policy
from chunkcatalog.operators import catalog, ordered

Catalog = dict[str, DataFrame]


def wrong_refcounts(cat: Catalog) -> DataFrame:
    want = catalog.refcounts(cat["file_head"], cat["snapshot_file"], cat["file"]).withColumnRenamed("refcount", "want")
    x = cat["chunk"].select("hash", "refcount").join(want, "hash", "left").withColumn("want", F.coalesce("want", F.lit(0)))
    return x.where("refcount <> want")


def dangling(cat: Catalog) -> DataFrame:
    held = cat["file_head"].select("file_id").union(cat["snapshot_file"].select("file_id")).distinct()
    return catalog.chunk_list(cat["file"]).join(held, "file_id", "left_semi").join(cat["chunk"], "hash", "left_anti")


def colocated(cat: Catalog) -> DataFrame:
    return catalog.colocation(catalog.placements(cat["vlog_plog"], cat["plog"]), cat["disk"]).where("colocated > 0")


def on_detached(cat: Catalog) -> DataFrame:
    return cat["plog"].join(cat["disk"].where("state = 'detached'").select(F.col("id").alias("disk_id")), "disk_id", "left_semi")


def unreadable(cat: Catalog) -> DataFrame:
    placed = catalog.placements(cat["vlog_plog"], cat["plog"])
    used = cat["chunk"].where(policy.live(F.col("refcount"))).select("vlog_id").distinct()
    return catalog.readiness(cat["vlog"], placed, cat["disk"], cat["node"]).where("NOT can_read").join(used, "vlog_id", "left_semi")


def gaps_in_shards(cat: Catalog) -> DataFrame:
    w = W.partitionBy("vlog_id").orderBy("shard_idx")
    return cat["vlog_plog"].withColumn("want", F.row_number().over(w) - 1).where("want <> shard_idx")


def overlapping_chunks(cat: Catalog, header: int = 64) -> DataFrame:
    """Records of one log that share bytes."""
    w = W.partitionBy("vlog_id").orderBy("vaddr_offset", "hash").rowsBetween(W.unboundedPreceding, -1)
    x = cat["chunk"].withColumn("before", F.max(F.col("vaddr_offset") + F.col("compressed_len") + header).over(w))
    return x.where("before > vaddr_offset")


def files_that_do_not_tile(rows: DataFrame) -> DataFrame:
    """``rows(file_id, pos, start, len)`` whose start is not where the one before ends."""
    x = ordered.extents(rows, ["file_id"], ["pos"], "len", "want", "__end")
    return x.where("want <> start").drop("__end")


def both_file_and_dir(cat: Catalog) -> DataFrame:
    return cat["file_head"].select("path").join(cat["dir"], "path", "left_semi")


def two_heads(cat: Catalog) -> DataFrame:
    return cat["file_head"].groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


ALL = {f.__name__: f for f in (wrong_refcounts, dangling, colocated, on_detached, unreadable, gaps_in_shards, overlapping_chunks, both_file_and_dir, two_heads)}


def broken(cat: Catalog, names: list[str] | None = None) -> dict[str, int]:
    """How many rows each broken invariant has."""
    counts = {n: ALL[n](cat).count() for n in names or ALL}
    return {n: c for n, c in counts.items() if c}
