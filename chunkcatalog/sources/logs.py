"""Log files as DataFrames, read by Spark alone (any file system it knows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkcatalog.functions import paths, policy


def read_logs(spark: SparkSession, folder: str, pattern: str = "plog-*") -> DataFrame:
    """``(plog_id, path, length, content)`` of the log files in a folder and those below it; other names are left out."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return x.select(policy.plog_id_of(F.col("path")).alias("plog_id"), "path", "length", "content").where("plog_id IS NOT NULL")


def list_logs(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """``(disk_id, plog_id)`` of the files under ``roots(disk_id, root)``, a folder for each disk: one listing of all of them; contents are not read."""
    folders = [r.root for r in roots.select("root").distinct().collect()]  # one name for each disk
    if not folders:
        return spark.createDataFrame([], "disk_id bigint, plog_id bigint")
    bare = lambda path: F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/"), "/+$", "")
    x = spark.read.format("binaryFile").option("pathGlobFilter", "plog-*").option("recursiveFileLookup", "true").load(folders)
    x = x.select(policy.plog_id_of(F.col("path")).alias("plog_id"), F.explode(paths.ancestors(bare(F.col("path")))).alias("above")).where("plog_id IS NOT NULL")
    known = roots.select(F.col("disk_id").cast("long").alias("disk_id"), paths.clean(bare(F.col("root"))).alias("above"))
    return x.join(known, "above").select("disk_id", "plog_id")


def sectors(logs: DataFrame, size: int = 4096) -> DataFrame:
    """``(plog_id, sector, data)``: files cut into sectors; the superblock is sector 0."""
    n = F.call_function("div", F.length("content") + size - 1, F.lit(size)).cast("int")
    x = logs.where(F.length("content") > 0).select("plog_id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("sector"))
    return x.select("plog_id", "sector", F.expr(f"substring(content, sector * {size} + 1, {size})").alias("data"))


def reconcile_roots(configured: DataFrame, disks: DataFrame) -> DataFrame:
    """Binds configured folders ``(root, uid)`` to catalog disks ``(id, uid)``: ``(root, id, status)``.

    ``bound``; ``new`` (the catalog does not know the uid); ``missing`` (no folder has the disk's uid).
    """
    x = configured.join(disks.select("id", "uid"), "uid", "full_outer")
    status = F.when(F.col("root").isNull(), "missing").when(F.col("id").isNull(), "new").otherwise("bound")
    return x.select("root", "uid", "id", status.alias("status"))


def write_logs(logs: DataFrame, folder: str) -> None:
    """Writes ``(plog_id, content)`` as Parquet, hashed by log, so that one log is read by one task."""
    logs.repartition("plog_id").write.mode("append").parquet(folder)


def shard_reads(placed: DataFrame, contents: DataFrame, healthy: DataFrame) -> DataFrame:
    """The first healthy copy of each log: ``(vlog_id, shard_idx, content)``; a missing copy counts as offline."""
    x = placed.join(contents.select("plog_id", "content"), "plog_id").join(healthy.select("plog_id"), "plog_id", "left_semi")
    best = x.groupBy("vlog_id").agg(F.min("shard_idx").alias("shard_idx"))
    return x.join(best, ["vlog_id", "shard_idx"]).select("vlog_id", "shard_idx", "content")
