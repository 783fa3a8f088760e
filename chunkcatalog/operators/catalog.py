"""Reads of the catalog: scans, lookups, joins and aggregates. DataFrames in the schemas of ``chunkcatalog.schema``.

Joins carry no hints: disks, nodes and policies are small and Catalyst or AQE broadcasts them by their measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.functions import ids, paths, policy
from chunkcatalog.schema import HEADER_BYTES

# ---- scans and lookups


def scan(table: DataFrame, *order: str) -> DataFrame:
    """A table in key order."""
    return table.orderBy(*order)


def shards_of(vlog_plog: DataFrame, vlog_id: int) -> DataFrame:
    return vlog_plog.where(F.col("vlog_id") == vlog_id).orderBy("shard_idx")


def vlogs_of_plog(vlog_plog: DataFrame, plog_id: int) -> DataFrame:
    return vlog_plog.where(F.col("plog_id") == plog_id).select("vlog_id").orderBy("vlog_id")


def uid_of(table: DataFrame, key: int) -> DataFrame:
    """One row: the uid of a log or disk, or '' if there is none."""
    return table.where(F.col("id") == key).agg(F.coalesce(F.max("uid"), F.lit("")).alias("uid"))


def row_of(table: DataFrame, key: int) -> DataFrame:
    """The row of a key; fails when evaluated if there is none."""
    found = table.where(F.col("id") == key)
    check = found.agg(F.assert_true(F.count("*") == 1, F.lit(f"no row {key}")).alias("ok"))
    return check.join(found, F.lit(True), "left").drop("ok")


def policies_for(names: DataFrame, buckets: DataFrame, default: tuple[str, int, int] | None = None) -> DataFrame:
    """The policy of each bucket in ``names(name)``: its own, else the operator's ``default``, else one plain copy set; ``found`` tells."""
    scheme, data, parity = default or ("DUPLICATE", 1, 0)
    x = names.join(buckets.withColumn("found", F.lit(True)), "name", "left")
    return x.select("name", F.coalesce("protection_scheme", F.lit(scheme)).alias("protection_scheme"), F.coalesce("data_shards", F.lit(data)).alias("data_shards"), F.coalesce("parity_shards", F.lit(parity)).alias("parity_shards"), F.coalesce("found", F.lit(False)).alias("found"))


def with_state(table: DataFrame, state: str) -> DataFrame:
    return table.where(F.col("state") == state).orderBy("id")


def leases_of(leases: DataFrame, op_id: int) -> DataFrame:
    return leases.where(F.col("write_op_id") == op_id).orderBy("ordinal")


def leased(vlogs: DataFrame, leases: DataFrame) -> DataFrame:
    """Logs that some operation holds."""
    return vlogs.join(leases.select(F.col("vlog_id").alias("id")), "id", "left_semi")


def head_version(wanted: DataFrame, heads: DataFrame) -> DataFrame:
    """``(path, file_id)`` for each wanted path, 0 if it has no version."""
    return wanted.join(heads.select("path", "file_id"), "path", "left").select("path", F.coalesce("file_id", F.lit(0)).alias("file_id"))


def snapshot_version(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """As ``head_version``, for ``wanted(snapshot_id, path)`` as of a snapshot."""
    return wanted.join(members, ["snapshot_id", "path"], "left").select("snapshot_id", "path", F.coalesce("file_id", F.lit(0)).alias("file_id"))


def probe(hashes: DataFrame, chunks: DataFrame, live_only: bool = True) -> DataFrame:
    """Placements of the wanted hashes; by default of live chunks alone, as deduplication needs."""
    return hashes.join(chunks.where(policy.live(F.col("refcount"))) if live_only else chunks, "hash")


def live_in_vlog(chunks: DataFrame, vlog_id: int | None = None) -> DataFrame:
    x = chunks.where(policy.live(F.col("refcount")))
    return (x if vlog_id is None else x.where(F.col("vlog_id") == vlog_id)).orderBy("vlog_id", "vaddr_offset")


def in_range(chunks: DataFrame, lo: int | Column, hi: int | Column) -> DataFrame:
    """Chunks whose payload meets [lo, hi) of their log."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
    return chunks.where(policy.payload_overlaps(F.col("vaddr_offset"), F.col("compressed_len"), lo, hi))


def holds_any(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(vlog_id)`` of the logs that hold a hash of the list."""
    return chunks.join(hashes, "hash", "left_semi").select("vlog_id").distinct()


def disk_states(disks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(disk_id, node_id, disk_state, node_state)``; an unknown node counts as working."""
    n = nodes.select(F.col("id").alias("n_id"), F.col("state").alias("n_state"))
    d = disks.select(F.col("id").alias("disk_id"), policy.node_of_disk(F.col("node_id"), F.col("id")).alias("node_id"), F.col("state").alias("disk_state"))
    return d.join(n, d.node_id == n.n_id, "left").select("disk_id", "node_id", "disk_state", F.coalesce("n_state", F.lit("working")).alias("node_state"))


# ---- files


def latest(versions: DataFrame, key: str = "path", order: str = "id") -> DataFrame:
    """The last version of each key."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return versions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def list_dir(directory: str, heads: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Children of a directory: directories first, then files with their sizes, by name."""
    f = heads.where(F.col("parent") == directory).join(files.select(F.col("id").alias("file_id"), "chunks"), "file_id")
    f = f.select("name", F.lit(False).alias("is_dir"), ids.list_size(F.col("chunks")).alias("size"), "mtime")
    d = dirs.where((F.col("parent") == directory) & (F.col("path") != directory)).select("name", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), "mtime")
    return d.unionByName(f).orderBy(F.desc("is_dir"), "name")


def stat(wanted: DataFrame, heads: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """``(path, is_dir, size, mtime)`` of wanted paths that exist; a path that is both counts as the file."""
    f = wanted.join(heads, "path").join(files.select(F.col("id").alias("file_id"), "chunks"), "file_id").select("path", F.lit(False).alias("is_dir"), ids.list_size(F.col("chunks")).alias("size"), "mtime")
    d = wanted.join(dirs, "path").join(heads, "path", "left_anti").select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), "mtime")
    return f.unionByName(d)


def implied_dirs(files: DataFrame) -> DataFrame:
    """``(path)`` of every directory above some file."""
    return files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()


def chunk_list(files: DataFrame) -> DataFrame:
    """``(file_id, pos, hash, len)`` in order, repeats kept."""
    return files.select(F.col("id").alias("file_id"), F.posexplode("chunks").alias("pos", "c")).select("file_id", "pos", "c.hash", "c.len")


def placed_chunks(files: DataFrame, chunks: DataFrame, strict: bool = True) -> DataFrame:
    """``chunk_list`` with placements; a hash that the catalog lacks is an error, or null if not ``strict``."""
    x = chunk_list(files).join(chunks.select("hash", "vlog_id", "vaddr_offset", "compressed_len"), "hash", "left")
    vlog = F.when(F.col("vlog_id").isNull(), F.raise_error(F.concat(F.lit("missing chunk "), F.col("hash")))).otherwise(F.col("vlog_id")) if strict else F.col("vlog_id")
    return x.select("file_id", "pos", "hash", "len", vlog.alias("vlog_id"), "vaddr_offset", "compressed_len")


def refcounts(heads: DataFrame, snapshot_files: DataFrame, files: DataFrame) -> DataFrame:
    """``(hash, refcount)``: occurrences over all heads and snapshots; a chunk twice in a file counts twice."""
    held = heads.select("file_id").unionAll(snapshot_files.select("file_id")).groupBy("file_id").agg(F.count("*").alias("times"))
    used = files.select(F.col("id").alias("file_id"), "chunks").join(held, "file_id")  # only versions that something holds are unpacked
    return used.select("times", F.explode("chunks").alias("c")).groupBy(F.col("c.hash").alias("hash")).agg(F.sum("times").alias("refcount"))


def distinct_hashes(files: DataFrame) -> DataFrame:
    return files.select(F.col("id").alias("file_id"), F.explode(F.array_distinct(F.transform("chunks", lambda c: c["hash"]))).alias("hash"))


# ---- space


def vlog_usage(vlogs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(vlog_id, total_bytes, live_bytes, dead_bytes, waste_ratio)``; logs without chunks stay, with 0 live bytes."""
    use = F.when(policy.live(F.col("refcount")), F.col("compressed_len") + HEADER_BYTES).otherwise(0).cast("long")
    per = chunks.groupBy("vlog_id").agg(F.sum(use).alias("live_bytes"))
    x = vlogs.select(F.col("id").alias("vlog_id"), F.col("length").alias("total_bytes")).join(per, "vlog_id", "left").withColumn("live_bytes", F.coalesce("live_bytes", F.lit(0).cast("long")))
    return x.withColumn("dead_bytes", policy.dead_bytes(F.col("total_bytes"), F.col("live_bytes"))).withColumn("waste_ratio", policy.waste_ratio(F.col("total_bytes"), F.col("live_bytes")))


def dedup_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Of ``rows(keys, hash, len)``: chunks, distinct chunks and their bytes for each key."""
    one = rows.groupBy(*keys, "hash").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"), F.max("len").alias("len"))
    return one.groupBy(*keys).agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum("bytes").alias("bytes"), F.sum("len").alias("distinct_bytes"))


# ---- placement and readiness


def placements(vlog_plog: DataFrame, plogs: DataFrame) -> DataFrame:
    """``(vlog_id, shard_idx, plog_id, disk_id, length)``."""
    return vlog_plog.join(plogs.select(F.col("id").alias("plog_id"), "disk_id", "length"), "plog_id").select("vlog_id", "shard_idx", "plog_id", "disk_id", "length")


def plog_counts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("disk_id").agg(F.count("*").alias("plogs"))


def disk_bytes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("disk_id").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def readiness(vlogs: DataFrame, placed: DataFrame, disks: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each log with shards: total and live shards, and two pairs of gates.

    ``commit_ready``/``readable`` need all shards, or as many as data shards, whatever the scheme. ``can_commit``/``can_read``
    apply the thresholds of the scheme.
    """
    states = disk_states(disks, nodes)
    x = placed.join(states, "disk_id").withColumn("up", policy.disk_live(F.col("disk_state"), F.col("node_state")))
    per = x.groupBy("vlog_id").agg(F.count("*").alias("total"), F.count_if("up").alias("live"))
    x = vlogs.select(F.col("id").alias("vlog_id"), "protection_scheme", "data_shards", "parity_shards").join(per, "vlog_id")
    commit = policy.commit_threshold(F.col("protection_scheme"), F.col("data_shards"), F.col("parity_shards"), F.col("total"))
    read = policy.read_threshold(F.col("protection_scheme"), F.col("data_shards"))
    return x.select("vlog_id", "total", "live", (F.col("live") == F.col("total")).alias("commit_ready"), (F.col("live") >= F.col("data_shards")).alias("readable"), (F.col("live") >= commit).alias("can_commit"), (F.col("live") >= read).alias("can_read"))


def on_disk(placed: DataFrame, disk_id: int) -> DataFrame:
    """Placements of the logs with a shard on a disk (all shards of those logs)."""
    hit = placed.where(F.col("disk_id") == disk_id).select("vlog_id").distinct()
    return placed.join(hit, "vlog_id", "left_semi")


def on_node(placed: DataFrame, disks: DataFrame, node_id: int) -> DataFrame:
    of = disks.where(F.col("node_id") == node_id).select(F.col("id").alias("disk_id"))
    return placed.join(placed.join(of, "disk_id", "left_semi").select("vlog_id").distinct(), "vlog_id", "left_semi")


def readiness_totals(ready: DataFrame) -> DataFrame:
    return ready.agg(F.count("*").alias("vlogs"), F.count_if("commit_ready").alias("commit_ready"), F.count_if("readable").alias("readable"))


def colocation(placed: DataFrame, disks: DataFrame) -> DataFrame:
    """``(vlog_id, shards, nodes, colocated)``: shards beyond the number of distinct nodes share a fault domain."""
    n = disks.select(F.col("id").alias("disk_id"), policy.node_of_disk(F.col("node_id"), F.col("id")).alias("node"))
    x = placed.join(n, "disk_id").groupBy("vlog_id").agg(F.count("*").alias("shards"), F.count_distinct("node").alias("nodes"))
    return x.withColumn("colocated", F.col("shards") - F.col("nodes"))


def extremes(usage: DataFrame) -> DataFrame:
    """Fullest and emptiest of ``usage(disk_id, bytes)``; ties go to the lower id."""
    return usage.agg(
        F.max_by("disk_id", F.struct("bytes", (-F.col("disk_id")).alias("i"))).alias("fullest"),
        F.max("bytes").alias("most"),
        F.min_by("disk_id", F.struct("bytes", "disk_id")).alias("emptiest"),
        F.min("bytes").alias("least"),
    )


def scrub_rollup(shards: DataFrame) -> DataFrame:
    """``shards(vlog_id, shard_idx, sectors, corrupt, bad_blocks)`` by log: sums, and the list of unhealthy shards."""
    bad = (F.col("corrupt") > 0) | (F.col("bad_blocks") > 0)
    return shards.groupBy("vlog_id").agg(F.count("*").alias("shards"), F.sum("sectors").alias("sectors"), F.sum("corrupt").alias("corrupt"), F.sum("bad_blocks").alias("bad_blocks"), F.sort_array(F.collect_list(F.when(bad, F.col("shard_idx")))).alias("unhealthy"))
