"""Queries of lookups and of catalog changes: each runs a transition over a whole catalog and gives the table it changed, next to SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkcatalog import schema
from chunkcatalog.functions import ids, layout, paths, policy
from chunkcatalog.operators import catalog, ordered, planners, shards, transitions
from chunkcatalog.plans.fixtures import Tables
from chunkcatalog.plans.queries import query
from chunkcatalog.sources import logs
from chunkcatalog.streaming import write_ops

LOG = 7


def _rows(t: Tables, rows: list[tuple], columns: str) -> DataFrame:
    """A request of a few rows."""
    return t.spark.createDataFrame(rows, columns)


def _bridge(t: Tables) -> DataFrame:
    return t.placed.select("vlog_id", "shard_idx", "plog_id")


def _plogs(t: Tables) -> DataFrame:
    return t.placed.select(F.col("plog_id").alias("id"), F.lit("").alias("uid"), "disk_id", "length")


# ---- lookups


@query(
    """SELECT 'plog' AS tab, CAST(plog_id AS VARCHAR) AS key FROM placed UNION ALL SELECT 'vlog', CAST(id AS VARCHAR) FROM vlog UNION ALL SELECT 'disk', CAST(id AS VARCHAR) FROM disk
UNION ALL SELECT 'node', CAST(id AS VARCHAR) FROM node UNION ALL SELECT DISTINCT 'bucket', split_part(path, '/', 1) FROM page_paths""",
    "placed vlog disk node page_paths",
)
def catalog_scans(t: Tables) -> DataFrame:
    buckets = t.page_paths.select(paths.bucket(F.col("path")).alias("name")).distinct()
    tables = {"plog": (_plogs(t), "id"), "vlog": (t.vlog, "id"), "disk": (t.disk, "id"), "node": (t.node, "id"), "bucket": (buckets, "name")}
    parts = [catalog.scan(table, key).select(F.lit(name).alias("tab"), F.col(key).cast("string").alias("key")) for name, (table, key) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT vlog_id, shard_idx, plog_id FROM placed WHERE vlog_id = {LOG}", "placed")
def shards_of_a_log(t: Tables) -> DataFrame:
    return catalog.shards_of(_bridge(t), LOG)


@query(f"SELECT vlog_id FROM placed WHERE plog_id = {LOG * 1000}", "placed")
def logs_of_a_shard(t: Tables) -> DataFrame:
    return catalog.vlogs_of_plog(_bridge(t), LOG * 1000)


@query(f"SELECT 'vlog' AS tab, coalesce(max('v' || CAST(id AS VARCHAR)), '') AS uid FROM vlog WHERE id = {LOG} UNION ALL SELECT 'disk', coalesce(max('d' || CAST(id AS VARCHAR)), '') FROM disk WHERE id = {LOG} UNION ALL SELECT 'none', ''", "vlog disk")
def uid_lookups(t: Tables) -> DataFrame:
    """By id, of a log, of a disk, and of an id that does not exist."""
    v = t.vlog.withColumn("uid", F.concat(F.lit("v"), F.col("id").cast("string")))
    d = t.disk.withColumn("uid", F.concat(F.lit("d"), F.col("id").cast("string")))
    asked = {"vlog": (v, LOG), "disk": (d, LOG), "none": (v, -1)}
    parts = [catalog.uid_of(table, key).select(F.lit(name).alias("tab"), "uid") for name, (table, key) in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT id, length, protection_scheme FROM vlog WHERE id = {LOG}", "vlog")
def row_lookup(t: Tables) -> DataFrame:
    return catalog.row_of(t.vlog, LOG).select("id", "length", "protection_scheme")


@query("SELECT o_orderkey AS vlog_id, o_custkey % 50 AS write_op_id, CAST(o_orderkey % 1000 AS INTEGER) AS ordinal FROM orders WHERE o_custkey % 50 = 7")
def leases_of_an_operation(t: Tables) -> DataFrame:
    return catalog.leases_of(t.raw("orders").select(F.col("o_orderkey").alias("vlog_id"), (F.col("o_custkey") % 50).alias("write_op_id"), (F.col("o_orderkey") % 1000).cast("int").alias("ordinal")), 7)


@query("SELECT 1 AS snapshot_id, path, CASE WHEN file_id // 1000 % 2 = 0 THEN file_id ELSE 0 END AS file_id FROM tree_heads", "tree_heads")
def snapshot_lookup(t: Tables) -> DataFrame:
    """The version of every path in a snapshot that holds every second one."""
    heads = t.tree["file_head"]
    members = heads.where(F.call_function("div", F.col("file_id"), F.lit(1000)) % 2 == 0).select(F.lit(1).alias("snapshot_id"), "path", "file_id")
    return catalog.snapshot_version(heads.select(F.lit(1).alias("snapshot_id"), "path"), members)


@query("SELECT hash, vlog_id, vaddr_offset FROM doc_chunks WHERE refcount > 0", "doc_chunks")
def live_chunks_in_order(t: Tables) -> DataFrame:
    return catalog.live_in_vlog(t.doc_chunks).select("hash", "vlog_id", "vaddr_offset")


@query("SELECT hash, vaddr_offset FROM doc_chunks WHERE refcount > 0 AND vlog_id = 3", "doc_chunks")
def live_chunks_of_a_log(t: Tables) -> DataFrame:
    return catalog.live_in_vlog(t.doc_chunks, 3).select("hash", "vaddr_offset")


@query("SELECT file_id, pos, hash, c.len, 1 AS vlog_id FROM tree_chunks c JOIN tree_heads USING (path, file_id)", "tree_heads")
def placed_file_chunks(t: Tables) -> DataFrame:
    """Chunk lists of all heads with their places; order and repeats stay."""
    return catalog.placed_chunks(catalog.latest(t.tree["file"]), t.tree["chunk"]).select("file_id", "pos", "hash", "len", "vlog_id")


@query("SELECT DISTINCT file_id, hash FROM conv_chunks", "conv_chunks")
def distinct_file_hashes(t: Tables) -> DataFrame:
    return catalog.distinct_hashes(t.conv_files)


@query("SELECT hash FROM doc_rows WHERE doc_id IN (SELECT doc_id FROM labels) UNION SELECT hash FROM doc_rows WHERE bucket = 'src1' UNION SELECT hash FROM doc_chunks WHERE refcount = 0", "doc_chunks")
def pins_of_all_kinds(t: Tables) -> DataFrame:
    """Hashes that writes, readers and moves hold, each once."""
    return planners.all_pins(t.doc_rows.join(t.raw("labels").select("doc_id"), "doc_id", "left_semi"), t.doc_rows.where("bucket = 'src1'"), t.doc_chunks.where("refcount = 0"))


@query("SELECT vlog_id, min(shard_idx) AS shard_idx, sha256(CAST(min(shard_idx) AS VARCHAR)) AS digest FROM placed WHERE plog_id % 13 <> 0 GROUP BY 1", "placed")
def first_healthy_copy_read(t: Tables) -> DataFrame:
    """Each log's bytes from its first copy that is there and healthy."""
    contents = t.placed.select("plog_id", F.col("shard_idx").cast("string").cast("binary").alias("content"))
    found = logs.shard_reads(t.placed, contents, t.placed.where("plog_id % 13 <> 0").select("plog_id"))
    return found.select("vlog_id", "shard_idx", F.sha2("content", 256).alias("digest"))


# ---- namespace


@query("SELECT hash, CAST(sum(n) AS BIGINT) AS refcount FROM (SELECT hash, 0 AS n FROM tree_refs UNION ALL SELECT hash, 1 FROM tree_chunks JOIN tree_heads USING (path, file_id) WHERE file_id // 1000 % 4 <> 0 OR pos = 0) GROUP BY 1", "tree_refs")
def publish_refcounts(t: Tables) -> DataFrame:
    """References after every fourth file is published anew with its first chunk alone."""
    return transitions.publish_files(t.tree, *_shorter(t))["chunk"].select("hash", "refcount")


def _shorter(t: Tables) -> tuple[DataFrame, DataFrame]:
    again = catalog.latest(t.tree["file"]).where(F.call_function("div", F.col("id"), F.lit(1000)) % 4 == 0)
    batch = again.select("path", F.lit(5).cast("long").alias("mtime"), F.slice("chunks", 1, 1).alias("chunks"))
    one = F.col("chunks")[0]
    zero = F.lit(0).cast("long")
    return batch, batch.select(F.col("path").alias("pos"), one["hash"].alias("hash"), zero.alias("vlog_id"), zero.alias("vaddr_offset"), one["len"].cast("long").alias("logical_len"), one["len"].cast("long").alias("compressed_len"))


@query(
    """SELECT path, CASE WHEN again THEN (SELECT max(file_id) FROM conv_chunks) + CAST(row_number() OVER (PARTITION BY again ORDER BY path) AS BIGINT) ELSE file_id END AS file_id, CASE WHEN again THEN 5 ELSE mtime END AS mtime
FROM (SELECT path, file_id, file_id // 1000 % 4 = 0 AS again, file_id % 1000 * 10 AS mtime FROM tree_heads)""",
    "tree_heads",
)
def publish_heads(t: Tables) -> DataFrame:
    """Heads after that: new versions get the next ids in order of their paths."""
    return transitions.publish_files(t.tree, *_shorter(t))["file_head"].select("path", "file_id", "mtime")


@query("SELECT hash, CAST(sum(n) AS BIGINT) AS refcount FROM (SELECT hash, 0 AS n FROM tree_refs UNION ALL SELECT hash, 1 FROM tree_chunks JOIN tree_heads USING (path, file_id) WHERE file_id // 1000 % 3 <> 1) GROUP BY 1", "tree_refs")
def unlink_refcounts(t: Tables) -> DataFrame:
    gone = t.tree["file_head"].where(F.call_function("div", F.col("file_id"), F.lit(1000)) % 3 == 1).select("path").unionByName(_rows(t, [("no/such",)], "path string"))
    return transitions.unlink(t.tree, gone)["chunk"].select("hash", "refcount")


@query(
    """SELECT path, file_id, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_replace(path, '^.*/', '') AS name FROM (
  SELECT CASE WHEN starts_with(path, 'c1/') THEN 'moved/to' || substr(path, 3) ELSE path END AS path, file_id FROM tree_heads)""",
    "tree_heads",
)
def rename_heads(t: Tables) -> DataFrame:
    return transitions.rename(t.tree, "c1", "moved/to")["file_head"].select("path", "file_id", "parent", "name")


@query(
    """SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM (SELECT string_split(CASE WHEN starts_with(path, 'c1/') THEN 'moved/to' || substr(path, 3) ELSE path END, '/') AS parts FROM tree_heads), range(1, 9) r(i) WHERE i < len(parts)""",
    "tree_heads",
)
def rename_dirs(t: Tables) -> DataFrame:
    """Directories after a rename: those moved, those that stay, and the new ones above the target."""
    return transitions.rename(t.tree, "c1", "moved/to")["dir"].select("path")


@query(
    """SELECT hash, CAST(sum(n) AS BIGINT) AS refcount FROM (SELECT hash, 0 AS n FROM tree_refs UNION ALL SELECT hash, 1 FROM tree_chunks JOIN tree_heads USING (path, file_id) WHERE path <> (SELECT max(path) FROM tree_heads)) GROUP BY 1""",
    "tree_refs",
)
def rename_over_a_file(t: Tables) -> DataFrame:
    """What stood at the target loses its references."""
    first, last = t.tree["file_head"].agg(F.min("path"), F.max("path")).first()
    return transitions.rename(t.tree, first, last)["chunk"].select("hash", "refcount")


@query("SELECT 'file' AS kind, path FROM tree_heads WHERE NOT starts_with(path, 'c2/') UNION ALL SELECT DISTINCT 'dir', array_to_string(string_split(path, '/')[1:i], '/') FROM tree_heads, range(1, 3) r(i) WHERE NOT starts_with(path, 'c2/')", "tree_heads")
def removed_tree(t: Tables) -> DataFrame:
    after = transitions.remove_tree(t.tree, "c2")
    return after["file_head"].select(F.lit("file").alias("kind"), "path").unionByName(after["dir"].select(F.lit("dir").alias("kind"), "path"))


@query("SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS path FROM (SELECT path FROM tree_heads UNION ALL SELECT 'x/y/z/f'), range(1, 9) r(i) WHERE i < len(string_split(path, '/')) AND array_to_string(string_split(path, '/')[1:i], '/') <> 'x/y/z'", "tree_heads")
def made_and_removed_dirs(t: Tables) -> DataFrame:
    """A deep directory is made with those above it, twice, and removed again alone."""
    cat = transitions.mkdir(transitions.mkdir(t.tree, "x/y/z", 9), "x/y/z", 10)
    return transitions.rmdir(cat, "x/y/z")["dir"].select("path")


@query("SELECT 'file' AS kind, path, CASE WHEN path = (SELECT min(path) FROM tree_heads) THEN 77 ELSE file_id % 1000 * 10 END AS mtime FROM tree_heads UNION ALL SELECT DISTINCT 'dir', split_part(path, '/', 1), CASE WHEN split_part(path, '/', 1) = 'c0' THEN 78 ELSE 0 END FROM tree_heads", "tree_heads")
def times_set(t: Tables) -> DataFrame:
    first = t.tree["file_head"].agg(F.min("path")).first()[0]
    cat, found = transitions.set_mtime(t.tree, first, 77)
    cat, also = transitions.set_mtime(cat, "c0", 78)
    same, lost = transitions.set_mtime(cat, "no/such", 1)
    assert found and also and not lost and same is cat
    top = cat["dir"].where(F.col("parent") == "")
    return cat["file_head"].select(F.lit("file").alias("kind"), "path", "mtime").unionByName(top.select(F.lit("dir").alias("kind"), "path", "mtime"))


@query("SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_replace(path, '^.*/', '') AS name FROM tree_heads UNION ALL SELECT DISTINCT 'dir ' || array_to_string(string_split(path, '/')[1:i], '/'), '', '' FROM tree_heads, range(1, 3) r(i)", "tree_heads")
def backfilled_namespace(t: Tables) -> DataFrame:
    """Parents, names and directories made again from bare paths."""
    bare = {**t.tree, "file_head": t.tree["file_head"].withColumn("parent", F.lit("")).withColumn("name", F.lit("")), "dir": t.tree["dir"].where("false")}
    after = transitions.backfill_namespace(bare)
    return after["file_head"].select("path", "parent", "name").unionByName(after["dir"].select(F.concat(F.lit("dir "), "path").alias("path"), F.lit("").alias("parent"), F.lit("").alias("name")))


# ---- snapshots


@query("SELECT hash, CAST(refcount * 2 AS BIGINT) AS refcount FROM tree_refs", "tree_refs")
def snapshot_refs(t: Tables) -> DataFrame:
    return transitions.create_snapshot(t.tree, "one", 100)["chunk"].select("hash", "refcount")


@query("SELECT 1 AS snapshot_id, path, file_id FROM tree_heads", "tree_heads")
def snapshot_members(t: Tables) -> DataFrame:
    return transitions.create_snapshot(t.tree, "one", 100)["snapshot_file"].select(F.col("snapshot_id").cast("int").alias("snapshot_id"), "path", "file_id")


@query("SELECT hash, CAST(refcount * 2 AS BIGINT) AS refcount FROM tree_refs", "tree_refs")
def snapshot_deleted_refs(t: Tables) -> DataFrame:
    """Of two snapshots one is deleted, together with one that does not exist."""
    cat = transitions.create_snapshot(transitions.create_snapshot(t.tree, "one", 100), "two", 200)
    return transitions.delete_snapshots(cat, _rows(t, [(1,), (9,)], "id bigint"))["chunk"].select("hash", "refcount")


@query("SELECT hash FROM tree_refs WHERE hash NOT IN (SELECT hash FROM tree_chunks JOIN tree_heads USING (path, file_id) WHERE file_id // 1000 % 3 <> 1) AND substr(hash, 1, 1) <> 'a'", "tree_refs")
def garbage_after_unlink(t: Tables) -> DataFrame:
    """What is collected once every third file is gone; hashes that begin with 'a' are pinned."""
    cat = transitions.unlink(t.tree, t.tree["file_head"].where(F.call_function("div", F.col("file_id"), F.lit(1000)) % 3 == 1).select("path"))
    pins = cat["chunk"].where("hash LIKE 'a%'").select("hash")
    return transitions.collect_garbage(cat, pins)[1].select("hash")


# ---- operations


@query("SELECT id, CASE WHEN state = 'prepared' AND id % 2 = 0 THEN 'tail ' || CAST(id AS VARCHAR) ELSE '' END AS tail FROM write_ops", "write_ops")
def tails_set(t: Tables) -> DataFrame:
    ops = t.write_op.withColumn("tail", F.lit(b""))
    tails = ops.where("id % 2 = 0").select("id", F.concat(F.lit("tail "), F.col("id").cast("string")).cast("binary").alias("tail"))
    return transitions.set_tail(ops, tails).select("id", F.col("tail").cast("string").alias("tail"))


@query("SELECT id AS write_op_id FROM write_ops WHERE state <> 'committed'", "write_ops")
def leases_released(t: Tables) -> DataFrame:
    held = t.write_op.select(F.col("id").alias("vlog_id"), F.col("id").alias("write_op_id"), F.lit(0).alias("ordinal"))
    return transitions.release(held, t.write_op.where("state = 'committed'")).select("write_op_id")


@query("SELECT min(id) AS write_op_id, id // 3 AS vlog_id FROM write_ops WHERE state = 'prepared' AND id // 3 % 5 <> 0 GROUP BY id // 3", "write_ops")
def leases_claimed(t: Tables) -> DataFrame:
    """Operations ask for logs in threes; every fifth log is leased already, and the lowest prepared operation gets a free one."""
    log = F.call_function("div", F.col("id"), F.lit(3))
    wanted = t.write_op.select(F.col("id").alias("write_op_id"), log.alias("vlog_id"))
    taken = wanted.where("vlog_id % 5 = 0").select("vlog_id").distinct().select("vlog_id", F.lit(-1).cast("long").alias("write_op_id"), F.lit(0).alias("ordinal"))
    after, _ = transitions.claim({"write_op": t.write_op, "vlog_lease": taken}, wanted)
    return after["vlog_lease"].where("write_op_id >= 0").select("write_op_id", "vlog_id")


@query("SELECT idempotency_key, min(created_at) AS created_at, count(*) AS opens FROM write_ops GROUP BY 1", "write_ops")
def keys_bound(t: Tables) -> DataFrame:
    """Every open with a known key gets that key's operation."""
    made = transitions.create_write_ops(schema.empty(t.spark, "write_op"), t.write_op.select("idempotency_key", "path", "created_at"))
    bound = transitions.bind(made, t.write_op.select("idempotency_key", "path"))
    return bound.join(made.select(F.col("id").alias("op_id"), "created_at"), "op_id").groupBy("idempotency_key", "created_at").agg(F.count("*").alias("opens"))


@query("SELECT id, CASE WHEN state = 'prepared' AND id % 2 = 1 THEN 'cancelled' ELSE state END AS state FROM (SELECT id, CASE state WHEN 'prepared' THEN 'prepared' ELSE state END AS state FROM write_ops)", "write_ops")
def jobs_ended(t: Tables) -> DataFrame:
    """Running jobs of the odd ids are cancelled, ended ones stay as they are."""
    jobs = t.write_op.select("id", F.when(F.col("state") == "prepared", "running").otherwise(F.col("state")).alias("state"))
    after = transitions.end_jobs(jobs, jobs.where("id % 2 = 1").select("id"), "cancelled")
    return after.select("id", F.when(F.col("state") == "running", "prepared").otherwise(F.col("state")).alias("state"))


# ---- logs, disks, nodes


@query("SELECT (SELECT max(id) FROM vlog) + 1 AS vlog_id, shard_idx, (SELECT max(plog_id) FROM placed) + 1 + shard_idx AS plog_id, disk_id FROM (SELECT row_number() OVER (ORDER BY disk_id) - 1 AS shard_idx, disk_id FROM (SELECT node_id, min(disk_id) AS disk_id FROM states WHERE up GROUP BY 1)) WHERE shard_idx < 3", "vlog placed states")
def provisioned_log(t: Tables) -> DataFrame:
    """A coded log of 2 + 1 shards on the first live disks of three nodes."""
    targets = planners.first_per_node(t.disk, t.node, planners.shards_wanted("EC", 2, 1))
    cat = transitions.provision({"vlog": t.vlog.withColumn("uid", F.lit("")), "vlog_plog": _bridge(t), "plog": _plogs(t)}, ("EC", 2, 1), targets)
    new = cat["vlog"].join(t.vlog.select("id"), "id", "left_anti").select(F.col("id").alias("vlog_id"))
    return catalog.placements(cat["vlog_plog"].join(new, "vlog_id", "left_semi"), cat["plog"]).select("vlog_id", "shard_idx", "plog_id", "disk_id")


@query(f"SELECT vlog_id, shard_idx, CASE WHEN plog_id = {LOG * 1000} THEN -5 ELSE plog_id END AS plog_id FROM placed", "placed")
def replaced_shard(t: Tables) -> DataFrame:
    return transitions.replace_shard({"vlog_plog": _bridge(t), "plog": _plogs(t)}, LOG, 0, LOG * 1000, -5)["vlog_plog"]


@query("SELECT 'vlog' AS tab, id FROM vlog WHERE id % 10 <> 3 UNION ALL SELECT 'plog', plog_id FROM placed WHERE vlog_id % 10 <> 3", "vlog placed")
def retired_logs(t: Tables) -> DataFrame:
    """Logs without live chunks go with all their shards."""
    cat = {"vlog": t.vlog, "vlog_plog": _bridge(t), "plog": _plogs(t), "chunk": t.doc_chunks.withColumn("vlog_id", F.lit(4).cast("long"))}
    after = transitions.retire_vlogs(cat, t.vlog.where("id % 10 = 3").select(F.col("id").alias("vlog_id")))
    return after["vlog"].select(F.lit("vlog").alias("tab"), "id").unionByName(after["plog"].select(F.lit("plog").alias("tab"), "id"))


@query("SELECT hash, CASE WHEN refcount > 0 THEN vlog_id + 100 ELSE vlog_id END AS vlog_id FROM doc_chunks", "doc_chunks")
def relocated_chunks(t: Tables) -> DataFrame:
    """The catalog after every log's live chunks are repacked elsewhere; dead ones stay behind."""
    sources = t.doc_chunks.select("vlog_id").distinct().withColumn("dest_vlog", F.col("vlog_id") + 100)
    return transitions.relocate(t.doc_chunks, planners.repack(t.doc_chunks, sources)).select("hash", "vlog_id")


@query("SELECT plog_id AS id, CASE WHEN disk_id % 4 = 1 THEN disk_id + 1 ELSE disk_id END AS disk_id, CASE WHEN disk_id % 4 = 1 THEN length + 1 ELSE length END AS length FROM placed", "placed")
def moved_shards(t: Tables) -> DataFrame:
    changes = _plogs(t).where("disk_id % 4 = 1").select("id", (F.col("disk_id") + 1).alias("disk_id"), (F.col("length") + 1).alias("length"))
    return transitions.update(_plogs(t), changes, "id", "disk_id", "length", strict=True).select("id", "disk_id", "length")


@query("SELECT id, CASE WHEN id % 5 = 2 THEN 'failed' ELSE state END AS state FROM disk", "disk")
def disk_states_set(t: Tables) -> DataFrame:
    return transitions.update(t.disk, t.disk.where("id % 5 = 2").select("id", F.lit("failed").alias("state")), "id", "state", strict=True).select("id", "state")


@query("SELECT id, state FROM node UNION ALL SELECT id + 1000, 'working' FROM node WHERE id % 2 = 0", "node")
def nodes_registered(t: Tables) -> DataFrame:
    """Known nodes stay as they are; new ones are added once, however often they come."""
    again = t.node.withColumn("state", F.lit("working"))
    new = t.node.where("id % 2 = 0").select((F.col("id") + 1000).alias("id"), F.lit("working").alias("state"))
    return transitions.insert_if_absent(t.node, again.unionByName(new).unionByName(new), "id")


@query("SELECT id AS name, CASE WHEN id % 3 = 0 THEN 'EC' ELSE state END AS scheme FROM disk", "disk")
def policies_set(t: Tables) -> DataFrame:
    table = t.disk.select(F.col("id").alias("name"), F.col("state").alias("scheme"))
    return transitions.upsert(table, table.where("name % 3 = 0").withColumn("scheme", F.lit("EC")), "name")


@query(f"SELECT id, CASE WHEN node_id = {LOG} AND state = 'failed' AND id % 2 = 0 THEN 'active' ELSE state END AS state FROM disk", "disk")
def disks_of_a_returned_node(t: Tables) -> DataFrame:
    """Failed disks become active again where their reprotection still runs: here those with even ids."""
    zero = F.lit(0).cast("long")
    jobs = t.disk.where("id % 2 = 0").select("id", F.lit("reprotect").alias("kind"), F.lit("running").alias("state"), F.col("id").alias("target_disk"), zero.alias("target_vlog"))
    return transitions.node_returned({"disk": t.disk, "node": t.node, "job": jobs}, LOG)["disk"].select("id", "state")


# ---- plans


@query(
    """SELECT vlog_id, cnt AS "count", CAST(padded AS BIGINT) AS padded, cnt = n AS drains FROM (
  SELECT *, row_number() OVER (PARTITION BY vlog_id ORDER BY pad, cnt DESC) AS best FROM (
    SELECT vlog_id, cnt, n, (total + 7999) // 8000 * 8000 AS padded, (total + 7999) // 8000 * 8000 - total AS pad FROM (
      SELECT vlog_id, row_number() OVER w AS cnt, count(*) OVER (PARTITION BY vlog_id) AS n, sum(compressed_len + 64) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM doc_chunks WHERE refcount > 0 AND vlog_id % 2 = 0 WINDOW w AS (PARTITION BY vlog_id ORDER BY vaddr_offset, hash))
    WHERE total >= 8000)) WHERE best = 1""",
    "doc_chunks",
)
def promotion_plan(t: Tables) -> DataFrame:
    """Of each staging log (the even ones): the chunks to code, and whether that drains it."""
    staged = F.when(F.col("vlog_id") % 2 == 0, 1).otherwise(0)
    v = t.doc_chunks.select("vlog_id").distinct().select(F.col("vlog_id").alias("id"), (staged * 2).alias("target_data_shards"), staged.alias("target_parity_shards"))
    return planners.promotions(v, t.doc_chunks, 8000).select("vlog_id", "count", "padded", "drains")


@query("SELECT DISTINCT vlog_id FROM doc_chunks WHERE hash IN (SELECT hash FROM doc_rows WHERE doc_id IN (SELECT doc_id FROM labels))", "doc_chunks")
def compacted_logs_that_stay(t: Tables) -> DataFrame:
    pins = t.doc_rows.join(t.raw("labels").select("doc_id"), "doc_id", "left_semi").select("hash")
    return planners.unfinished(t.doc_chunks.select("vlog_id").distinct(), t.doc_chunks, pins)


@query(
    """SELECT id, CASE WHEN id % 2 = 0 THEN (target_data_shards = 2 AND target_parity_shards = 1) ELSE (protection_scheme = 'DUPLICATE' AND data_shards = 1 AND target_data_shards = 0) END AS matches FROM vlog""",
    "vlog",
)
def policy_matches(t: Tables) -> DataFrame:
    """May a log take writes of a coded policy (even ids) or of plain copies (odd ids)?"""
    coded = F.col("id") % 2 == 0
    v = t.vlog.withColumn("wanted", F.struct(F.when(coded, "EC").otherwise("DUPLICATE").alias("protection_scheme"), F.when(coded, 2).otherwise(1).alias("data_shards"), F.when(coded, 1).otherwise(0).alias("parity_shards")))
    return v.alias("v").select("v.*", F.col("v.wanted").alias("p")).select("id", F.struct(*t.vlog.columns).alias("l"), "p").select("id", policy.matches_policy("l", "p").alias("matches"))


@query("SELECT event_id AS id, CASE WHEN event_id * 1000 > 4194304 THEN event_id * 1000 - 262144 ELSE 0 END AS spilled FROM events")
def spill_sizes(t: Tables) -> DataFrame:
    return t.raw("events").select(F.col("event_id").alias("id"), ordered.spill(F.col("event_id") * 1000).alias("spilled"))


# ---- functions


@query("SELECT page_id, '/x/' || path AS given, 'x/' || path AS cleaned, regexp_replace(path, '^.*/', '') AS base, 'top/' || path AS joined, replace(replace(path, '_', '\\_'), '%', '\\%') AS escaped FROM (SELECT page_id, path FROM page_paths WHERE NOT ends_with(path, '/') AND path <> '')", "page_paths")
def path_forms(t: Tables) -> DataFrame:
    p = F.col("path")
    given = F.concat(F.lit("/x/"), p)
    x = t.page_paths.where(~F.endswith(p, F.lit("/")) & (p != ""))
    return x.select("page_id", given.alias("given"), paths.clean(given).alias("cleaned"), paths.base(p).alias("base"), paths.join(F.lit("top"), p).alias("joined"), paths.escape_like(p).alias("escaped"))


@query("SELECT event_id AS id, strftime(make_timestamp(event_id * 1234567), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def times_of_ns(t: Tables) -> DataFrame:
    return t.raw("events").select(F.col("event_id").alias("id"), F.date_format(policy.ns_to_timestamp(F.col("event_id") * 1_234_567_000), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT doc_id, 4096 + doc_id * 1048576 + 1044480 AS at, left(sha256(text), 32) AS hash FROM documents")
def hash_sectors(t: Tables) -> DataFrame:
    """Where each block keeps its hashes, and a sector's hash."""
    return t.raw("documents").select("doc_id", layout.hash_sector(F.col("doc_id")).alias("at"), ids.sector_hash(F.col("text")).alias("hash"))


@query("SELECT p_partkey AS name, 'DUPLICATE' AS protection_scheme, CAST(p_size AS INTEGER) AS data_shards, 0 AS parity_shards FROM (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_size FROM part)")
def evolved_table(t: Tables) -> DataFrame:
    """An old table in today's schema: a missing column gets its default, others are cast, extra ones go."""
    old = t.raw("part").select(F.col("p_partkey").alias("name"), F.col("p_size").cast("long").alias("data_shards"), F.lit(1).alias("extra"))
    return schema.evolve(old, "bucket", {"protection_scheme": "DUPLICATE"})


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(event_id) AS newest, count(*) AS events FROM (SELECT event_id, ts FROM events) GROUP BY 1")
def events_by_day(t: Tables) -> DataFrame:
    x = t.raw("events").select(F.col("ts").cast("timestamp").alias("at"), "event_id")
    days = write_ops.daily(x).select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "events")
    last = x.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.max("event_id").alias("newest"))
    return days.join(last, "day").select("day", "newest", "events")


# ---- bytes in shards

_WIDTH = 8192


def _records(t: Tables) -> DataFrame:
    """Documents as records of 16 logs, one behind the other."""
    x = t.raw("documents").where("octet_length(text) > 0").select("doc_id", (F.col("doc_id") % 16).alias("vlog_id"), F.col("text").cast("binary").alias("data"))
    x = ordered.extents(x.withColumn("bytes", F.octet_length("data").cast("long") + schema.HEADER_BYTES), ["vlog_id"], ["doc_id"], "bytes", "vaddr_offset", "__end", spread=True)
    return x.select("doc_id", "vlog_id", "vaddr_offset", (F.col("bytes") - schema.HEADER_BYTES).alias("len"), "data")


def _three_shards(t: Tables) -> DataFrame:
    x = t.spark.range(16).select(F.col("id").alias("vlog_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("shard_idx"))
    return x.withColumn("plog_id", F.col("vlog_id") * 10 + F.col("shard_idx"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS digest FROM documents WHERE octet_length(encode(text)) > 0")
def coded_records_read(t: Tables) -> DataFrame:
    """Records in coded rows of 2 + 1 shards, read back when one shard of every log is gone."""
    records = _records(t)
    good = shards.healthy(shards.coded(records, _three_shards(t), 2, 1, _WIDTH)).where("shard_idx <> vlog_id % 3")
    back = shards.read_coded(records.drop("data"), good, 2, 1, _WIDTH, "doc_id")
    return back.select("doc_id", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("digest"))


@query(
    f"SELECT vlog_id, CAST((sum(n) + {_WIDTH - 1}) // {_WIDTH} AS BIGINT) AS rows, CAST((sum(n) + {_WIDTH - 1}) // {_WIDTH} AS BIGINT) AS equal FROM (SELECT doc_id % 16 AS vlog_id, octet_length(encode(text)) + 64 AS n FROM documents WHERE octet_length(encode(text)) > 0) GROUP BY 1"
)
def shards_rebuilt(t: Tables) -> DataFrame:
    """One shard of every log made again from the others, and how many of its rows equal the lost ones."""
    every = shards.coded(_records(t), _three_shards(t), 2, 1, _WIDTH)
    lost = _three_shards(t).where("shard_idx = (vlog_id + 1) % 3")
    again = shards.rebuilt(lost, every, 2, 1).select("plog_id", "row", F.col("digest").alias("new"))
    both = every.join(lost.select("plog_id"), "plog_id", "left_semi").join(again, ["plog_id", "row"], "left")
    return both.groupBy("vlog_id").agg(F.count("*").alias("rows"), F.count_if(F.col("new") == F.col("digest")).alias("equal"))


@query("SELECT doc_id % 16 * 10 + shard_idx AS plog_id, count(*) AS rows, count(*) FILTER (WHERE doc_id % 7 = 0 AND shard_idx = 1) AS corrupt FROM documents, (VALUES (0), (1), (2)) s(shard_idx) WHERE octet_length(encode(text)) > 0 GROUP BY 1")
def shards_scrubbed(t: Tables) -> DataFrame:
    """Copies of records, some of them damaged in the second copy."""
    records = _records(t)
    copies = shards.mirrored(records, _three_shards(t))
    bad = records.where("doc_id % 7 = 0").select("vlog_id", F.col("vaddr_offset").alias("row"), F.lit(1).alias("shard_idx"), F.lit(True).alias("bad"))
    broken = copies.join(bad, ["vlog_id", "row", "shard_idx"], "left").withColumn("shard", F.when(F.col("bad"), F.concat("shard", F.lit(b"?"))).otherwise(F.col("shard")))
    return shards.scrub(broken)
