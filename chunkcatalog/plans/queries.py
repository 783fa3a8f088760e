"""Every query of the engine over the driver's tables, next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkcatalog.functions import ids, layout, paths, policy
from chunkcatalog.operators import bytes as bytes_
from chunkcatalog.operators import catalog, ordered, planners, transitions
from chunkcatalog.plans.fixtures import Tables, with_tables
from chunkcatalog.plans.store import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DISK, NODE, DEST = 3, 7, 5


def query(sql: str | None = None, tables: str = ""):
    """Registers a function of ``Tables`` under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_tables(tables, sql)
        return f

    return register


# ---- space


@query("SELECT vlog_id, total_bytes, live_bytes, dead_bytes FROM usage", "usage")
def vlog_usage(t: Tables) -> DataFrame:
    return catalog.vlog_usage(t.part_logs, t.part_chunks).select("vlog_id", "total_bytes", "live_bytes", "dead_bytes")


_COMPACTION = planners.CompactionPolicy(least_dead=200, max_jobs=50)


@query("SELECT vlog_id, total_bytes, live_bytes, dead_bytes FROM usage WHERE total_bytes > 0 AND dead_bytes >= 200 AND dead_bytes * 4 >= total_bytes ORDER BY dead_bytes DESC, vlog_id LIMIT 50", "usage")
def compaction_candidates(t: Tables) -> DataFrame:
    return planners.compaction_candidates(catalog.vlog_usage(t.part_logs, t.part_chunks), _COMPACTION).select("vlog_id", "total_bytes", "live_bytes", "dead_bytes")


@query("SELECT hash, vlog_id + 100 AS vlog_id, CAST(sum(compressed_len + 64) OVER (PARTITION BY vlog_id ORDER BY vaddr_offset, hash) - compressed_len - 64 AS BIGINT) AS vaddr_offset FROM doc_chunks WHERE refcount > 0", "doc_chunks")
def compaction_moves(t: Tables) -> DataFrame:
    sources = t.doc_chunks.select("vlog_id").distinct().withColumn("dest_vlog", F.col("vlog_id") + 100)
    return planners.repack(t.doc_chunks, sources)


@query("SELECT vlog_id, CAST(sum(compressed_len + 64) AS BIGINT) AS payload, CAST((sum(compressed_len + 64) + 9999) // 10000 * 10000 AS BIGINT) AS padded FROM doc_chunks WHERE refcount > 0 GROUP BY vlog_id", "doc_chunks")
def padded_rows(t: Tables) -> DataFrame:
    return planners.repacked_length(t.doc_chunks, t.doc_chunks.select("vlog_id").distinct(), 10_000)


@query(
    """SELECT vlog_id, cnt AS "count", CAST(padded AS BIGINT) AS padded, CAST(pad AS BIGINT) AS pad FROM (
  SELECT *, row_number() OVER (PARTITION BY vlog_id ORDER BY pad, cnt DESC) AS best FROM (
    SELECT vlog_id, cnt, (total + 7999) // 8000 * 8000 AS padded, (total + 7999) // 8000 * 8000 - total AS pad FROM (
      SELECT vlog_id, row_number() OVER w AS cnt, sum(compressed_len + 64) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM doc_chunks WHERE refcount > 0 WINDOW w AS (PARTITION BY vlog_id ORDER BY vaddr_offset, hash))
    WHERE total >= 8000)) WHERE best = 1""",
    "doc_chunks",
)
def promotable_prefix(t: Tables) -> DataFrame:
    return ordered.promotable_prefix(t.doc_chunks.where("refcount > 0"), ["vlog_id"], ["vaddr_offset", "hash"], "compressed_len", 8000)


# ---- placement


@query("SELECT vlog_id, shard_idx, plog_id, disk_id, length FROM placed", "placed")
def placement_all(t: Tables) -> DataFrame:
    bridge, plogs = t.placed.select("vlog_id", "shard_idx", "plog_id"), t.placed.select(F.col("plog_id").alias("id"), "disk_id", "length")
    return catalog.placements(bridge, plogs)


@query("SELECT disk_id, count(*) AS plogs FROM placed GROUP BY disk_id", "placed")
def plog_counts_by_disk(t: Tables) -> DataFrame:
    return catalog.plog_counts(t.placed)


@query("SELECT disk_id, CAST(sum(length) AS BIGINT) AS bytes FROM placed GROUP BY disk_id", "placed")
def disk_usage_bytes(t: Tables) -> DataFrame:
    return catalog.disk_bytes(t.placed)


@query("SELECT arg_max(disk_id, (b, -disk_id)) AS fullest, CAST(max(b) AS BIGINT) AS most, arg_min(disk_id, (b, disk_id)) AS emptiest, CAST(min(b) AS BIGINT) AS least FROM (SELECT disk_id, sum(length) AS b FROM placed GROUP BY 1)", "placed")
def disk_extremes(t: Tables) -> DataFrame:
    return catalog.extremes(catalog.disk_bytes(t.placed))


_READY = """SELECT vlog_id, total, live, live = total AS commit_ready, live >= data_shards AS readable,
  live >= CASE protection_scheme WHEN 'EC' THEN data_shards + parity_shards WHEN 'DUPLICATE' THEN least(2, total) ELSE 1 END AS can_commit,
  live >= CASE protection_scheme WHEN 'EC' THEN data_shards ELSE 1 END AS can_read
FROM vlog JOIN (SELECT vlog_id, count(*) AS total, count(*) FILTER (WHERE up) AS live FROM {placed} JOIN states USING (disk_id) GROUP BY 1) ON vlog_id = id"""


@query(_READY.format(placed="placed"), "vlog placed states")
def readiness(t: Tables) -> DataFrame:
    return catalog.readiness(t.vlog, t.placed, t.disk, t.node)


@query(f"SELECT count(*) AS vlogs, count(*) FILTER (WHERE commit_ready) AS commit_ready, count(*) FILTER (WHERE readable) AS readable FROM ({_READY.format(placed='placed')})", "vlog placed states")
def readiness_totals(t: Tables) -> DataFrame:
    return catalog.readiness_totals(readiness(t))


@query(_READY.format(placed=f"(SELECT * FROM placed WHERE vlog_id IN (SELECT vlog_id FROM placed WHERE disk_id = {DISK}))"), "vlog placed states")
def readiness_on_disk(t: Tables) -> DataFrame:
    return catalog.readiness(t.vlog, catalog.on_disk(t.placed, DISK), t.disk, t.node)


@query(_READY.format(placed=f"(SELECT * FROM placed WHERE vlog_id IN (SELECT vlog_id FROM placed WHERE disk_id IN (SELECT id FROM disk WHERE node_id = {NODE})))"), "vlog placed states")
def readiness_on_node(t: Tables) -> DataFrame:
    return catalog.readiness(t.vlog, catalog.on_node(t.placed, t.disk, NODE), t.disk, t.node)


@query("SELECT vlog_id, count(*) AS shards, count(DISTINCT node_id) AS nodes, count(*) - count(DISTINCT node_id) AS colocated FROM placed JOIN disk ON disk_id = id GROUP BY 1", "placed disk")
def placement_audit(t: Tables) -> DataFrame:
    return catalog.colocation(t.placed, t.disk)


@query("SELECT disk_id, node_id, disk_state, node_state FROM states", "states")
def disk_states(t: Tables) -> DataFrame:
    return catalog.disk_states(t.disk, t.node)


@query("SELECT row_number() OVER (ORDER BY disk_id) - 1 AS shard_idx, disk_id, node_id FROM (SELECT node_id, min(disk_id) AS disk_id FROM states WHERE up GROUP BY 1)", "states")
def provision_first_per_node(t: Tables) -> DataFrame:
    return planners.first_per_node(t.disk, t.node)


_DESTINATIONS = """SELECT m.vlog_id, m.shard_idx, m.plog_id, min(s.disk_id) AS dest_disk
FROM ({moving}) m LEFT JOIN states s ON s.up AND NOT EXISTS (SELECT 1 FROM placed p JOIN states q USING (disk_id) WHERE p.vlog_id = m.vlog_id AND p.plog_id <> m.plog_id AND q.node_id = s.node_id)
GROUP BY ALL"""


@query(_DESTINATIONS.format(moving=f"SELECT * FROM placed WHERE disk_id = {DISK}").replace("m.plog_id, min", "m.plog_id, min"), "placed states")
def drain_destinations(t: Tables) -> DataFrame:
    return planners.drain(DISK, settle(t.placed), t.disk, t.node)


@query(
    f"SELECT d.*, coalesce(n, 0) AS sources FROM ({_DESTINATIONS.format(moving="SELECT * FROM placed JOIN states USING (disk_id) WHERE disk_state IN ('failed', 'draining')")}) d LEFT JOIN (SELECT vlog_id, count(*) AS n FROM placed JOIN states USING (disk_id) WHERE reachable GROUP BY 1) USING (vlog_id)",
    "placed states",
)
def reprotect_plan(t: Tables) -> DataFrame:
    return planners.reprotect(settle(t.placed), t.disk, t.node)


@query(
    f"""SELECT m.vlog_id, m.shard_idx, m.plog_id, {DEST} AS dest_disk, d.up AND NOT EXISTS (SELECT 1 FROM placed p JOIN states q USING (disk_id) WHERE p.vlog_id = m.vlog_id AND p.plog_id <> m.plog_id AND q.node_id = d.node_id) AS allowed
FROM placed m, (SELECT * FROM states WHERE disk_id = {DEST}) d WHERE m.disk_id = {DISK}""",
    "placed states",
)
def replace_plan(t: Tables) -> DataFrame:
    return planners.replace(DISK, DEST, settle(t.placed), t.disk, t.node)


def _corrupt(t: Tables) -> DataFrame:
    return t.placed.where(F.col("plog_id") % 13 == 0).select("plog_id")


@query(
    """SELECT vlog_id, bad, good, needed, CASE WHEN bad = 0 THEN 'healthy' WHEN good >= needed THEN 'repair' ELSE 'unrepairable' END AS action FROM (
  SELECT vlog_id, count(*) FILTER (WHERE NOT (reachable AND plog_id % 13 <> 0)) AS bad, count(*) FILTER (WHERE reachable AND plog_id % 13 <> 0) AS good FROM placed JOIN states USING (disk_id) GROUP BY 1)
JOIN (SELECT id, CASE WHEN protection_scheme = 'EC' THEN data_shards ELSE 1 END AS needed FROM vlog) ON id = vlog_id""",
    "vlog placed states",
)
def repair_actions(t: Tables) -> DataFrame:
    return planners.repair(t.vlog, t.placed, t.disk, t.node, _corrupt(t))


@query(
    f"""SELECT vlog_id, shard_idx, plog_id, coalesce(away, CASE WHEN own_up THEN own END) AS dest_disk, away IS NULL AND own_up AS is_own FROM (
  SELECT d.vlog_id, d.shard_idx, d.plog_id, nullif(d.dest_disk, p.disk_id) AS away, p.disk_id AS own, s.up AS own_up
  FROM ({_DESTINATIONS.format(moving="SELECT * FROM placed WHERE plog_id % 13 = 0")}) d JOIN placed p ON p.plog_id = d.plog_id JOIN states s ON s.disk_id = p.disk_id)""",
    "placed states",
)
def repair_destinations(t: Tables) -> DataFrame:
    placed = settle(t.placed)
    return planners.repair_destinations(placed.where(F.col("plog_id") % 13 == 0).select("vlog_id", "shard_idx", "plog_id"), placed, t.disk, t.node)


@query()
def rebalance_plan(t: Tables) -> DataFrame:
    return planners.rebalance(t.placed, t.disk, t.node, planners.RebalancePolicy(band=1000, max_moves=4), of_logs=t.placed_of)


@query("SELECT plog_id, least(p.length, CASE WHEN protection_scheme = 'EC' THEN v.length // data_shards ELSE v.length END) AS length FROM placed p JOIN vlog v ON p.vlog_id = v.id", "placed vlog")
def reconciled_lengths(t: Tables) -> DataFrame:
    return transitions.reconciled_lengths(t.vlog, t.placed)


@query("SELECT vlog_id, count(*) AS shards, CAST(sum(length // 4096) AS BIGINT) AS sectors, CAST(sum(CASE WHEN plog_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS corrupt, CAST(sum(CASE WHEN plog_id % 29 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_blocks, coalesce(string_agg(CAST(shard_idx AS VARCHAR), ',' ORDER BY shard_idx) FILTER (WHERE plog_id % 13 = 0 OR plog_id % 29 = 0), '') AS unhealthy FROM placed GROUP BY 1", "placed")
def scrub_rollup(t: Tables) -> DataFrame:
    n = F.col("plog_id")
    x = t.placed.select("vlog_id", "shard_idx", F.call_function("div", F.col("length"), F.lit(4096)).alias("sectors"), F.when(n % 13 == 0, 1).otherwise(0).alias("corrupt"), F.when(n % 29 == 0, 1).otherwise(0).alias("bad_blocks"))
    return catalog.scrub_rollup(x).withColumn("unhealthy", F.array_join("unhealthy", ","))


@query("SELECT txn, disks = n AND shards = n AS valid FROM (SELECT vlog_id AS txn, count(*) AS n, count(DISTINCT disk_id) AS disks, count(DISTINCT shard_idx) AS shards FROM placed GROUP BY 1)", "placed")
def commit_validation(t: Tables) -> DataFrame:
    return planners.valid_commits(t.placed.select(F.col("vlog_id").alias("txn"), F.col("shard_idx").alias("shard"), "disk_id"))


# ---- chunks


@query("SELECT hash, count(*) AS refcount, min(doc_id) AS first_doc FROM doc_rows GROUP BY hash", "doc_rows")
def dedup_chunks(t: Tables) -> DataFrame:
    zero = F.lit(0).cast("long")
    batch = t.doc_rows.select(F.col("doc_id").alias("pos"), "hash", F.col("doc_id").alias("vlog_id"), zero.alias("vaddr_offset"), F.col("len").alias("logical_len"), F.col("len").alias("compressed_len"))
    empty = t.spark.createDataFrame([], "hash string, refcount bigint, vlog_id bigint, vaddr_offset bigint, logical_len bigint, compressed_len bigint")
    return transitions.upsert_chunks(empty, batch).select("hash", "refcount", F.col("vlog_id").alias("first_doc"))


@query("SELECT bucket, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(n * len) AS BIGINT) AS bytes, CAST(sum(len) AS BIGINT) AS distinct_bytes FROM (SELECT bucket, hash, len, count(*) AS n FROM doc_rows GROUP BY ALL) GROUP BY bucket", "doc_rows")
def dedup_by_bucket(t: Tables) -> DataFrame:
    return catalog.dedup_by(t.doc_rows, "bucket")


@query("SELECT doc_id, hash, refcount, vlog_id FROM doc_rows JOIN doc_chunks USING (hash) WHERE refcount > 0", "doc_chunks")
def live_chunk_probe(t: Tables) -> DataFrame:
    return catalog.probe(t.doc_rows.select("doc_id", "hash"), t.doc_chunks).select("doc_id", "hash", "refcount", "vlog_id")


@query("SELECT hash, vlog_id, vaddr_offset, compressed_len FROM doc_chunks WHERE vaddr_offset + 64 + compressed_len > 5000000 AND vaddr_offset + 64 < 90000000", "doc_chunks")
def range_overlap(t: Tables) -> DataFrame:
    return catalog.in_range(t.doc_chunks, 5_000_000, 90_000_000).select("hash", "vlog_id", "vaddr_offset", "compressed_len")


@query("SELECT DISTINCT vlog_id FROM doc_chunks WHERE hash IN (SELECT hash FROM doc_rows JOIN labels USING (doc_id))", "doc_chunks")
def vlogs_with_hashes(t: Tables) -> DataFrame:
    return catalog.holds_any(t.doc_chunks, t.doc_rows.join(t.raw("labels").select("doc_id"), "doc_id", "left_semi").select("hash"))


@query("SELECT hash, vlog_id, refcount FROM doc_chunks WHERE refcount <= 0 AND hash NOT IN (SELECT hash FROM doc_rows WHERE doc_id IN (SELECT doc_id FROM labels))", "doc_chunks")
def gc_collect(t: Tables) -> DataFrame:
    pins = t.doc_rows.join(t.raw("labels").select("doc_id"), "doc_id", "left_semi").select("hash")
    return planners.collectable(t.doc_chunks, pins).select("hash", "vlog_id", "refcount")


@query("SELECT hash, CAST(sum(n) AS BIGINT) AS refcount FROM (SELECT hash, count(*) AS n FROM conv_chunks JOIN conv_heads USING (file_id) GROUP BY 1 UNION ALL SELECT hash, count(*) FROM conv_chunks WHERE file_id % 1000 = 1 GROUP BY 1) GROUP BY 1", "conv_chunks conv_heads")
def refcount_recompute(t: Tables) -> DataFrame:
    heads = catalog.latest(t.conv_files).select("path", F.col("id").alias("file_id"))
    snapshot = t.conv_files.where(F.col("id") % 1000 == 1).select(F.lit(1).alias("snapshot_id"), "path", F.col("id").alias("file_id"))
    return catalog.refcounts(heads, snapshot, t.conv_files)


@query("SELECT path, file_id FROM conv_heads", "conv_heads")
def heads_latest(t: Tables) -> DataFrame:
    return catalog.latest(t.conv_files).select("path", F.col("id").alias("file_id"))


@query("SELECT file_id, pos, hash, len FROM conv_chunks", "conv_chunks")
def chunk_lists(t: Tables) -> DataFrame:
    return catalog.chunk_list(t.conv_files)


@query(
    """SELECT path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a <> b THEN 'changed' END AS change
FROM (SELECT conv_id % 1000 AS k, 'conv/' || CAST(conv_id AS VARCHAR) AS path, max(conv_id * 1000 + turn) AS a FROM conversations WHERE turn <= 2 AND conv_id % 5 <> 0 GROUP BY ALL)
FULL JOIN (SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS path, max(conv_id * 1000 + turn) AS b FROM conversations WHERE conv_id % 7 <> 0 GROUP BY ALL) USING (path)
WHERE a IS NULL OR b IS NULL OR a <> b"""
)
def snapshot_diff(t: Tables) -> DataFrame:
    conv, turn = F.call_function("div", F.col("id"), F.lit(1000)), F.col("id") % 1000
    old = catalog.latest(t.conv_files.where((turn <= 2) & (conv % 5 != 0))).select(F.lit(1).alias("snapshot_id"), "path", F.col("id").alias("file_id"))
    new = catalog.latest(t.conv_files.where(conv % 7 != 0)).select(F.lit(2).alias("snapshot_id"), "path", F.col("id").alias("file_id"))
    return transitions.snapshot_diff({"snapshot_file": old.unionByName(new)}, 1, 2)


_RETENTION_NOW = 1_706_572_800


@query(
    f"""SELECT id, created_at, dn = 1 AND {_RETENTION_NOW} - created_at < 7 * 86400 AS daily, wn = 1 AND {_RETENTION_NOW} - created_at < 4 * 604800 AS weekly FROM (
  SELECT id, created_at, row_number() OVER (PARTITION BY created_at // 86400 ORDER BY created_at DESC, id DESC) AS dn, row_number() OVER (PARTITION BY created_at // 604800 ORDER BY created_at DESC, id DESC) AS wn
  FROM (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events))
WHERE (dn = 1 AND {_RETENTION_NOW} - created_at < 7 * 86400) OR (wn = 1 AND {_RETENTION_NOW} - created_at < 4 * 604800)"""
)
def snapshot_retention(t: Tables) -> DataFrame:
    x = t.raw("events").select(F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"))
    return ordered.retention(x, F.lit(_RETENTION_NOW), 86400).select("id", "created_at", "daily", "weekly")


@query("SELECT path, md5(string_agg(hash || ':' || CAST(len AS VARCHAR), ',' ORDER BY pos)) AS list_md5, CAST(sum(len) AS BIGINT) AS size, count(*) AS chunks FROM conv_chunks JOIN conv_heads USING (path, file_id) GROUP BY path", "conv_chunks conv_heads")
def packed_file_list(t: Tables) -> DataFrame:
    """Packs and unpacks each head's list, and says what comes out."""
    x = catalog.latest(t.conv_files).withColumn("back", ids.unpack(ids.pack(F.col("chunks"))))
    text = F.array_join(F.transform("back", lambda c: F.concat(c["hash"], F.lit(":"), c["len"].cast("string"))), ",")
    return x.select("path", F.md5(text).alias("list_md5"), ids.list_size(F.col("back")).alias("size"), F.size("back").cast("long").alias("chunks"))


@query("SELECT file_id, pos, lag(hash, 1, '0') OVER w AS prev, pos = 0 AS is_initial, lead(hash) OVER w IS NULL AS is_last FROM conv_chunks JOIN conv_heads USING (path, file_id) WINDOW w AS (PARTITION BY file_id ORDER BY pos)", "conv_chunks conv_heads")
def hash_chain(t: Tables) -> DataFrame:
    x = catalog.chunk_list(catalog.latest(t.conv_files))
    return ordered.hash_chain(x, ["file_id"], ["pos"], "hash").select("file_id", "pos", "prev", "is_initial", "is_last")


# ---- namespace


@query("SELECT page_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_replace(path, '^.*/', '') AS name, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS bucket FROM page_paths", "page_paths")
def path_split(t: Tables) -> DataFrame:
    p = F.col("path")
    return t.page_paths.select("page_id", "path", paths.parent(p).alias("parent"), paths.name(p).alias("name"), paths.bucket(p).alias("bucket"))


@query("SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM (SELECT string_split(path, '/') AS parts FROM page_paths), range(1, 40) r(i) WHERE i < len(parts)", "page_paths")
def dir_ancestors(t: Tables) -> DataFrame:
    return catalog.implied_dirs(t.page_paths)


@query(
    """SELECT name, false AS is_dir, size FROM page_heads WHERE parent = (SELECT min(parent) FROM page_heads)
UNION ALL SELECT DISTINCT split_part(substr(path, length(d) + 2), '/', 1), true, 0 FROM page_heads, (SELECT min(parent) AS d FROM page_heads) WHERE starts_with(path, d || '/') AND contains(substr(path, length(d) + 2), '/')""",
    "page_heads",
)
def list_dir(t: Tables) -> DataFrame:
    heads = t.page_heads
    d = heads.agg(F.min("parent")).first()[0]
    one = F.array(F.struct(F.lit("").alias("hash"), F.col("size").cast("int").alias("len")))
    files = heads.select(F.col("file_id").alias("id"), one.alias("chunks"))
    dirs = catalog.implied_dirs(heads).select("path", paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"), F.lit(0).cast("long").alias("mtime"))
    return catalog.list_dir(d, heads.withColumn("mtime", F.lit(0).cast("long")), files, dirs).select("name", "is_dir", "size")


@query("SELECT path, CASE WHEN path = d OR starts_with(path, d || '/') THEN 'moved/here' || substr(path, length(d) + 1) ELSE path END AS new_path FROM page_heads, (SELECT max(parent) AS d FROM page_heads)", "page_heads")
def subtree_rename(t: Tables) -> DataFrame:
    d = t.page_heads.agg(F.max("parent")).first()[0]
    return t.page_heads.select("path", paths.moved(F.col("path"), d, "moved/here").alias("new_path"))


@query("SELECT name, CASE WHEN length(name) % 2 = 0 THEN 'EC' ELSE 'DUPLICATE' END AS protection_scheme, CASE WHEN length(name) % 2 = 0 THEN 2 ELSE 1 END AS data_shards, CASE WHEN length(name) % 2 = 0 THEN 1 ELSE 0 END AS parity_shards, length(name) % 2 = 0 AS found FROM (SELECT DISTINCT split_part(path, '/', 1) AS name FROM page_paths)", "page_paths")
def bucket_policies(t: Tables) -> DataFrame:
    names = t.page_paths.select(paths.bucket(F.col("path")).alias("name")).distinct()
    own = names.where(F.length("name") % 2 == 0).select("name", F.lit("EC").alias("protection_scheme"), F.lit(2).alias("data_shards"), F.lit(1).alias("parity_shards"))
    return catalog.policies_for(names, own)


# ---- order and intervals


@query('SELECT source, doc_id, start, "end" FROM extents', "extents")
def chunk_extents(t: Tables) -> DataFrame:
    return ordered.extents(t.doc_extents, ["source"], ["doc_id"], "bytes", spread=True).select("source", "doc_id", "start", "end")


@query("SELECT source, doc_id, (start + 100) // 50000 AS log_no, (start + 100) % 50000 AS \"offset\" FROM extents", "extents")
def append_offsets(t: Tables) -> DataFrame:
    return ordered.append_offsets(t.doc_extents, ["source"], ["doc_id"], "bytes", F.lit(100), 50_000, spread=True).select("source", "doc_id", "log_no", "offset")


@query(
    """SELECT source, sector, CAST(sum(least("end", (sector + 1) * 4096) - greatest(start, sector * 4096)) AS BIGINT) AS covered, sum(least("end", (sector + 1) * 4096) - greatest(start, sector * 4096)) = 4096 AS "full"
FROM extents, range(0, 100000) r(sector) WHERE sector BETWEEN start // 4096 AND ("end" - 1) // 4096 GROUP BY source, sector""",
    "extents",
)
def sector_coverage(t: Tables) -> DataFrame:
    return ordered.sector_coverage(_extents(t), ["source"])


def _extents(t: Tables) -> DataFrame:
    return ordered.extents(t.doc_extents, ["source"], ["doc_id"], "bytes", spread=True).select("source", "doc_id", "start", "end")


@query(
    """SELECT e.source, e.doc_id, read_id, greatest(e.start, r_lo) - e.start AS chunk_lo, least(e."end", r_hi) - e.start AS chunk_hi, greatest(e.start, r_lo) - r_lo AS out_at
FROM extents e JOIN (SELECT source, doc_id AS read_id, greatest(start - 300, 0) AS r_lo, "end" + doc_id % 5000 AS r_hi FROM extents) r ON e.source = r.source AND e."end" > r_lo AND e.start < r_hi""",
    "extents",
)
def read_plan(t: Tables) -> DataFrame:
    """A read around each document, which reaches into its neighbours."""
    x = _extents(t)
    reads = x.select("source", F.col("doc_id").alias("read_id"), F.greatest(F.col("start") - 300, F.lit(0)).alias("r_lo"), (F.col("end") + F.col("doc_id") % 5000).alias("r_hi"))
    return ordered.read_plan(x, reads, ["source"]).select("source", "doc_id", "read_id", "chunk_lo", "chunk_hi", "out_at")


@query(
    """SELECT source, doc_id, NOT EXISTS (SELECT 1 FROM (SELECT source, "end" + doc_id % 7 * 900 AS s_lo, "end" + doc_id % 7 * 900 + 60 AS s_hi FROM extents) r WHERE r.source = e.source AND e."end" > s_lo AND e.start < s_hi) AS clean FROM extents e""",
    "extents",
)
def splice_clean_chunks(t: Tables) -> DataFrame:
    """A dirty span of 60 bytes somewhere behind each document."""
    x = _extents(t)
    lo = F.col("end") + F.col("doc_id") % 7 * 900
    return ordered.splice(x, x.select("source", lo.alias("s_lo"), (lo + 60).alias("s_hi")), ["source"]).select("source", "doc_id", "clean")


@query(
    """SELECT source, min(start) AS start, max("end") AS "end", count(*) AS records FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT source, start, "end", CASE WHEN lag("end") OVER (PARTITION BY source ORDER BY start, "end") = start THEN 0 ELSE 1 END AS fresh FROM extents WHERE doc_id % 9 <> 0)) GROUP BY source, run""",
    "extents",
)
def run_coalesce(t: Tables) -> DataFrame:
    return ordered.runs(_extents(t).where(F.col("doc_id") % 9 != 0), ["source"])


@query(
    """SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS pieces FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi, seq ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans)) GROUP BY user_id, island""",
    "spans",
)
def span_merge(t: Tables) -> DataFrame:
    return ordered.islands(t.event_spans, ["user_id"])


@query(
    """SELECT user_id, min(p) AS lo, max(p) + 1 AS hi, max(seq) AS seq FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN lag(p) OVER w = p - 1 AND lag(seq) OVER w = seq THEN 0 ELSE 1 END AS fresh FROM (
      SELECT user_id, p, max(seq) AS seq FROM spans, range(0, 600) r(p) WHERE p >= lo AND p < hi GROUP BY ALL) WINDOW w AS (PARTITION BY user_id ORDER BY p))) GROUP BY user_id, run""",
    "spans",
)
def overlay_lww(t: Tables) -> DataFrame:
    return ordered.overlay(t.event_spans, ["user_id"])


@query("SELECT user_id, seq, lo, least(hi, 300) AS hi FROM spans WHERE lo < 300", "spans")
def truncate_spans(t: Tables) -> DataFrame:
    return ordered.truncate(t.event_spans, 300)


# ---- scalar functions


@query(
    """SELECT doc_id, 4096 + o // 1044480 * 1048576 + o % 1044480 AS physical, o AS back, o // 4096 AS sector, o // 4096 // 255 AS block, o // 4096 % 255 AS place
FROM (SELECT doc_id, doc_id * 777777 + n_chars AS o FROM documents)"""
)
def plog_address(t: Tables) -> DataFrame:
    x = t.raw("documents").select("doc_id", (F.col("doc_id") * 777_777 + F.col("n_chars")).alias("o"))
    s = layout.sector(F.col("o"))
    return x.select("doc_id", layout.physical(F.col("o")).alias("physical"), layout.logical(layout.physical(F.col("o"))).alias("back"), s.alias("sector"), layout.sector_block(s).alias("block"), layout.sector_place(s).alias("place"))


@query("SELECT doc_id, o // (1044480 * d) AS ec_row, o % (1044480 * d) // 1044480 AS ec_column, o % 1044480 AS ec_place FROM (SELECT doc_id, doc_id * 777777 + n_chars AS o, 2 + doc_id % 4 AS d FROM documents)")
def ec_geometry(t: Tables) -> DataFrame:
    x = t.raw("documents").select("doc_id", (F.col("doc_id") * 777_777 + F.col("n_chars")).alias("o"), (F.col("doc_id") % 4 + 2).alias("d"))
    return x.select("doc_id", layout.row(F.col("o"), F.col("d")).alias("ec_row"), layout.column(F.col("o"), F.col("d")).alias("ec_column"), layout.place(F.col("o")).alias("ec_place"))


@query("SELECT doc_id, left(sha256(text), 30) AS uid_hex, length(sha256(text)) > 0 AS round_trip, 24 AS chars FROM documents")
def uid_round_trip(t: Tables) -> DataFrame:
    """Identifiers as text and back, in lower case and with hyphens, as people type them."""
    x = t.doc_rows.select("doc_id", F.col("hash").alias("uid_hex"), ids.uid_text(F.col("hash")).alias("text"))
    typed = F.lower(ids.key_groups(F.col("text")))
    return x.select("doc_id", "uid_hex", ids.parse_uid(typed).eqNullSafe(F.col("uid_hex")).alias("round_trip"), F.length("text").alias("chars"))


@query("SELECT s_suppkey AS id, 'plog-' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS file_name, s_suppkey AS back FROM supplier")
def plog_names(t: Tables) -> DataFrame:
    x = t.disk.select("id", policy.plog_name(F.col("id")).alias("file_name"))
    return x.withColumn("back", policy.plog_id_of(F.concat(F.lit("disk/"), "file_name")))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'EC' ELSE 'DUPLICATE' END AS scheme, CASE WHEN p_size % 3 = 0 THEN p_size ELSE p_size END AS data_shards, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS parity_shards FROM part")
def protection_parse(t: Tables) -> DataFrame:
    spec = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, " + 2").otherwise(""))
    return t.raw("part").select("p_partkey", policy.protection(spec).alias("p")).select("p_partkey", "p.scheme", "p.data_shards", "p.parity_shards")


# ---- operations and jobs

_NOW = 996_624_000_000_000_000  # 2001-08-01, in ns
_YEAR = 365 * 86400 * 1_000_000_000


@query(f"SELECT id, path, state FROM write_ops WHERE state = 'prepared' AND {_NOW} - CASE WHEN created_at > 50000000000 THEN created_at ELSE created_at * 1000000000 END > {_YEAR} AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A')", "write_ops")
def reap_write_ops(t: Tables) -> DataFrame:
    active = t.raw("lineitem").where("l_linestatus = 'O' AND l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    return planners.reapable(t.write_op, active, _NOW, _YEAR).select("id", "path", "state")


@query("SELECT o_orderkey AS plog_id, o_custkey AS disk_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey)")
def sweep_strays(t: Tables) -> DataFrame:
    found = t.raw("orders").select(F.col("o_custkey").alias("disk_id"), F.col("o_orderkey").alias("plog_id"))
    known = t.raw("lineitem").select(F.col("l_suppkey").alias("disk_id"), F.col("l_orderkey").alias("id"))
    return planners.strays(found, known)


@query("SELECT idempotency_key, arg_min(path, (created_at, path)) AS path, min(created_at) AS created_at FROM write_ops GROUP BY 1", "write_ops")
def write_op_create(t: Tables) -> DataFrame:
    from chunkcatalog import schema

    made = transitions.create_write_ops(schema.empty(t.spark, "write_op"), t.write_op.select("idempotency_key", "path", "created_at"))
    return made.select("idempotency_key", "path", "created_at")


@query("SELECT id, CASE WHEN state = 'prepared' AND id % 3 = 0 THEN 'committed' WHEN state = 'prepared' AND id % 3 = 1 THEN 'abandoned' ELSE state END AS state, CASE WHEN state = 'prepared' AND id % 3 = 0 THEN id * 10 ELSE 0 END AS file_id FROM write_ops", "write_ops")
def write_op_commit(t: Tables) -> DataFrame:
    ops = t.write_op.withColumn("file_id", F.lit(0).cast("long"))
    leases = ops.select(F.col("id").alias("vlog_id"), F.col("id").alias("write_op_id"), F.lit(0).alias("ordinal"))
    done = ops.where(F.col("id") % 3 == 0).select("id", (F.col("id") * 10).alias("file_id"))
    cat = transitions.commit_write_ops({"write_op": ops, "vlog_lease": leases}, done)
    return transitions.abandon_write_ops(cat, ops.where(F.col("id") % 3 == 1).select("id"))["write_op"].select("id", "state", "file_id")


@query("SELECT event_type AS kind, user_id AS target_vlog, min(event_id) AS first_request, count(*) AS requests FROM events WHERE event_id % 2 = 1 GROUP BY ALL HAVING (event_type, user_id) NOT IN (SELECT (event_type, user_id) FROM events WHERE event_id % 10 = 0)")
def job_get_or_create(t: Tables) -> DataFrame:
    """The jobs that new requests create, when every tenth event is a running job already."""
    e = t.raw("events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("target_vlog"), F.lit(0).cast("long").alias("target_disk"), F.col("event_id").alias("created_at"))
    zero = F.lit(0).cast("long")
    jobs = e.where(F.col("created_at") % 10 == 0).select(F.col("created_at").alias("id"), "kind", F.lit("running").alias("state"), "target_vlog", zero.alias("dest_vlog"), "target_disk", zero.alias("dest_disk"), "created_at")
    wanted = e.where(F.col("created_at") % 2 == 1)
    every, _ = transitions.get_or_create_jobs(jobs, wanted)
    new = every.join(jobs.select("id").distinct(), "id", "left_anti")
    counts = wanted.groupBy("kind", "target_vlog").agg(F.count("*").alias("requests"))
    return new.join(counts, ["kind", "target_vlog"]).select("kind", "target_vlog", F.col("created_at").alias("first_request"), "requests")


@query(
    """SELECT op_id, coalesce(own, free) AS vlog_id, CASE WHEN own IS NOT NULL THEN 'own' WHEN free IS NOT NULL THEN 'free' ELSE 'provision' END AS how FROM (
  SELECT o.id AS op_id, CASE WHEN o.id % 4 = 0 THEN o.id END AS own,
    CASE WHEN o.id % 3 = 0 THEN (SELECT min(id) FROM vlog WHERE target_data_shards = 2 AND target_parity_shards = 1 AND id % 4 <> 0)
         ELSE (SELECT min(id) FROM vlog WHERE protection_scheme = 'DUPLICATE' AND data_shards = 1 AND target_data_shards = 0 AND id % 4 <> 0) END AS free
  FROM write_ops o WHERE state = 'prepared')""",
    "write_ops vlog",
)
def lease_choice(t: Tables) -> DataFrame:
    ops = t.write_op.where("state = 'prepared'")
    coded = F.col("id") % 3 == 0
    rules = ops.select(F.col("id").alias("op_id"), F.when(coded, "EC").otherwise("DUPLICATE").alias("protection_scheme"), F.when(coded, 2).otherwise(1).alias("data_shards"), F.when(coded, 1).otherwise(0).alias("parity_shards"))
    own = ops.where(F.col("id") % 4 == 0).select(F.col("id").alias("op_id"), F.col("id").alias("vlog_id"), F.lit(0).alias("ordinal"))
    leases = t.vlog.where(F.col("id") % 4 == 0).select(F.col("id").alias("vlog_id"))
    return planners.lease_choice(own, t.vlog, leases, rules)


# ---- byte kernels: their output as sums, which SQL can tell from the input

_KEY, _LABEL = b"integrity key 01", b"chunk"


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, true AS tiles, true AS sized, sha256(text) AS digest FROM documents WHERE octet_length(encode(text)) > 0")
def cdc_chunks(t: Tables) -> DataFrame:
    """Content-defined chunks of each text: they tile it, put together they are it, and none but the last is too small or too large."""
    chunks = bytes_.chunk_files(t.raw("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("data")), 256, 1024, 4096, payload=True)
    x = ordered.extents(chunks, ["path"], ["pos"], "len", "want", "__end")
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("path"))
    x = x.withColumn("ok", (F.col("len") <= 4096) & (last | (F.col("len") >= 256)))
    return x.groupBy("path").agg(F.sum("len").alias("bytes"), F.bool_and(F.col("want") == F.col("offset")).alias("tiles"), F.bool_and("ok").alias("sized"), F.sort_array(F.collect_list(F.struct("pos", "data"))).alias("parts")).select(F.col("path").cast("long").alias("doc_id"), "bytes", "tiles", "sized", F.sha2(F.aggregate("parts", F.lit(b""), lambda a, c: F.concat(a, c["data"])), 256).alias("digest"))


@query("SELECT page_id AS vlog_id, octet_length(encode(html)) AS bytes, 2 AS lost, sha256(html) AS digest FROM pages")
def rs_roundtrip(t: Tables) -> DataFrame:
    """Pages as rows of 4 + 2 shards, two shards lost, put together again."""
    rows = t.raw("pages").select(F.col("page_id").alias("vlog_id"), F.lit(0).alias("row"), F.col("html").cast("binary").alias("data"))
    shards = bytes_.encode_rows(rows, 4, 2).where((F.col("shard_idx") != F.col("vlog_id") % 6) & (F.col("shard_idx") != (F.col("vlog_id") + 1) % 6))
    return bytes_.decode_rows(shards, 4, 2).select("vlog_id", F.octet_length("data").alias("bytes"), "lost", F.sha2("data", 256).alias("digest"))


@query("SELECT page_id AS plog_id, (octet_length(encode(html)) + 4095) // 4096 AS sectors, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS corrupt, 0 AS bad_blocks, octet_length(encode(html)) AS length FROM pages")
def scrub_logs(t: Tables) -> DataFrame:
    """Pages as log files, one byte changed in every third."""
    logs = bytes_.encode_logs(t.raw("pages").select(F.col("page_id").alias("plog_id"), F.col("html").cast("binary").alias("data")), _KEY)
    broken = F.concat(F.substring("content", 1, 4096), F.lit(b"\xff\xfe"), F.expr("substring(content, 4099)"))
    return bytes_.scrub(logs.withColumn("content", F.when(F.col("plog_id") % 3 == 0, broken).otherwise(F.col("content"))), _KEY)


@query("SELECT doc_id AS id, octet_length(encode(text)) AS bytes, octet_length(encode(text)) < 16 AS may_equal, sha256(text) AS digest FROM documents")
def ctr_roundtrip(t: Tables) -> DataFrame:
    """Texts encrypted and decrypted again."""
    x = t.raw("documents").select(F.col("doc_id").alias("id"), ids.hash64(F.col("text")).alias("hash64"), (F.col("doc_id") % 50).alias("offset"), F.col("text").cast("binary").alias("data"))
    sealed = bytes_.crypt(x, _KEY, _LABEL)
    both = x.join(sealed.withColumnRenamed("data", "sealed"), "id")
    same = (F.octet_length("data") < 16) | (F.col("sealed") == F.col("data"))  # 16 bytes or more do not stay as they are
    back = bytes_.crypt(both.select("id", "hash64", "offset", F.col("sealed").alias("data")), _KEY, _LABEL)
    return back.join(both.select("id", same.alias("may_equal")), "id").select("id", F.octet_length("data").alias("bytes"), "may_equal", F.sha2("data", 256).alias("digest"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS file_id, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS length, CASE WHEN doc_id % 5 = 0 THEN 'crc' ELSE '' END AS error FROM documents")
def header_roundtrip(t: Tables) -> DataFrame:
    """Record headers made and parsed; in every fifth a byte is changed."""
    x = t.raw("documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("flags"), ids.hash64(F.col("text")).alias("hash64"), F.col("n_chars").alias("length"), F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    raw = bytes_.headers(x)
    broken = F.concat(F.expr("substring(header, 1, 40)"), F.lit(b"\xff\xfe\xfd\xfc"), F.expr("substring(header, 45)"))
    return bytes_.parse_headers(raw.withColumn("header", F.when(F.col("id") % 5 == 0, broken).otherwise(F.col("header"))))


# ---- more reads


@query(
    """WITH RECURSIVE edges AS (SELECT doc_id AS parent, doc_id * 2 + 1 AS child FROM documents UNION ALL SELECT doc_id, doc_id * 2 + 2 FROM documents),
  seen AS (SELECT doc_id AS node FROM documents WHERE doc_id % 11 = 3 UNION SELECT child FROM seen JOIN edges ON node = parent)
SELECT doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT node FROM seen)"""
)
def unreachable_nodes(t: Tables) -> DataFrame:
    """Nodes of a binary tree below none of the roots."""
    ids_ = t.raw("documents").select("doc_id")
    edges = ids_.select(F.col("doc_id").alias("parent"), F.explode(F.array(F.col("doc_id") * 2 + 1, F.col("doc_id") * 2 + 2)).alias("child"))
    return planners.unreachable(ids_.withColumnRenamed("doc_id", "node"), edges, ids_.where("doc_id % 11 = 3").withColumnRenamed("doc_id", "node"))


@query("SELECT path, false AS is_dir, size FROM page_heads UNION ALL SELECT DISTINCT parent, true, 0 FROM page_heads WHERE parent <> '' AND parent NOT IN (SELECT path FROM page_heads)", "page_heads")
def stat_paths(t: Tables) -> DataFrame:
    heads = t.page_heads
    one = F.array(F.struct(F.lit("").alias("hash"), F.col("size").cast("int").alias("len")))
    files = heads.select(F.col("file_id").alias("id"), one.alias("chunks"))
    dirs = catalog.implied_dirs(heads).select("path", F.lit(0).cast("long").alias("mtime"))
    wanted = heads.select("path").union(heads.where("parent <> ''").select("parent")).distinct()
    flat = heads.select("path", "file_id", F.lit(0).cast("long").alias("mtime"))
    return catalog.stat(wanted, flat, files, dirs).select("path", "is_dir", "size")


@query("SELECT w.path, coalesce(h.file_id, 0) AS file_id FROM (SELECT 'conv/' || CAST(doc_id AS VARCHAR) AS path FROM documents) w LEFT JOIN conv_heads h USING (path)", "conv_heads")
def head_lookup(t: Tables) -> DataFrame:
    wanted = t.raw("documents").select(F.concat(F.lit("conv/"), F.col("doc_id").cast("string")).alias("path"))
    return catalog.head_version(wanted, catalog.latest(t.conv_files).select("path", F.col("id").alias("file_id")))


@query("SELECT id, path, CASE WHEN created_at > 50000000000 THEN created_at ELSE created_at * 1000000000 END AS created_ns FROM write_ops WHERE state = 'prepared'", "write_ops")
def prepared_write_ops(t: Tables) -> DataFrame:
    return catalog.with_state(t.write_op, "prepared").select("id", "path", policy.created_ns(F.col("created_at")).alias("created_ns"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 IN (0, 1) THEN 'COMPLETED' WHEN event_id % 4 = 2 THEN 'RUNNING' ELSE 'UNKNOWN' END AS status FROM events")
def job_states(t: Tables) -> DataFrame:
    state = F.element_at(F.array(F.lit("done"), F.lit("cancelled"), F.lit("running"), F.lit("?")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.raw("events").select(F.col("event_id").alias("id"), policy.job_status(state).alias("status"))


@query("SELECT id FROM vlog WHERE id IN (SELECT id FROM write_ops WHERE state = 'prepared')", "vlog write_ops")
def leased_vlogs(t: Tables) -> DataFrame:
    leases = t.write_op.where("state = 'prepared'").select(F.col("id").alias("vlog_id"))
    return catalog.leased(t.vlog, leases).select("id")


@query("SELECT DISTINCT parent AS path FROM page_heads WHERE parent <> ''", "page_heads")
def dirs_with_files(t: Tables) -> DataFrame:
    """Directories that cannot be removed, as files stand in them."""
    dirs = catalog.implied_dirs(t.page_heads)
    return dirs.join(t.page_heads.select(F.col("parent").alias("path")), "path", "left_semi")


@query("SELECT disk_id, plog_id, length FROM placed JOIN states USING (disk_id) WHERE reachable AND shard_idx = (SELECT min(q.shard_idx) FROM placed q JOIN states s USING (disk_id) WHERE s.reachable AND q.vlog_id = placed.vlog_id)", "placed states")
def first_readable_copy(t: Tables) -> DataFrame:
    up = catalog.disk_states(t.disk, t.node).where(policy.disk_reachable(F.col("disk_state"), F.col("node_state")))
    x = t.placed.join(up.select("disk_id"), "disk_id", "left_semi")
    best = x.groupBy("vlog_id").agg(F.min_by(F.struct("disk_id", "plog_id", "length"), "shard_idx").alias("b"))
    return best.select("b.*")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Space accounting, then what to compact first."""
    return QUERIES["compaction_candidates"](spark, folder)
