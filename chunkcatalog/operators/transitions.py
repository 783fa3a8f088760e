"""Changes of the catalog as pure functions: tables and a batch in, new tables out.

A catalog is a dict of DataFrames (``chunkcatalog.schema.TABLES``). Nothing is changed in place; ``publish`` of ``plans`` writes a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.functions import paths, policy
from chunkcatalog.operators import catalog as reads
from chunkcatalog.operators.planners import collectable
from chunkcatalog.plans.store import settle

Catalog = dict[str, DataFrame]


def _with(cat: Catalog, **tables: DataFrame) -> Catalog:
    return {**cat, **tables}


def _next_id(table: DataFrame) -> Column:
    """An id above all others, as a scalar of the table."""
    return F.coalesce(F.max("id"), F.lit(0))


def numbered(rows: DataFrame, table: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ids that continue those of ``table``, in order.

    Rows are sorted by ranges in parallel and settled; each range's first number follows from the counts of those before.
    """
    local = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = local.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row for each range
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    start = table.agg(_next_id(table).alias("__start"))
    x = local.withColumn("__part", part).withColumn("__place", place).join(before, "__part").join(start, F.lit(True))
    return x.withColumn("id", (F.col("__start") + F.col("__before") + F.col("__place") + 1).cast("long")).drop("__m", "__part", "__place", "__before", "__start")


# ---- references


def _add(chunks: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds ``deltas(hash, d)`` to refcounts; unknown hashes are ignored."""
    d = deltas.groupBy("hash").agg(F.sum("d").alias("d"))
    x = chunks.join(d, "hash", "left").withColumn("refcount", F.col("refcount") + F.coalesce("d", F.lit(0)))
    return x.select(*chunks.columns)


def occurrences(files: DataFrame, sign: int) -> DataFrame:
    return reads.chunk_list(files).groupBy("hash").agg((F.count("*") * sign).alias("d"))


def upsert_chunks(chunks: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds a reference for each row of ``batch(pos, hash, vlog_id, vaddr_offset, logical_len, compressed_len)``.

    A new hash is placed as its first row says; a known one keeps its place, even if it was dead.
    """
    place = F.struct("vlog_id", "vaddr_offset", "logical_len", "compressed_len")
    b = batch.groupBy("hash").agg(F.count("*").alias("n"), F.min_by(place, "pos").alias("p"))
    x = chunks.join(b, "hash", "full_outer")
    fields = [F.coalesce(F.col(c), F.col(f"p.{c}")).alias(c) for c in ("vlog_id", "vaddr_offset", "logical_len", "compressed_len")]
    return x.select("hash", (F.coalesce("refcount", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("refcount"), *fields)


# ---- files


def _with_dirs(cat: Catalog, file_paths: DataFrame, mtime: Column) -> DataFrame:
    new = file_paths.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().join(cat["dir"], "path", "left_anti")
    return cat["dir"].unionByName(new.select("path", paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"), mtime.cast("long").alias("mtime")))


def publish_files(cat: Catalog, batch: DataFrame, placements: DataFrame) -> Catalog:
    """Publishes ``batch(path, mtime, chunks)``, one row for each path, as new versions and heads.

    The references of replaced heads go, those of the new lists come; new chunks are placed as ``placements(pos, hash, ...)`` says (one row for each occurrence).
    """
    b = batch.withColumn("path", paths.clean(F.col("path")))
    files = numbered(b, cat["file"], "path").select("id", "path", "mtime", "chunks")
    old = cat["file_head"].join(files.select("path"), "path", "left_semi")
    replaced = cat["file"].join(old.select(F.col("file_id").alias("id")), "id", "left_semi")
    chunks = upsert_chunks(_add(cat["chunk"], occurrences(replaced, -1)), placements)
    heads = cat["file_head"].join(files.select("path"), "path", "left_anti").unionByName(files.select("path", F.col("id").alias("file_id"), paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"), "mtime"))
    return _with(cat, file=cat["file"].unionByName(files), file_head=heads, chunk=chunks, dir=_with_dirs(cat, files, F.lit(0)))


def unlink(cat: Catalog, gone: DataFrame) -> Catalog:
    """Removes the heads of ``gone(path)``; unknown paths are ignored."""
    old = cat["file_head"].join(gone, "path", "left_semi")
    files = cat["file"].join(old.select(F.col("file_id").alias("id")), "id", "left_semi")
    return _with(cat, file_head=cat["file_head"].join(gone, "path", "left_anti"), chunk=_add(cat["chunk"], occurrences(files, -1)))


def rename(cat: Catalog, old: str, new: str) -> Catalog:
    """Renames a file, or a directory with all below it. What stood at a target path loses its references; times are kept."""
    moving = cat["file_head"].where(paths.inside(F.col("path"), old))
    moved = moving.withColumn("path", paths.moved(F.col("path"), old, new))
    hit = cat["file_head"].join(moved.select("path"), "path", "left_semi").where(~paths.inside(F.col("path"), old))
    lost = cat["file"].join(hit.select(F.col("file_id").alias("id")), "id", "left_semi")
    stay = cat["file_head"].where(~paths.inside(F.col("path"), old)).join(moved.select("path"), "path", "left_anti")
    heads = stay.unionByName(moved.withColumn("parent", paths.parent(F.col("path"))).withColumn("name", paths.name(F.col("path"))))
    d = cat["dir"].where(paths.inside(F.col("path"), old)).withColumn("path", paths.moved(F.col("path"), old, new))
    d = d.withColumn("parent", paths.parent(F.col("path"))).withColumn("name", paths.name(F.col("path")))
    dirs = cat["dir"].where(~paths.inside(F.col("path"), old)).join(d.select("path"), "path", "left_anti").unionByName(d)
    out = _with(cat, file_head=heads, chunk=_add(cat["chunk"], occurrences(lost, -1)), dir=dirs)
    return _with(out, dir=_with_dirs(out, moved.select("path").unionByName(d.select("path")), F.lit(0)))


def mkdir(cat: Catalog, path: str, mtime: int = 0) -> Catalog:
    """Makes a directory and those above it; fails if a file stands there, does nothing if the directory exists."""
    if not cat["file_head"].where(F.col("path") == path).isEmpty():
        raise FileExistsError(path)
    one = cat["dir"].sparkSession.createDataFrame([(f"{path}/",)], "path string")
    return _with(cat, dir=_with_dirs(cat, one.select(F.concat("path", F.lit("x")).alias("path")), F.lit(mtime)))


def rmdir(cat: Catalog, path: str) -> Catalog:
    """Removes an empty directory; the root and directories with children are refused."""
    if not path:
        raise ValueError("the root stays")
    children = cat["file_head"].where(F.col("parent") == path).select("path").unionAll(cat["dir"].where(F.col("parent") == path).select("path"))
    if not children.isEmpty():
        raise OSError(f"{path} is not empty")
    return _with(cat, dir=cat["dir"].where(F.col("path") != path))


def remove_tree(cat: Catalog, path: str) -> Catalog:
    """Removes a file, or a directory with all below it, in one pass."""
    gone = cat["file_head"].where(paths.inside(F.col("path"), path)).select("path")
    return _with(unlink(cat, gone), dir=cat["dir"].where(~paths.inside(F.col("path"), path)))


def set_mtime(cat: Catalog, path: str, mtime: int) -> tuple[Catalog, bool]:
    """Sets a file's time, or else a directory's; tells whether there was one."""
    at = F.when(F.col("path") == path, F.lit(mtime)).otherwise(F.col("mtime")).cast("long")
    for table in ("file_head", "dir"):
        if not cat[table].where(F.col("path") == path).isEmpty():
            return _with(cat, **{table: cat[table].withColumn("mtime", at)}), True
    return cat, False


def backfill_namespace(cat: Catalog) -> Catalog:
    """Fills parent, name and directories from paths alone."""
    heads = cat["file_head"].withColumn("parent", paths.parent(F.col("path"))).withColumn("name", paths.name(F.col("path")))
    return _with(cat, file_head=heads, dir=_with_dirs(cat, heads, F.lit(0)))


# ---- snapshots


def create_snapshot(cat: Catalog, name: str, created_at: int) -> Catalog:
    """Freezes all heads; each chunk gains a reference for each occurrence. Names are unique."""
    if not cat["snapshot"].where(F.col("name") == name).isEmpty():
        raise ValueError(f"snapshot {name} exists")
    one = cat["snapshot"].sparkSession.createDataFrame([(name, created_at)], "name string, created_at bigint")
    new = numbered(one, cat["snapshot"], "name").select("id", "name", "created_at")
    members = cat["file_head"].join(new.select(F.col("id").alias("snapshot_id")), F.lit(True)).select("snapshot_id", "path", "file_id")
    held = cat["file"].join(cat["file_head"].select(F.col("file_id").alias("id")), "id", "left_semi")
    return _with(cat, snapshot=cat["snapshot"].unionByName(new), snapshot_file=cat["snapshot_file"].unionByName(members), chunk=_add(cat["chunk"], occurrences(held, 1)))


def delete_snapshots(cat: Catalog, gone: DataFrame) -> Catalog:
    """Drops snapshots ``gone(id)`` with their members and references; unknown ids are ignored, so twice is once."""
    ids = gone.select(F.col("id").alias("snapshot_id")).distinct()
    held = cat["snapshot_file"].join(ids, "snapshot_id", "left_semi").groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("times"))
    lists = reads.chunk_list(cat["file"].join(held, "id", "left_semi")).groupBy("file_id", "hash").agg(F.count("*").alias("n"))  # few versions are unpacked
    deltas = lists.join(held, lists.file_id == held.id).groupBy("hash").agg(F.sum(-F.col("n") * F.col("times")).alias("d"))
    return _with(cat, snapshot=cat["snapshot"].join(gone.select("id"), "id", "left_anti"), snapshot_file=cat["snapshot_file"].join(ids, "snapshot_id", "left_anti"), chunk=_add(cat["chunk"], deltas))


def snapshot_diff(cat: Catalog, old: int, new: int) -> DataFrame:
    """``(path, change)`` from one snapshot to another: added, removed or changed."""
    a = cat["snapshot_file"].where(F.col("snapshot_id") == old).select("path", F.col("file_id").alias("a"))
    b = cat["snapshot_file"].where(F.col("snapshot_id") == new).select("path", F.col("file_id").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def collect_garbage(cat: Catalog, pins: DataFrame) -> tuple[Catalog, DataFrame]:
    """Removes dead chunks that nothing pins; gives them too."""
    gone = collectable(cat["chunk"], pins)
    return _with(cat, chunk=cat["chunk"].join(gone.select("hash"), "hash", "left_anti")), gone


# ---- write operations and leases


def create_write_ops(ops: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds ``batch(idempotency_key, path, created_at)``; a key that exists, or comes again, keeps its first operation."""
    w = W.partitionBy("idempotency_key").orderBy("created_at", "path")
    new = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").join(ops, "idempotency_key", "left_anti")
    new = numbered(new, ops, "created_at", "idempotency_key")
    row = new.select("id", "idempotency_key", "path", F.lit("prepared").alias("state"), F.col("created_at").cast("long").alias("created_at"), F.lit(0).cast("long").alias("file_id"), F.lit(0).cast("long").alias("acknowledged_offset"), F.lit(b"").alias("tail"))
    return ops.unionByName(row)


def bind(ops: DataFrame, opens: DataFrame) -> DataFrame:
    """``opens(idempotency_key, path)`` with ``op_id``; a key that belongs to another path is an error."""
    x = opens.join(ops.select("idempotency_key", F.col("path").alias("__path"), F.col("id").alias("op_id")), "idempotency_key", "left")
    other = F.col("__path").isNotNull() & (F.col("__path") != F.col("path"))
    return x.withColumn("op_id", F.when(other, F.raise_error(F.concat(F.lit("key in use for another path: "), F.col("idempotency_key")))).otherwise(F.col("op_id"))).drop("__path")


def _end(cat: Catalog, ids: DataFrame, state: str, file_ids: bool) -> Catalog:
    hit = ids.select("id", (F.col("file_id") if file_ids else F.lit(None).cast("long")).alias("__file")).withColumn("__hit", F.lit(True))
    x = cat["write_op"].join(hit, "id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)) & (F.col("state") == "prepared"))
    x = x.withColumn("file_id", F.when(F.col("__hit"), F.coalesce("__file", "file_id")).otherwise(F.col("file_id"))).withColumn("state", F.when(F.col("__hit"), F.lit(state)).otherwise(F.col("state")))
    ended = x.where("__hit").select(F.col("id").alias("write_op_id"))
    return _with(cat, write_op=x.select(*cat["write_op"].columns), vlog_lease=cat["vlog_lease"].join(ended, "write_op_id", "left_anti").select(*cat["vlog_lease"].columns))


def commit_write_ops(cat: Catalog, done: DataFrame) -> Catalog:
    """``done(id, file_id)``: prepared operations become committed and give up their leases; ended ones stay as they are."""
    return _end(cat, done, "committed", True)


def abandon_write_ops(cat: Catalog, gone: DataFrame) -> Catalog:
    """``gone(id)``: prepared operations become abandoned and give up their leases."""
    return _end(cat, gone, "abandoned", False)


def set_tail(ops: DataFrame, tails: DataFrame) -> DataFrame:
    """``tails(id, tail)`` for operations that are still prepared."""
    x = ops.join(tails.withColumnRenamed("tail", "__tail"), "id", "left")
    return x.withColumn("tail", F.when((F.col("state") == "prepared") & F.col("__tail").isNotNull(), F.col("__tail")).otherwise(F.col("tail"))).select(*ops.columns)


def claim(cat: Catalog, wanted: DataFrame) -> tuple[Catalog, DataFrame]:
    """Leases ``wanted(write_op_id, vlog_id)`` of prepared operations on free logs; gives the refused ones too. The lowest operation wins a log."""
    open_ops = cat["write_op"].where("state = 'prepared'").select(F.col("id").alias("write_op_id"))
    w = W.partitionBy("vlog_id").orderBy("write_op_id")
    ok = wanted.join(open_ops, "write_op_id", "left_semi").join(cat["vlog_lease"], "vlog_id", "left_anti").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    last = cat["vlog_lease"].groupBy("write_op_id").agg(F.max("ordinal").alias("last"))
    new = ok.join(last, "write_op_id", "left").withColumn("ordinal", (F.coalesce("last", F.lit(-1)) + F.row_number().over(W.partitionBy("write_op_id").orderBy("vlog_id"))).cast("int"))
    refused = wanted.join(ok, ["write_op_id", "vlog_id"], "left_anti")
    return _with(cat, vlog_lease=cat["vlog_lease"].unionByName(new.select("vlog_id", "write_op_id", "ordinal"))), refused


def release(leases: DataFrame, ops: DataFrame) -> DataFrame:
    return leases.join(ops.select(F.col("id").alias("write_op_id")), "write_op_id", "left_anti").select(*leases.columns)


# ---- logs, disks, nodes


def insert_if_absent(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Adds rows whose key is new; of several the first in column order."""
    w = W.partitionBy(*key).orderBy(*[c for c in table.columns if c not in key] or key)
    new = rows.select(*table.columns).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(table, list(key), "left_anti")
    return table.unionByName(new.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Adds or replaces rows by key."""
    return table.join(rows.select(*key), list(key), "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def update(table: DataFrame, changes: DataFrame, key: str, *columns: str, strict: bool = False) -> DataFrame:
    """Sets ``columns`` from ``changes(key, columns)``; with ``strict`` an unknown key is an error."""
    if strict:
        lost = changes.select(key).join(table, key, "left_anti").first()
        if lost is not None:
            raise KeyError(lost[0])
    renamed = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    x = table.join(renamed, key, "left")
    for c in columns:
        x = x.withColumn(c, F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).cast(table.schema[c].dataType))
    return x.select(*table.columns)


def relocate(chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves(hash, vlog_id, vaddr_offset)``."""
    return update(chunks, moves, "hash", "vlog_id", "vaddr_offset")


def provision(cat: Catalog, spec: tuple[str, int, int], targets: DataFrame, target: tuple[int, int] = (0, 0)) -> Catalog:
    """A new log with a shard on each row of ``targets(shard_idx, disk_id)``."""
    spark = cat["vlog"].sparkSession
    one = numbered(spark.createDataFrame([("",)], "uid string"), cat["vlog"], "uid")
    v = one.select("id", "uid", F.lit(0).cast("long").alias("length"), F.lit(spec[0]).alias("protection_scheme"), F.lit(spec[1]).alias("data_shards"), F.lit(spec[2]).alias("parity_shards"), F.lit(target[0]).alias("target_data_shards"), F.lit(target[1]).alias("target_parity_shards"))
    p = numbered(targets.select("shard_idx", "disk_id"), cat["plog"], "shard_idx")
    bridge = p.join(v.select(F.col("id").alias("vlog_id")), F.lit(True)).select("vlog_id", F.col("shard_idx").cast("int").alias("shard_idx"), F.col("id").alias("plog_id"))
    plogs = p.select("id", F.lit("").alias("uid"), F.col("disk_id").cast("long").alias("disk_id"), F.lit(0).cast("long").alias("length"))
    return _with(cat, vlog=cat["vlog"].unionByName(v), vlog_plog=cat["vlog_plog"].unionByName(bridge), plog=cat["plog"].unionByName(plogs))


def replace_shard(cat: Catalog, vlog_id: int, shard_idx: int, old_plog: int, new_plog: int) -> Catalog:
    """Swaps a shard's log if it still is ``old_plog``, and drops that; an error otherwise."""
    at = (F.col("vlog_id") == vlog_id) & (F.col("shard_idx") == shard_idx) & (F.col("plog_id") == old_plog)
    if cat["vlog_plog"].where(at).isEmpty():
        raise KeyError((vlog_id, shard_idx, old_plog))
    bridge = cat["vlog_plog"].withColumn("plog_id", F.when(at, F.lit(new_plog).cast("long")).otherwise(F.col("plog_id")))
    return _with(cat, vlog_plog=bridge, plog=cat["plog"].where(F.col("id") != old_plog))


def retire_vlogs(cat: Catalog, gone: DataFrame) -> Catalog:
    """Drops logs ``gone(vlog_id)`` with their shards; an error if live chunks remain in one."""
    live = cat["chunk"].where(policy.live(F.col("refcount"))).join(gone, "vlog_id", "left_semi").select("vlog_id").first()
    if live is not None:
        raise ValueError(f"vlog {live[0]} has live chunks")
    shards = cat["vlog_plog"].join(gone, "vlog_id", "left_semi").select(F.col("plog_id").alias("id"))
    return _with(
        cat,
        chunk=cat["chunk"].join(gone, "vlog_id", "left_anti").select(*cat["chunk"].columns),
        vlog=cat["vlog"].join(gone.select(F.col("vlog_id").alias("id")), "id", "left_anti"),
        vlog_plog=cat["vlog_plog"].join(gone, "vlog_id", "left_anti").select(*cat["vlog_plog"].columns),
        plog=cat["plog"].join(shards, "id", "left_anti"),
    )


def reconciled_lengths(vlogs: DataFrame, placed: DataFrame) -> DataFrame:
    """``(plog_id, length)`` cut back to what the log has committed; a coded shard holds its share."""
    v = vlogs.select(F.col("id").alias("vlog_id"), F.when(F.col("protection_scheme") == "EC", F.call_function("div", F.col("length"), F.col("data_shards"))).otherwise(F.col("length")).alias("committed"))
    return placed.join(v, "vlog_id").select("plog_id", F.least("length", "committed").alias("length"))


# ---- jobs


def get_or_create_jobs(jobs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``wanted(kind, target_vlog, target_disk, created_at)``: running jobs of the same kind and target are reused. Gives all jobs, and the id for each request."""
    key = ["kind", "target_vlog", "target_disk"]
    running = jobs.where("state = 'running'").groupBy(*key).agg(F.min("id").alias("id"))
    fresh = wanted.groupBy(*key).agg(F.min("created_at").alias("created_at")).join(running, key, "left_anti")
    new = numbered(fresh, jobs, "created_at", *key)
    row = new.select("id", "kind", F.lit("running").alias("state"), "target_vlog", F.lit(0).cast("long").alias("dest_vlog"), "target_disk", F.lit(0).cast("long").alias("dest_disk"), "created_at")
    every = jobs.unionByName(row)
    given = wanted.select(*key).distinct().join(running.unionByName(new.select(*key, "id")), key)
    return every, given


def end_jobs(jobs: DataFrame, which: DataFrame, state: str = "done") -> DataFrame:
    """Running jobs of ``which(id)`` end as done or cancelled."""
    hit = which.select("id").distinct().withColumn("__hit", F.lit(True))
    x = jobs.join(hit, "id", "left")
    return x.withColumn("state", F.when(F.col("__hit") & (F.col("state") == "running"), F.lit(state)).otherwise(F.col("state"))).select(*jobs.columns)


def node_returned(cat: Catalog, node_id: int) -> Catalog:
    """A node works again: its failed disks whose reprotection still runs become active, and those jobs are cancelled."""
    on = cat["disk"].where(F.col("node_id") == node_id).select(F.col("id").alias("target_disk"))
    jobs = cat["job"].where("kind = 'reprotect' AND state = 'running'").join(on, "target_disk", "left_semi")
    back = jobs.select(F.col("target_disk").alias("id")).distinct().withColumn("state", F.lit("active"))
    failed = cat["disk"].where("state = 'failed'").join(back, "id", "left_semi").select("id").withColumn("state", F.lit("active"))
    nodes = cat["node"].withColumn("state", F.when(F.col("id") == node_id, F.lit("working")).otherwise(F.col("state")))
    return _with(cat, node=nodes, disk=update(cat["disk"], failed, "id", "state"), job=end_jobs(cat["job"], jobs, "cancelled"))
