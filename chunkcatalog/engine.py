"""The engine's Python surface: a namespace with snapshots, and maintenance, over one catalog of DataFrames."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkcatalog import schema
from chunkcatalog.functions import kernels, layout, paths, policy
from chunkcatalog.operators import bytes as byte_ops
from chunkcatalog.operators import catalog as reads
from chunkcatalog.operators import invariants, ordered, planners, shards, transitions
from chunkcatalog.plans import store


class Engine:
    """Holds the current version of the catalog; each change makes the next one.

    ``shards`` holds the logs' bytes (``operators.shards``); those on disks that cannot be reached, or damaged, are not read. A log takes ``max_log`` bytes,
    then the next one is made. Coded logs have rows of ``column`` bytes for each data shard and are only filled by promotion and compaction. Times are nanoseconds and always given by the caller.
    """

    def __init__(self, spark: SparkSession, chunk_sizes: tuple[int, int, int] = (kernels.MIN_CHUNK, kernels.NORMAL_CHUNK, kernels.MAX_CHUNK), max_log: int = schema.MAX_LOG_BYTES, column: int = layout.DATA):
        self.spark, self.sizes, self.max_log, self.column = spark, chunk_sizes, max_log, column
        self.cat = schema.empty_catalog(spark)
        self.shards = spark.createDataFrame([], shards.EMPTY)

    def _become(self, cat: dict[str, DataFrame], *changed: str) -> None:
        self.cat = store.settle_all(cat, *changed) if changed else store.settle_all(cat)

    # ---- storage

    def add_node(self, node_id: int, mac: str, hostname: str) -> None:
        row = self.spark.createDataFrame([(node_id, mac, hostname, "working")], schema.TABLES["node"])
        self._become({**self.cat, "node": transitions.insert_if_absent(self.cat["node"], row, "mac")}, "node")

    def add_disk(self, disk_id: int, uid: str, node_id: int, total_bytes: int) -> None:
        row = self.spark.createDataFrame([(disk_id, uid, node_id, total_bytes, 0, "active")], schema.TABLES["disk"])
        self._become({**self.cat, "disk": transitions.insert_if_absent(self.cat["disk"], row, "id")}, "disk")

    def set_disk_state(self, disk_id: int, state: str) -> None:
        if state not in schema.DISK_STATES:
            raise ValueError(state)
        change = self.spark.createDataFrame([(disk_id, state)], "id bigint, state string")
        self._become({**self.cat, "disk": transitions.update(self.cat["disk"], change, "id", "state", strict=True)}, "disk")

    def set_node_state(self, node_id: int, state: str) -> None:
        if state not in schema.NODE_STATES:
            raise ValueError(state)
        if state == "working":
            self._become(transitions.node_returned(self.cat, node_id), "node", "disk", "job")
            return
        change = self.spark.createDataFrame([(node_id, state)], "id bigint, state string")
        self._become({**self.cat, "node": transitions.update(self.cat["node"], change, "id", "state", strict=True)}, "node")

    def set_policy(self, bucket: str, scheme: str, data: int, parity: int) -> None:
        row = self.spark.createDataFrame([(bucket, scheme, data, parity)], schema.TABLES["bucket"])
        self._become({**self.cat, "bucket": transitions.upsert(self.cat["bucket"], row, "name")}, "bucket")

    def make_vlog(self, scheme: str = "DUPLICATE", data: int = 1, parity: int = 0, staging: bool = False) -> int:
        """A new log on the first live disk of each node; staging logs hold copies until their rows are coded."""
        wanted = planners.shards_wanted(scheme, data, parity, staging)
        targets = planners.first_per_node(self.cat["disk"], self.cat["node"], wanted)
        if wanted and targets.count() < wanted:
            raise OSError(f"{wanted} nodes with a live disk are needed")
        spec = ("DUPLICATE", 1, 0) if staging else (scheme, data, parity)
        self._become(transitions.provision(self.cat, spec, targets, (data, parity) if staging else (0, 0)), "vlog", "vlog_plog", "plog")
        return self.cat["vlog"].agg(F.max("id")).first()[0]

    # ---- bytes

    def _specs(self, logs: DataFrame) -> list[tuple[int, int]]:
        """The codes among ``logs(vlog_id)``: pairs of data and parity shards, one for each policy."""
        v = self.cat["vlog"].where("protection_scheme = 'EC'").join(logs.select(F.col("vlog_id").alias("id")), "id", "left_semi")
        return [(r.data_shards, r.parity_shards) for r in v.select("data_shards", "parity_shards").distinct().collect()]

    def _of(self, rows: DataFrame, spec: tuple[int, int] | None) -> DataFrame:
        """Of ``rows(vlog_id, ...)`` those in logs of a code, or of copies (None)."""
        coded = F.col("protection_scheme") == "EC"
        v = self.cat["vlog"].where(~coded if spec is None else coded & (F.col("data_shards") == spec[0]) & (F.col("parity_shards") == spec[1]))
        return rows.join(v.select(F.col("id").alias("vlog_id")), "vlog_id", "left_semi")

    def _store(self, records: DataFrame) -> None:
        """Adds the shards of ``records(vlog_id, vaddr_offset, data)``."""
        records = store.settle(records)
        x = self.shards.unionByName(shards.mirrored(self._of(records, None), self.placements()))
        for d, p in self._specs(records):
            x = x.unionByName(shards.coded(self._of(records, (d, p)), self.placements(), d, p, self.column * d))
        self.shards = store.settle(x)

    def _good(self) -> DataFrame:
        """Shards that are undamaged and on disks that can be reached."""
        up = reads.disk_states(self.cat["disk"], self.cat["node"]).where(policy.disk_reachable(F.col("disk_state"), F.col("node_state")))
        plogs = self.cat["plog"].join(up.select("disk_id"), "disk_id", "left_semi").select(F.col("id").alias("plog_id"))
        return shards.healthy(self.shards.join(plogs, "plog_id", "left_semi"))

    def _data(self, wanted: DataFrame) -> DataFrame:
        """``wanted(hash, vlog_id, vaddr_offset, len)`` with ``data``, null where it cannot be read."""
        wanted, good = store.settle(wanted), self._good()
        x = shards.read_mirrored(self._of(wanted, None), good).select(*wanted.columns, "data")
        for d, p in self._specs(wanted):
            x = x.unionByName(shards.read_coded(self._of(wanted, (d, p)), self._of(good, (d, p)), d, p, self.column * d).select(*wanted.columns, "data"))
        return x

    def _rebuild(self, lost: DataFrame) -> None:
        """Makes shards ``lost(plog_id, vlog_id, shard_idx)`` again from the others; a shard without enough of them keeps what it has."""
        lost = store.settle(lost)
        good = self._good().join(lost.select("plog_id"), "plog_id", "left_anti")
        x = store.settle(shards.copied(self._of(lost, None), self._of(good, None)))
        for d, p in self._specs(lost):
            x = x.unionByName(store.settle(shards.rebuilt(self._of(lost, (d, p)), self._of(good, (d, p)), d, p)))
        self.shards = store.settle(self.shards.join(x.select("plog_id", "row"), ["plog_id", "row"], "left_anti").select(*shards.COLUMNS).unionByName(x))

    def _drop_shards(self) -> int:
        """Forgets shards of logs that are no more; how many rows went."""
        kept = store.settle(self.shards.join(self.cat["plog"].select(F.col("id").alias("plog_id")), "plog_id", "left_semi").select(*shards.COLUMNS))
        gone = self.shards.count() - kept.count()
        self.shards = kept
        return gone

    def append_log(self, vlog_id: int, data: bytes) -> int:
        """Appends one raw record to a log of copies; gives its offset. No file refers to it."""
        log = self.cat["vlog"].where((F.col("id") == vlog_id) & (F.col("protection_scheme") != "EC")).first()
        if log is None or log.length + schema.HEADER_BYTES + len(data) > self.max_log:
            raise OSError(f"log {vlog_id} takes no record of {len(data)} bytes")
        self._store(self.spark.createDataFrame([(vlog_id, log.length, data)], "vlog_id bigint, vaddr_offset bigint, data binary"))
        end = self.spark.createDataFrame([(vlog_id, log.length + schema.HEADER_BYTES + len(data))], "id bigint, length bigint")
        self._become({**self.cat, "vlog": transitions.update(self.cat["vlog"], end, "id", "length", strict=True)}, "vlog")
        return log.length

    def read_log(self, vlog_id: int, offset: int, size: int) -> bytes:
        """The payload of ``size`` bytes of the record at an offset of any log, from what shards are left."""
        found = self._data(self.spark.createDataFrame([("", vlog_id, offset, size)], "hash string, vlog_id bigint, vaddr_offset bigint, len bigint")).first()
        if found is None or found.data is None:
            raise OSError(f"log {vlog_id} cannot be read at {offset}")
        return bytes(found.data)

    # ---- files

    def write(self, files: dict[str, bytes] | DataFrame, mtime: int, vlog_id: int | None = None) -> None:
        """Publishes whole files ``(path, data)``: cuts them into chunks, keeps new chunks once, and makes them the heads.

        New chunks go to the given log, or the lowest one that is not coded, and on to new logs like it where it is full.
        """
        plain = self.cat["vlog"].where("protection_scheme <> 'EC'")
        vlog_id = vlog_id if vlog_id is not None else plain.agg(F.min("id")).first()[0]
        log = None if vlog_id is None else plain.where(F.col("id") == vlog_id).first()
        if log is None:
            raise OSError("there is no log to write to")
        f = files if isinstance(files, DataFrame) else self.spark.createDataFrame(list(files.items()), "path string, data binary")
        f = f.select(paths.clean(F.col("path")).alias("path"), F.col("data").cast("binary").alias("data"))
        chunks = store.settle(byte_ops.chunk_files(f, *self.sizes, payload=True))
        fresh = chunks.groupBy("hash").agg(F.min(F.struct("path", "pos")).alias("first"), F.max("len").alias("len"))
        fresh = fresh.join(self.cat["chunk"].select("hash"), "hash", "left_anti").withColumn("bytes", (F.col("len") + schema.HEADER_BYTES).cast("long"))
        placed = store.settle(ordered.append_offsets(fresh.withColumn("all", F.lit(0)), ["all"], ["first", "hash"], "bytes", F.lit(log.length), self.max_log, spread=True))
        last = placed.agg(F.max("log_no")).first()[0] or 0
        logs = [vlog_id, *(self.make_vlog(log.protection_scheme, log.target_data_shards or log.data_shards, log.target_parity_shards, log.target_data_shards > 0) for _ in range(last))]
        at_log = F.element_at(F.array(*(F.lit(v).cast("long") for v in logs)), (F.col("log_no") + 1).cast("int"))
        placed = store.settle(placed.select("hash", at_log.alias("vlog_id"), F.col("offset").cast("long").alias("vaddr_offset"), "bytes"))
        rows = chunks.join(placed, "hash", "left").select(F.struct("path", "pos").alias("pos"), "hash", F.coalesce("vlog_id", F.lit(0)).alias("vlog_id"), F.coalesce("vaddr_offset", F.lit(0)).alias("vaddr_offset"), F.col("len").cast("long").alias("logical_len"), F.col("len").cast("long").alias("compressed_len"))
        lists = chunks.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash", "len"))), lambda c: F.struct(c["hash"].alias("hash"), c["len"].alias("len"))).alias("chunks"))
        batch = f.select("path").join(lists, "path", "left").select("path", F.lit(mtime).cast("long").alias("mtime"), F.coalesce("chunks", F.array().cast("array<struct<hash:string,len:int>>")).alias("chunks"))
        # Bytes come first: a version is published only when all it refers to can be read.
        new = chunks.groupBy("hash").agg(F.first("data").alias("data"))
        self._store(placed.join(new, "hash").select("vlog_id", "vaddr_offset", "data"))
        cat = transitions.publish_files(self.cat, batch, rows)
        ends = placed.groupBy(F.col("vlog_id").alias("id")).agg(F.max(F.col("vaddr_offset") + F.col("bytes")).alias("length"))
        cat = {**cat, "vlog": transitions.update(cat["vlog"], ends, "id", "length")}
        self._become(cat, "file", "file_head", "chunk", "dir", "vlog")

    def read(self, path: str, offset: int = 0, size: int | None = None, snapshot_id: int | None = None) -> bytes:
        """A file's bytes, or a part; short at its end. Each chunk is checked against its hash."""
        heads = self.cat["file_head"] if snapshot_id is None else self.cat["snapshot_file"].where(F.col("snapshot_id") == snapshot_id)
        head = heads.where(F.col("path") == path).select(F.col("file_id").alias("id")).first()
        if head is None:
            raise FileNotFoundError(path)
        rows = reads.chunk_list(self.cat["file"].where(F.col("id") == head.id))
        rows = ordered.extents(rows, ["file_id"], ["pos"], "len")
        hi = offset + size if size is not None else 1 << 62
        rows = store.settle(rows.where((F.col("end") > offset) & (F.col("start") < hi)))
        places = self.cat["chunk"].join(rows.select("hash").distinct(), "hash", "left_semi").select("hash", "vlog_id", "vaddr_offset", F.col("compressed_len").alias("len"))
        rows = rows.join(self._data(places).select("hash", "data"), "hash", "left").orderBy("pos")
        out, first = [], None
        for r in rows.select("start", "hash", "data").toLocalIterator():
            if r.data is None or hashlib.sha256(r.data).hexdigest()[:30] != r.hash:
                raise OSError(f"chunk {r.hash} of {path} is missing or corrupt")
            first = r.start if first is None else first
            out.append(bytes(r.data))
        return b"".join(out)[offset - (first or 0) :][: size if size is not None else None]

    def write_at(self, path: str, edits: list[tuple[int, bytes]], mtime: int, size: int | None = None, vlog_id: int | None = None) -> None:
        """Applies edits ``(offset, bytes)`` in their order to a file (or a new one), cuts or extends it to ``size``, and publishes the result once."""
        old = b"" if self.cat["file_head"].where(F.col("path") == path).isEmpty() else self.read(path)
        data = bytearray(old)
        for offset, part in edits:
            data.extend(bytes(max(0, offset + len(part) - len(data))))
            data[offset : offset + len(part)] = part
        if size is not None:
            data = data[:size] + bytes(max(0, size - len(data)))
        self.write({path: bytes(data)}, mtime, vlog_id)

    def truncate(self, path: str, size: int, mtime: int) -> None:
        self.write_at(path, [], mtime, size)

    def open_write(self, path: str, key: str, at: int) -> int:
        """An operation by its idempotency key: a new one, or the one that has the key; a key of another path is an error."""
        batch = self.spark.createDataFrame([(key, path, at)], "idempotency_key string, path string, created_at bigint")
        self._become({**self.cat, "write_op": transitions.create_write_ops(self.cat["write_op"], batch)}, "write_op")
        return transitions.bind(self.cat["write_op"], batch.select("idempotency_key", "path")).first().op_id

    def close_write(self, key: str, data: bytes, mtime: int) -> str:
        """Publishes the bytes of an operation and commits it; one that has ended stays as it is. Gives its state."""
        op = self.cat["write_op"].where(F.col("idempotency_key") == key).first()
        if op is None:
            raise KeyError(key)
        if op.state == "prepared":
            self.write({op.path: data}, mtime)
            head = self.cat["file_head"].where(F.col("path") == paths.clean(F.lit(op.path))).first()
            done = self.spark.createDataFrame([(op.id, head.file_id)], "id bigint, file_id bigint")
            self._become(transitions.commit_write_ops(self.cat, done), "write_op", "vlog_lease")
            return "committed"
        return op.state

    def list_dir(self, path: str = "") -> DataFrame:
        return reads.list_dir(path, self.cat["file_head"], self.cat["file"], self.cat["dir"])

    def stat(self, path: str) -> DataFrame:
        return reads.stat(self.spark.createDataFrame([(path,)], "path string"), self.cat["file_head"], self.cat["file"], self.cat["dir"])

    def unlink(self, *gone: str) -> None:
        self._become(transitions.unlink(self.cat, self.spark.createDataFrame([(p,) for p in gone], "path string")), "file_head", "chunk")

    def remove_tree(self, path: str) -> None:
        self._become(transitions.remove_tree(self.cat, path), "file_head", "chunk", "dir")

    def rename(self, old: str, new: str) -> None:
        self._become(transitions.rename(self.cat, old, new), "file_head", "chunk", "dir")

    def mkdir(self, path: str, mtime: int = 0) -> None:
        self._become(transitions.mkdir(self.cat, path, mtime), "dir")

    def rmdir(self, path: str) -> None:
        self._become(transitions.rmdir(self.cat, path), "dir")

    def set_mtime(self, path: str, mtime: int) -> bool:
        cat, found = transitions.set_mtime(self.cat, path, mtime)
        self._become(cat, "file_head", "dir")
        return found

    # ---- snapshots

    def create_snapshot(self, name: str, at: int) -> int:
        self._become(transitions.create_snapshot(self.cat, name, at), "snapshot", "snapshot_file", "chunk")
        return self.cat["snapshot"].where(F.col("name") == name).first().id

    def delete_snapshot(self, snapshot_id: int) -> None:
        gone = self.spark.createDataFrame([(snapshot_id,)], "id bigint")
        self._become(transitions.delete_snapshots(self.cat, gone), "snapshot", "snapshot_file", "chunk")

    # ---- maintenance

    def pins(self) -> DataFrame:
        """Hashes that must stay although nothing refers to them: here none; callers add those of writes in flight."""
        return self.spark.createDataFrame([], "hash string")

    def collect_garbage(self, pins: DataFrame | None = None) -> int:
        cat, gone = transitions.collect_garbage(self.cat, pins if pins is not None else self.pins())
        gone = store.settle(gone.select("hash"))
        self._become(cat, "chunk")
        return gone.count()  # their bytes go with their log, when it is compacted

    def compact(self, rule: planners.CompactionPolicy = planners.CompactionPolicy()) -> list[int]:
        """Moves the live chunks of wasteful logs to new ones and retires the old."""
        usage = reads.vlog_usage(self.cat["vlog"], self.cat["chunk"])
        todo = [r.vlog_id for r in planners.compaction_candidates(usage, rule, self.cat["vlog_lease"]).collect()]  # max_jobs rows
        for vlog_id in todo:
            v = self.cat["vlog"].where(F.col("id") == vlog_id).first()
            staging = v.target_data_shards > 0
            dest = self.make_vlog(v.protection_scheme, v.target_data_shards or v.data_shards, v.target_parity_shards or v.parity_shards, staging)
            live = self.cat["chunk"].where((F.col("vlog_id") == vlog_id) & policy.live(F.col("refcount")))
            self._move_chunks(vlog_id, dest, live)
            self._retire(vlog_id)
        return todo

    def _move_chunks(self, source: int, dest: int, chosen: DataFrame) -> None:
        """Writes the chosen live chunks of a log into a new one, in order, then points the catalog there. A coded log is filled up to whole rows."""
        chosen = store.settle(chosen)
        sources = self.spark.createDataFrame([(source, dest)], "vlog_id bigint, dest_vlog bigint")
        moves = store.settle(planners.repack(chosen, sources))
        data = self._data(chosen.select("hash", "vlog_id", "vaddr_offset", F.col("compressed_len").alias("len"))).select("hash", "data")
        lost = data.where("data IS NULL").first()
        if lost is not None:
            raise OSError(f"chunk {lost.hash} cannot be read")
        self._store(moves.join(data, "hash").select("vlog_id", "vaddr_offset", "data"))
        v = self.cat["vlog"].where(F.col("id") == dest).first()
        payload = chosen.agg(F.coalesce(F.sum(F.col("compressed_len") + schema.HEADER_BYTES), F.lit(0)).alias("n"))
        length = F.col("n") if v.protection_scheme != "EC" else layout.padded(F.col("n"), self.column * v.data_shards)
        change = payload.select(F.lit(dest).cast("long").alias("id"), length.alias("length"))
        self._become({**self.cat, "chunk": transitions.relocate(self.cat["chunk"], moves), "vlog": transitions.update(self.cat["vlog"], change, "id", "length")}, "chunk", "vlog")

    def _retire(self, vlog_id: int) -> None:
        gone = self.spark.createDataFrame([(vlog_id,)], "vlog_id bigint")
        self._become(transitions.retire_vlogs(self.cat, gone), "chunk", "vlog", "vlog_plog", "plog")
        self._drop_shards()

    def promote(self, pins: DataFrame | None = None, max_logs: int = 4) -> dict[int, int]:
        """Codes the chunks of staging logs in whole rows, the prefix with the least padding; gives the new log of each. A log that this drains is retired unless a pinned hash lives there."""
        done: dict[int, int] = {}
        staged = self.cat["vlog"].where(policy.staging(F.col("target_data_shards"), F.col("target_parity_shards")))
        for d, p in [tuple(r) for r in staged.select("target_data_shards", "target_parity_shards").distinct().collect()]:
            mine = staged.where((F.col("target_data_shards") == d) & (F.col("target_parity_shards") == p))
            plan = planners.promotions(mine, self.cat["chunk"], self.column * d)
            leased = plan.join(self.cat["vlog_lease"].select("vlog_id"), "vlog_id", "left_anti")
            for r in leased.orderBy("vlog_id").limit(max_logs).collect():
                live = self.cat["chunk"].where((F.col("vlog_id") == r.vlog_id) & policy.live(F.col("refcount")))
                chosen = live.orderBy("vaddr_offset", "hash").limit(r["count"])
                dest = self.make_vlog("EC", d, p)
                self._move_chunks(r.vlog_id, dest, chosen)
                done[r.vlog_id] = dest
                one = self.spark.createDataFrame([(r.vlog_id,)], "vlog_id bigint")
                if r.drains and planners.unfinished(one, self.cat["chunk"], pins if pins is not None else self.pins()).isEmpty():
                    self._retire(r.vlog_id)
        return done

    def scrub(self) -> DataFrame:
        """``(vlog_id, rows, corrupt, unhealthy)`` of each log, from the bytes of all its shards."""
        found = self.placements().join(shards.scrub(self.shards), "plog_id", "left").select("vlog_id", "shard_idx", F.coalesce("rows", F.lit(0)).alias("sectors"), F.coalesce("corrupt", F.lit(0)).alias("corrupt"), F.lit(0).alias("bad_blocks"))
        return reads.scrub_rollup(found).withColumnRenamed("sectors", "rows")

    def repair(self) -> dict[str, int]:
        """Makes damaged shards, and shards on disks that are lost, again where enough others can be read; on another disk if there is one. Counts logs by what was done."""
        corrupt = store.settle(shards.scrub(self.shards).where("corrupt > 0").select("plog_id"))
        placed = store.settle(self.placements())
        actions = store.settle(planners.repair(self.cat["vlog"], placed, self.cat["disk"], self.cat["node"], corrupt))
        up = reads.disk_states(self.cat["disk"], self.cat["node"]).where(policy.disk_reachable(F.col("disk_state"), F.col("node_state")))
        bad = placed.join(up.select("disk_id"), "disk_id", "left_anti").select("plog_id").union(corrupt).distinct()
        broken = placed.join(bad, "plog_id", "left_semi").join(actions.where("action = 'repair'"), "vlog_id", "left_semi").select("vlog_id", "shard_idx", "plog_id")
        plan = store.settle(planners.repair_destinations(broken, placed, self.cat["disk"], self.cat["node"]).where("dest_disk IS NOT NULL"))
        self._rebuild(plan.select("plog_id", "vlog_id", "shard_idx"))
        self.move_shards(plan)
        return {r.action: r["count"] for r in actions.groupBy("action").count().collect()}

    def sweep(self) -> int:
        """Forgets shards that the catalog does not know; nothing is swept while a disk has failed, since what it holds is not known."""
        if not self.cat["disk"].where("state = 'failed'").isEmpty():
            return 0
        return self._drop_shards()

    def move_shards(self, plan: DataFrame) -> int:
        """Applies moves ``(plog_id, dest_disk)``; those without a destination are left."""
        plan = store.settle(plan.where("dest_disk IS NOT NULL").select(F.col("plog_id").alias("id"), F.col("dest_disk").alias("disk_id")))
        self._become({**self.cat, "plog": transitions.update(self.cat["plog"], plan, "id", "disk_id")}, "plog")
        return plan.count()

    def placements(self) -> DataFrame:
        return reads.placements(self.cat["vlog_plog"], self.cat["plog"])

    def _move_all(self, disk_id: int, plan: DataFrame) -> int:
        """Moves what has a place; an error if shards stay behind, else the disk is detached."""
        moved = self.move_shards(plan)
        left = self.cat["plog"].where(F.col("disk_id") == disk_id).count()
        if left:
            raise OSError(f"no place for {left} shards of disk {disk_id}")
        self.set_disk_state(disk_id, "detached")
        return moved

    def drain(self, disk_id: int) -> int:
        self.set_disk_state(disk_id, "draining")
        return self._move_all(disk_id, store.settle(planners.drain(disk_id, self.placements(), self.cat["disk"], self.cat["node"])))

    def replace(self, disk_id: int, dest_disk: int) -> int:
        """Moves all shards of a disk to a given one, where no other shard of their log is on its node."""
        plan = store.settle(planners.replace(disk_id, dest_disk, self.placements(), self.cat["disk"], self.cat["node"]).where("allowed"))
        failed = not self.cat["disk"].where((F.col("id") == disk_id) & (F.col("state") == "failed")).isEmpty()
        if failed:
            self._rebuild(plan.select("plog_id", "vlog_id", "shard_idx"))
        return self._move_all(disk_id, plan)

    def reprotect(self) -> int:
        """New places for the shards of failed and draining disks; what was on failed ones is made again from the other shards."""
        plan = store.settle(planners.reprotect(self.placements(), self.cat["disk"], self.cat["node"]).where("dest_disk IS NOT NULL"))
        failed = self.cat["disk"].where("state = 'failed'").select(F.col("id").alias("disk_id"))
        lost = self.placements().join(failed, "disk_id", "left_semi").join(plan.select("plog_id"), "plog_id", "left_semi")
        self._rebuild(lost.select("plog_id", "vlog_id", "shard_idx"))
        return self.move_shards(plan)

    def rebalance(self, rule: planners.RebalancePolicy = planners.RebalancePolicy(), last_moved: int | None = None, now: int = 0) -> int:
        plan = planners.rebalance(self.placements(), self.cat["disk"], self.cat["node"], rule, last_moved, now)
        return self.move_shards(plan.groupBy("plog_id").agg(F.max_by("to_disk", "move").alias("dest_disk")))

    def reap(self, now: int, expiry_ns: int = 3600 * 1_000_000_000, active: DataFrame | None = None) -> int:
        active = active if active is not None else self.spark.createDataFrame([], "id bigint")
        gone = store.settle(planners.reapable(self.cat["write_op"], active, now, expiry_ns).select("id"))
        self._become(transitions.abandon_write_ops(self.cat, gone), "write_op", "vlog_lease")
        return gone.count()

    def request(self, kind: str, at: int, disk_id: int = 0, vlog_id: int = 0, dest_disk: int = 0) -> int:
        """A job by kind and target; one that runs already is given again, with its destination."""
        wanted = self.spark.createDataFrame([(kind, vlog_id, disk_id, at)], "kind string, target_vlog bigint, target_disk bigint, created_at bigint")
        jobs, given = transitions.get_or_create_jobs(self.cat["job"], wanted)
        job = given.first().id
        known = not self.cat["job"].where(F.col("id") == job).isEmpty()
        if dest_disk and not known:
            jobs = transitions.update(jobs, self.spark.createDataFrame([(job, dest_disk)], "id bigint, dest_disk bigint"), "id", "dest_disk")
        self._become({**self.cat, "job": jobs}, "job")
        return job

    def remove_disk(self, disk_id: int, at: int) -> int:
        return self.request("drain", at, disk_id=disk_id)

    def replace_disk(self, disk_id: int, dest_disk: int, at: int) -> int:
        return self.request("replace", at, disk_id=disk_id, dest_disk=dest_disk)

    def migrate(self, plog_id: int, dest_disk: int) -> None:
        """Moves one shard to a live disk whose node holds no other shard of its log."""
        mine = self.placements().where(F.col("plog_id") == plog_id).first()
        if mine is None:
            raise KeyError(plog_id)
        plan = store.settle(planners.replace(mine.disk_id, dest_disk, self.placements(), self.cat["disk"], self.cat["node"]).where((F.col("plog_id") == plog_id) & F.col("allowed")))
        if not self.move_shards(plan):
            raise OSError(f"disk {dest_disk} cannot take shard {plog_id}")

    def run_jobs(self) -> dict[int, str]:
        """Runs (or, after a restart, resumes) all running jobs by kind, oldest first; unknown kinds are cancelled."""
        kinds = {"drain": lambda j: self.drain(j.target_disk), "reprotect": lambda j: self.reprotect(), "rebalance": lambda j: self.rebalance(), "compact": lambda j: self.compact(), "replace": lambda j: self.replace(j.target_disk, j.dest_disk), "promote": lambda j: self.promote(), "repair": lambda j: self.repair()}
        ended = {}
        for job in reads.with_state(self.cat["job"], "running").collect():  # the jobs of one maintenance pass
            ended[job.id] = "done" if job.kind in kinds else "cancelled"
            if job.kind in kinds:
                kinds[job.kind](job)
            one = self.spark.createDataFrame([(job.id,)], "id bigint")
            self._become({**self.cat, "job": transitions.end_jobs(self.cat["job"], one, ended[job.id])}, "job")
        return ended

    def maintain(self, now: int) -> dict[str, object]:
        """One pass, in order: reprotect, repair, rebalance, reap, collect, compact, promote, sweep. A step that fails is reported and does not stop the others."""
        steps = {
            "reprotect": self.reprotect, "repair": self.repair, "rebalance": self.rebalance, "reap": lambda: self.reap(now), "collect": self.collect_garbage,
            "compact": self.compact, "promote": self.promote, "sweep": self.sweep,
        }
        report: dict[str, object] = {}
        for name, step in steps.items():
            try:
                report[name] = step()
            except Exception as error:  # noqa: BLE001  the pass goes on; the report tells
                report[name] = error
        return report

    def readiness(self) -> DataFrame:
        return reads.readiness(self.cat["vlog"], self.placements(), self.cat["disk"], self.cat["node"])

    def broken(self) -> dict[str, int]:
        return invariants.broken(self.cat)

    def publish(self, folder: str, at: int) -> int:
        return store.publish(self.cat, folder, at)
