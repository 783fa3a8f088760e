"""Maintenance planners: DataFrames of what to do. Nothing here moves data; ``transitions`` applies plans to the catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.functions import layout, policy
from chunkcatalog.operators import catalog, ordered
from chunkcatalog.plans.store import settle
from chunkcatalog.schema import HEADER_BYTES

BROADCAST_ROWS = 400_000


@dataclass(frozen=True)
class CompactionPolicy:
    """Waste ratio as a fraction ``num/den``, so that it is compared in integers."""

    num: int = 1
    den: int = 4
    least_dead: int = 4 << 20
    max_jobs: int = 4


@dataclass(frozen=True)
class RebalancePolicy:
    band: int = 10 << 30
    max_moves: int = 8
    cooldown_ns: int = 300 * 1_000_000_000


# ---- compaction and promotion


def compaction_candidates(usage: DataFrame, rule: CompactionPolicy = CompactionPolicy(), leases: DataFrame | None = None) -> DataFrame:
    """Logs worth compacting, most dead bytes first, ties by id; ``max_jobs`` 0 means all. Leased logs are left out."""
    x = usage.where((F.col("total_bytes") > 0) & (F.col("dead_bytes") >= rule.least_dead) & (F.col("dead_bytes") * rule.den >= F.col("total_bytes") * rule.num))
    if leases is not None:
        x = x.join(leases.select("vlog_id"), "vlog_id", "left_anti")
    x = x.orderBy(F.desc("dead_bytes"), "vlog_id")
    return x.limit(rule.max_jobs) if rule.max_jobs else x


def repack(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """New places of the live chunks of ``sources(vlog_id, dest_vlog)``: behind each other, in old order, each with its header."""
    live = chunks.where(policy.live(F.col("refcount"))).join(sources, "vlog_id")
    x = live.withColumn("__len", F.col("compressed_len") + HEADER_BYTES)
    x = ordered.extents(x, ["vlog_id"], ["vaddr_offset", "hash"], "__len", "new_offset", "__end")
    return x.select("hash", F.col("dest_vlog").alias("vlog_id"), F.col("new_offset").alias("vaddr_offset"))


def repacked_length(chunks: DataFrame, sources: DataFrame, width: int) -> DataFrame:
    """``(vlog_id, payload, padded)`` of the live chunks of each source, in whole rows of ``width``."""
    live = chunks.where(policy.live(F.col("refcount"))).join(sources.select("vlog_id"), "vlog_id", "left_semi")
    x = live.groupBy("vlog_id").agg(F.sum(F.col("compressed_len") + HEADER_BYTES).alias("payload"))
    return x.withColumn("padded", layout.padded(F.col("payload"), width))


def unfinished(candidates: DataFrame, chunks: DataFrame, pins: DataFrame) -> DataFrame:
    """Of compacted logs, those that must stay since a pinned hash still lives there."""
    return candidates.join(catalog.holds_any(chunks, pins), "vlog_id", "left_semi")


def promotions(vlogs: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """For each staging log: how many chunks to promote, and whether that drains it."""
    staging = vlogs.where(policy.staging(F.col("target_data_shards"), F.col("target_parity_shards"))).select(F.col("id").alias("vlog_id"))
    live = chunks.where(policy.live(F.col("refcount"))).join(staging, "vlog_id", "left_semi")
    best = ordered.promotable_prefix(live, ["vlog_id"], ["vaddr_offset", "hash"], "compressed_len", width)
    n = live.groupBy("vlog_id").agg(F.count("*").alias("chunks"))
    return best.join(n, "vlog_id").withColumn("drains", F.col("count") == F.col("chunks"))


# ---- destinations


def _shard_nodes(placed: DataFrame, states: DataFrame) -> DataFrame:
    return placed.join(states.select("disk_id", "node_id"), "disk_id")


def destinations(moving: DataFrame, placed: DataFrame, disks: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each shard of ``moving(vlog_id, shard_idx, plog_id)``: the lowest live disk on a node that holds no other shard of its log.

    ``dest_disk`` is null where there is none. For every log only the first live disk of each node is a candidate, and of
    those only as many as the log has nodes, plus one, can matter: the lowest one beyond the taken nodes is always among them. So
    candidates are a small ranked list that is joined by rank, not a product of shards and disks.
    """
    states = catalog.disk_states(disks, nodes)
    live = states.where(policy.disk_live(F.col("disk_state"), F.col("node_state")))
    first = live.groupBy("node_id").agg(F.min("disk_id").alias("dest_disk"))
    ranked = first.withColumn("rank", F.row_number().over(W.orderBy("dest_disk")))  # one row for each node
    others = moving.alias("m").join(_shard_nodes(placed, states).alias("p"), F.col("m.vlog_id") == F.col("p.vlog_id")).where(F.col("m.plog_id") != F.col("p.plog_id"))
    taken = others.groupBy(F.col("m.plog_id").alias("plog_id")).agg(F.collect_set("p.node_id").alias("taken"))
    x = moving.join(taken, "plog_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))
    x = x.withColumn("rank", F.explode(F.sequence(F.lit(1), F.size("taken") + 1)))
    x = x.join(ranked, "rank", "left").where(F.col("node_id").isNull() | ~F.array_contains("taken", F.col("node_id")))
    return x.groupBy("vlog_id", "shard_idx", "plog_id").agg(F.min("dest_disk").alias("dest_disk"))


def drain(disk_id: int, placed: DataFrame, disks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Moves that empty a disk: every shard on it with its destination."""
    return destinations(placed.where(F.col("disk_id") == disk_id).select("vlog_id", "shard_idx", "plog_id"), placed, disks, nodes)


def reprotect(placed: DataFrame, disks: DataFrame, nodes: DataFrame) -> DataFrame:
    """New places for all shards on failed or draining disks; ``recoverable`` tells whether enough other shards of the log can be read."""
    states = catalog.disk_states(disks, nodes)
    lost = placed.join(states.where(F.col("disk_state").isin("failed", "draining")), "disk_id", "left_semi").select("vlog_id", "shard_idx", "plog_id")
    readable = placed.join(states.where(policy.disk_reachable(F.col("disk_state"), F.col("node_state"))), "disk_id", "left_semi")
    n = readable.groupBy("vlog_id").agg(F.count("*").alias("sources"))
    return destinations(lost, placed, disks, nodes).join(n, "vlog_id", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))


def replace(disk_id: int, dest_disk: int, placed: DataFrame, disks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Moves from a disk to a given one, with ``allowed``: the destination is live and its node holds no other shard of the log."""
    states = catalog.disk_states(disks, nodes)
    dest = states.where(F.col("disk_id") == dest_disk).select(F.col("node_id").alias("d_node"), policy.disk_live(F.col("disk_state"), F.col("node_state")).alias("d_live"))
    moving = placed.where(F.col("disk_id") == disk_id).select("vlog_id", "shard_idx", "plog_id")
    held = _shard_nodes(placed, states).select(F.col("vlog_id").alias("h_vlog"), F.col("plog_id").alias("h_plog"), F.col("node_id").alias("h_node"))
    x = moving.join(dest, F.lit(True), "left")
    clash = x.join(held, (F.col("vlog_id") == F.col("h_vlog")) & (F.col("h_plog") != F.col("plog_id")) & (F.col("h_node") == F.col("d_node"))).select("plog_id").distinct().withColumn("clash", F.lit(True))
    return x.join(clash, "plog_id", "left").select("vlog_id", "shard_idx", "plog_id", F.lit(dest_disk).alias("dest_disk"), (F.coalesce("d_live", F.lit(False)) & F.col("clash").isNull()).alias("allowed"))


def repair(vlogs: DataFrame, placed: DataFrame, disks: DataFrame, nodes: DataFrame, corrupt: DataFrame) -> DataFrame:
    """What to do about shards that are offline or in ``corrupt(plog_id)``: ``(vlog_id, bad, good, needed, action)``.

    ``action`` is ``healthy``, ``repair`` (as many good live shards as reading needs) or ``unrepairable``.
    """
    states = catalog.disk_states(disks, nodes)
    bad = corrupt.select("plog_id").distinct().withColumn("corrupt", F.lit(True))
    x = placed.join(states, "disk_id", "left").join(bad, "plog_id", "left")
    good = F.coalesce(policy.disk_reachable(F.col("disk_state"), F.col("node_state")), F.lit(False)) & F.col("corrupt").isNull()
    per = x.groupBy("vlog_id").agg(F.count_if(~good).alias("bad"), F.count_if(good).alias("good"))
    v = vlogs.select(F.col("id").alias("vlog_id"), policy.read_threshold(F.col("protection_scheme"), F.col("data_shards")).alias("needed"))
    action = F.when(F.col("bad") == 0, "healthy").when(F.col("good") >= F.col("needed"), "repair").otherwise("unrepairable")
    return per.join(v, "vlog_id").select("vlog_id", "bad", "good", "needed", action.alias("action"))


def repair_destinations(broken: DataFrame, placed: DataFrame, disks: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``destinations``, but a shard without another place may stay on its own disk if that is live."""
    states = catalog.disk_states(disks, nodes)
    own = placed.join(states.where(policy.disk_live(F.col("disk_state"), F.col("node_state"))), "disk_id", "left_semi").select("plog_id", F.col("disk_id").alias("own"))
    away = destinations(broken, placed, disks, nodes).withColumnRenamed("dest_disk", "away").join(placed.select("plog_id", F.col("disk_id").alias("on")), "plog_id")
    x = away.withColumn("away", F.when(F.col("away") != F.col("on"), F.col("away"))).join(own, "plog_id", "left")
    return x.select("vlog_id", "shard_idx", "plog_id", F.coalesce("away", "own").alias("dest_disk"), (F.col("away").isNull() & F.col("own").isNotNull()).alias("is_own"))


def first_per_node(disks: DataFrame, nodes: DataFrame, count: int | None = None) -> DataFrame:
    """The lowest live disk of each node, in id order: where a new log's shards go, as ``(shard_idx, disk_id, node_id)``."""
    live = catalog.disk_states(disks, nodes).where(policy.disk_live(F.col("disk_state"), F.col("node_state")))
    first = live.groupBy("node_id").agg(F.min("disk_id").alias("disk_id")).orderBy("disk_id")
    first = first.limit(count) if count else first
    return first.withColumn("shard_idx", F.row_number().over(W.orderBy("disk_id")) - 1).select("shard_idx", "disk_id", "node_id")


def shards_wanted(scheme: str, data: int, parity: int, staging: bool = False) -> int | None:
    """How many shards a new log has: staging logs hold parity + 1 copies, coded ones data + parity, copies one for each node (None)."""
    if staging:
        return parity + 1
    return {"EC": data + parity, "NONE": 1}.get(scheme)


# ---- rebalance


def rebalance(placed: DataFrame, disks: DataFrame, nodes: DataFrame, rule: RebalancePolicy = RebalancePolicy(), last_moved: int | None = None, now: int = 0, of_logs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Greedy levelling: ``(move, plog_id, from_disk, to_disk, bytes)``, at most ``max_moves``.

    One move a round: from the fullest to the lightest disk, the largest shard that is smaller than their gap and whose log has
    no other shard on the destination's node. The disks' loads are summed once. Of the placements a round only takes the logs with a shard on its
    source, before anything is shuffled; the driver only holds the moves. ``of_logs`` gives the placements of ``logs(vlog_id)`` where they are made by
    a shuffle themselves (a window by log, say), which a join with ``placed`` would repeat over all of them.
    """
    spark = placed.sparkSession
    schema = "move int, plog_id bigint, from_disk bigint, to_disk bigint, bytes bigint"
    if last_moved is not None and now - last_moved < rule.cooldown_ns:
        return spark.createDataFrame([], schema)
    states = catalog.disk_states(disks, nodes)
    live = states.where(policy.disk_live(F.col("disk_state"), F.col("node_state")))
    placed = placed.select("vlog_id", "plog_id", "length", "disk_id")
    loads = settle(live.join(placed.groupBy("disk_id").agg(F.sum("length").alias("b")), "disk_id", "left").select("disk_id", "node_id", F.coalesce("b", F.lit(0).cast("long")).alias("bytes")))
    moves: list[tuple] = []
    arrived: list[tuple] = []  # a log and the disk that a shard of it was moved to, for each move
    while len(moves) < rule.max_moves:
        used = loads
        if moves:
            shifts = spark.createDataFrame([(m[2], -m[4]) for m in moves] + [(m[3], m[4]) for m in moves], "disk_id bigint, shift bigint").groupBy("disk_id").agg(F.sum("shift").alias("shift"))
            used = used.join(shifts, "disk_id", "left").select("disk_id", "node_id", (F.col("bytes") + F.coalesce("shift", F.lit(0).cast("long"))).alias("bytes"))
        top = used.agg(F.max_by("disk_id", F.struct("bytes", (-F.col("disk_id")).alias("i"))), F.max("bytes")).first()
        if top[0] is None:
            break
        source, most = top
        # The lightest disk of each node, in order of load. A shard's best place is the first one outside the nodes of its log's other
        # shards: heavier disks leave a smaller gap, so where that one does not take it, none does.
        far = used.where((F.col("disk_id") != source) & (F.lit(most) - F.col("bytes") > rule.band))
        light = far.groupBy("node_id").agg(F.min(F.struct("bytes", "disk_id")).alias("d")).select("node_id", F.col("d.bytes").alias("to_bytes"), F.col("d.disk_id").alias("to_disk"))
        light = light.withColumn("rank", F.row_number().over(W.orderBy("to_bytes", "to_disk")))  # one row for each node
        logs = placed.where(F.col("disk_id") == source).select("vlog_id")
        if any(disk == source for _, disk in arrived):
            logs = logs.union(spark.createDataFrame([(v,) for v, disk in arrived if disk == source], "vlog_id bigint"))
        logs = settle(logs.distinct())
        logs = F.broadcast(logs) if logs.count() <= BROADCAST_ROWS else logs
        near = of_logs(logs).select(placed.columns) if of_logs else placed.join(logs, "vlog_id", "left_semi")
        if moves:
            done = spark.createDataFrame(list({m[1]: m[3] for m in moves}.items()), "plog_id bigint, moved_to bigint")  # a shard may move again
            near = near.join(done, "plog_id", "left").withColumn("disk_id", F.coalesce("moved_to", "disk_id")).drop("moved_to")
        held = near.join(states.select("disk_id", "node_id"), "disk_id").groupBy("vlog_id").agg(F.collect_list(F.struct("plog_id", "length", "disk_id", "node_id")).alias("held"))  # as long as a log has shards
        mine = held.select("vlog_id", "held", F.explode("held").alias("s")).where((F.col("s.disk_id") == source) & (F.col("s.length") > 0))
        taken = F.array_distinct(F.transform(F.filter("held", lambda h: (h["plog_id"] != F.col("s.plog_id")) & h["node_id"].isNotNull()), lambda h: h["node_id"]))
        x = mine.select("vlog_id", F.col("s.plog_id").alias("plog_id"), F.col("s.length").alias("length"), taken.alias("taken"))
        x = x.withColumn("rank", F.explode(F.sequence(F.lit(1), F.size("taken") + 1))).join(light, "rank").where(~F.array_contains("taken", F.col("node_id")))
        x = x.groupBy("vlog_id", "plog_id", "length").agg(F.min(F.struct("to_bytes", "to_disk")).alias("to")).where(F.col("length") < F.lit(most) - F.col("to.to_bytes"))
        found = x.orderBy("to.to_bytes", "to.to_disk", F.desc("length"), "plog_id").first()
        if found is None:
            break
        moves.append((len(moves) + 1, found.plog_id, source, found.to.to_disk, found.length))
        arrived.append((found.vlog_id, found.to.to_disk))
    return spark.createDataFrame(moves, schema)


# ---- write operations, strays


def reapable(ops: DataFrame, active: DataFrame, now_ns: Column | int, expiry_ns: int, started_ns: int = 0, grace_ns: int = 0) -> DataFrame:
    """Prepared operations without an open handle, older than the expiry; none within the grace after a start."""
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    old = now - policy.created_ns(F.col("created_at")) > expiry_ns
    ready = now - started_ns >= grace_ns
    return ops.where((F.col("state") == "prepared") & old & ready).join(active, "id", "left_anti")


def strays(found: DataFrame, plogs: DataFrame) -> DataFrame:
    """Files ``(disk_id, plog_id)`` on disks that the catalog does not know there."""
    known = plogs.select("disk_id", F.col("id").alias("plog_id"))
    return found.join(known, ["disk_id", "plog_id"], "left_anti")


def collectable(chunks: DataFrame, pins: DataFrame) -> DataFrame:
    """Dead chunks that nothing pins."""
    return chunks.where(~policy.live(F.col("refcount"))).join(pins.select("hash").distinct(), "hash", "left_anti")


def all_pins(*sets: DataFrame) -> DataFrame:
    x = sets[0].select("hash")
    for s in sets[1:]:
        x = x.union(s.select("hash"))
    return x.distinct()


def lease_choice(own: DataFrame, vlogs: DataFrame, leases: DataFrame, policies: DataFrame) -> DataFrame:
    """The log an operation writes to next: ``own(op_id, vlog_id, ordinal)`` newest first, else the lowest free log of its policy, else none (provision).

    ``policies(op_id, protection_scheme, data_shards, parity_shards)``.
    """
    kept = own.groupBy("op_id").agg(F.max_by("vlog_id", "ordinal").alias("own_vlog"))
    free = vlogs.join(leases.select(F.col("vlog_id").alias("id")), "id", "left_anti")
    # A log takes writes of one kind: staging logs of the code they are meant for, others of their own scheme.
    staged = policy.staging(F.col("target_data_shards"), F.col("target_parity_shards"))
    kind = F.when(staged, F.concat_ws("/", F.lit("EC"), "target_data_shards", "target_parity_shards")).when(F.col("protection_scheme") != "EC", F.concat_ws("/", "protection_scheme", "data_shards"))
    asked = F.when(F.col("protection_scheme") == "EC", F.concat_ws("/", F.lit("EC"), "data_shards", "parity_shards")).otherwise(F.concat_ws("/", "protection_scheme", "data_shards"))
    best = free.groupBy(kind.alias("kind")).agg(F.min("id").alias("free_vlog"))
    x = policies.withColumn("kind", asked).join(kept, "op_id", "left").join(best, "kind", "left")
    return x.select("op_id", F.coalesce("own_vlog", "free_vlog").alias("vlog_id"), F.when(F.col("own_vlog").isNotNull(), "own").when(F.col("free_vlog").isNotNull(), "free").otherwise("provision").alias("how"))


def valid_commits(writes: DataFrame) -> DataFrame:
    """Transactions of ``writes(txn, shard, disk_id)`` that may start: no disk and no shard occurs twice."""
    x = writes.groupBy("txn").agg(F.count("*").alias("n"), F.count_distinct("disk_id").alias("disks"), F.count_distinct("shard").alias("shards"))
    return x.select("txn", ((F.col("disks") == F.col("n")) & (F.col("shards") == F.col("n"))).alias("valid"))


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of ``nodes(node)`` that no root reaches over ``edges(parent, child)``, whatever the depth.

    Paths double in length each round (edges are replaced by what two of them reach) while the front moves on by all lengths made so far, so a
    chain of n nodes takes about log n rounds. Only edges whose parent has not been reached are doubled.
    """
    seen = settle(roots.select("node").distinct())
    steps = settle(edges.select("parent", "child").where("parent <> child").distinct())
    while True:
        front = steps.join(seen, steps.parent == seen.node, "left_semi").select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        front = settle(front)
        if front.isEmpty():
            return nodes.join(seen, "node", "left_anti")
        seen = settle(seen.union(front))
        # Reached parents stay as sources only where they have just been reached: what older ones reach is in the front.
        rest = steps.join(seen, steps.parent == seen.node, "left_anti").union(steps.join(front, steps.parent == front.node, "left_semi"))
        rest = settle(rest)
        onward = rest.select(F.col("parent").alias("child"), F.col("child").alias("far"))
        steps = settle(rest.union(rest.join(onward, "child").select("parent", F.col("far").alias("child"))).where("parent <> child").distinct())
