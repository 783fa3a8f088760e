"""Policy tables, transitions, invariants and an operation trace against a plain model."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkcatalog import schema
from chunkcatalog.engine import Engine
from chunkcatalog.functions import ids, kernels, paths, policy
from chunkcatalog.operators import bytes as byte_ops
from chunkcatalog.operators import catalog, invariants, ordered, planners, transitions
from chunkcatalog.plans import commit, store
from chunkcatalog.sources import logs
from chunkcatalog.streaming import write_ops

MIB = 1 << 20


def test_compaction_policy(spark):
    """Against a plain loop over random usages, and the waste's own properties."""
    rng = random.Random(31)
    usages = [(i, (total := rng.randrange(0, 900)), rng.randrange(0, 1000)) for i in range(120)]
    x = spark.createDataFrame(usages, "vlog_id long, total_bytes long, live_bytes long")
    x = x.withColumn("dead_bytes", policy.dead_bytes(F.col("total_bytes"), F.col("live_bytes"))).withColumn("ratio", policy.waste_ratio(F.col("total_bytes"), F.col("live_bytes")))
    rows = x.collect()
    for r in rows:
        assert r.dead_bytes == max(r.total_bytes - r.live_bytes, 0) and 0 <= r.ratio <= 1
        assert r.ratio == (pytest.approx(r.dead_bytes / r.total_bytes) if r.total_bytes else 0)
    for rule in (planners.CompactionPolicy(1, 3, 90, 7), planners.CompactionPolicy(1, 2, 1, 0)):
        worth = [r for r in rows if r.total_bytes and r.dead_bytes >= rule.least_dead and r.dead_bytes / r.total_bytes >= rule.num / rule.den]
        want = [r.vlog_id for r in sorted(worth, key=lambda r: (-r.dead_bytes, r.vlog_id))]
        assert [r.vlog_id for r in planners.compaction_candidates(x, rule).collect()] == (want[: rule.max_jobs] if rule.max_jobs else want)
    held = spark.createDataFrame([(i,) for i in range(0, 120, 2)], "vlog_id long")
    assert all(r.vlog_id % 2 for r in planners.compaction_candidates(x, planners.CompactionPolicy(1, 9, 1, 0), held).collect())


def test_promotable_prefix(spark):
    """Of every prefix of a random log that fills a row the one with the least padding, the longest of those; none below a row."""
    rng = random.Random(32)
    logs_ = {g: [rng.randrange(1, 260) for _ in range(rng.randrange(0, 12))] for g in range(60)}
    rows = spark.createDataFrame([(g, i, n) for g, lens in logs_.items() for i, n in enumerate(lens)], "g long, pos int, len long")
    got = {r.g: (r["count"], r.padded, r.pad) for r in ordered.promotable_prefix(rows, ["g"], ["pos"], "len", 700).collect()}
    want = {}
    for g, lens in logs_.items():
        sums = [sum(lens[:k]) + 64 * k for k in range(1, len(lens) + 1)]
        full = [(-t % 700, -k, t + -t % 700) for k, t in enumerate(sums, 1) if t >= 700]
        if full:
            pad, k, padded = min(full)
            want[g] = (-k, padded, pad)
    assert got == want and 10 < len(want) < 60


def test_thresholds(spark):
    """What a commit and a read need, by each scheme's definition, over all small shapes; a commit never needs less than a read, nor more than there is."""
    shapes = [(s, d, p, n) for s in schema.SCHEMES for d in range(1, 6) for p in range(0, 4) for n in range(1, 8) if s != "EC" or n == d + p]
    x = spark.createDataFrame(shapes, "s string, d int, p int, n int")
    for r in x.select("*", policy.commit_threshold(F.col("s"), F.col("d"), F.col("p"), F.col("n")).alias("commit"), policy.read_threshold(F.col("s"), F.col("d")).alias("read")).collect():
        assert r["read"] == (r.d if r.s == "EC" else 1)
        assert r["read"] <= r.commit <= r.n
        if r.s == "EC":
            assert r.commit == r.n
        else:
            assert r.commit == (1 if r.s == "NONE" or r.n < 2 else policy.MIN_COPIES)


def test_paths(spark):
    rows = [("a", "", "a"), ("a/b", "a", "b"), ("a/b/c", "a/b", "c"), ("/a/b", "a", "b"), ("", "", "")]
    for r in spark.createDataFrame(rows, "p string, a string, b string").select(paths.parent(F.col("p")).alias("x"), paths.name(F.col("p")).alias("y"), "a", "b").collect():
        assert (r.x, r.y) == (r.a, r.b)
    one = spark.createDataFrame([("a/b/c",), ("f",)], "p string").select(paths.ancestors(F.col("p")).alias("x"), paths.bucket(F.col("p")).alias("b"), paths.escape_like(F.lit("a%b_c\\")).alias("e")).collect()
    assert [(r.x, r.b) for r in one] == [(["a/b", "a"], "a"), ([], "")]
    assert one[0].e == "a\\%b\\_c\\\\"


def disks_and_nodes(spark, n_nodes=4, per_node=2):
    disks = spark.createDataFrame([(n * per_node + d, n, "active") for n in range(1, n_nodes + 1) for d in range(per_node)], "id long, node_id long, state string")
    nodes = spark.createDataFrame([(n, "working") for n in range(1, n_nodes + 1)], "id long, state string")
    return disks, nodes


def levelled(placed, node_of, band, most):
    """Greedy levelling by loops: ``placed`` is a list of [log, shard's log, disk, bytes]."""
    placed, moves = [list(p) for p in placed], []
    while len(moves) < most:
        used = {d: sum(p[3] for p in placed if p[2] == d) for d in node_of}
        source = min(used, key=lambda d: (-used[d], d))
        best = None
        for p in placed:
            if p[2] != source or p[3] <= 0:
                continue
            taken = {node_of[q[2]] for q in placed if q[0] == p[0] and q[1] != p[1]}
            for d in node_of:
                if d != source and node_of[d] not in taken and used[source] - used[d] > band and p[3] < used[source] - used[d]:
                    key = (used[d], d, -p[3], p[1])
                    best = min(best, (key, p, d)) if best else (key, p, d)
        if best is None:
            break
        moves.append((best[1][1], source, best[2]))
        best[1][2] = best[2]
    return moves, placed


def test_rebalance(spark):
    """Against loops over random placements; the spread of the disks never grows, and a cooldown stops all."""
    rng = random.Random(33)
    node_of = {d: (d + 1) // 2 for d in range(1, 7)}
    disks = spark.createDataFrame([(d, n, "active") for d, n in node_of.items()], "id long, node_id long, state string")
    nodes = spark.createDataFrame([(n, "working") for n in set(node_of.values())], "id long, state string")
    for band in (40, 400):
        shards_ = [(v, 10 * v + i, d, rng.randrange(0, 300)) for v in range(1, 9) for i, d in enumerate(rng.sample([1, 2, 3, 5], rng.randrange(1, 3)))]
        placed = spark.createDataFrame([(v, i, p, d, n) for i, (v, p, d, n) in enumerate(shards_)], "vlog_id long, shard_idx int, plog_id long, disk_id long, length long")
        got = planners.rebalance(placed, disks, nodes, planners.RebalancePolicy(band=band, max_moves=3)).orderBy("move").collect()
        want, after = levelled(shards_, node_of, band, 3)
        assert [(m.plog_id, m.from_disk, m.to_disk) for m in got] == want
        spread = lambda rows: (lambda u: max(u) - min(u))([sum(r[3] for r in rows if r[2] == d) for d in node_of])
        assert spread(after) <= spread(shards_)
    assert planners.rebalance(placed, disks, nodes, planners.RebalancePolicy(band=1), last_moved=10, now=11).count() == 0


def shuffled_records(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rebalance_leaves_other_logs_in_place(spark):
    """A round shuffles the logs with a shard on its source and sums of the disks, not the placements."""
    disks, nodes = disks_and_nodes(spark, 50, 2)
    n = F.col("id")
    placed = spark.range(30_000).select((n / 3).cast("long").alias("vlog_id"), (n % 3).alias("shard_idx"), n.alias("plog_id"), (n * 37 % 100 + 2).alias("disk_id"), F.lit(100).cast("long").alias("length"))
    placed = placed.union(spark.createDataFrame([(-1, 0, -1, 2, 5000)], placed.schema))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_records(spark)
        got = planners.rebalance(placed, disks, nodes, planners.RebalancePolicy(band=1, max_moves=3)).orderBy("move").collect()
        assert [(m.from_disk, m.to_disk) for m in got] == [(2, 3), (2, 4), (2, 5)] and got[0].bytes == 100
        assert shuffled_records(spark) - before < 15_000
        before, asked = shuffled_records(spark), []
        of_logs = lambda logs: asked.append(1) or placed.join(logs, "vlog_id", "left_semi")
        assert planners.rebalance(placed, disks, nodes, planners.RebalancePolicy(band=1, max_moves=3), of_logs=of_logs).orderBy("move").collect() == got and len(asked) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


class Captured:
    """A frame that hands the function given to mapInArrow back."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


@pytest.mark.parametrize("kernel", ["encode_rows", "crypt", "encode_logs"])
def test_kernels_take_pieces_of_batches(spark, kernel):
    """Of a batch of Spark's size only a few MB at a time are Python objects and results, whatever its rows hold; a long row goes by itself."""
    import pyarrow as pa

    data = [bytes([i % 251]) * (8192 if i % 500 else 3 << 20) if i % 7 else None if kernel != "encode_rows" else b"" for i in range(2000)]
    ids_ = pa.array(range(2000), pa.int64())
    columns = {"encode_rows": [ids_, ids_], "crypt": [ids_, pa.array([str(i) for i in range(2000)]), pa.array([0] * 2000, pa.int64())], "encode_logs": [ids_]}[kernel]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], [f"c{i}" for i in range(len(columns) + 1)])
    run = {"encode_rows": lambda: byte_ops.encode_rows(Captured(), 2, 1), "crypt": lambda: byte_ops.crypt(Captured(), b"k" * 16, b"l"), "encode_logs": lambda: byte_ops.encode_logs(Captured(), b"k")}[kernel]()
    out = list(run(iter([batch, batch.slice(0, 0)])))
    assert max(b.nbytes for b in out) < 8 << 20
    one_by_one = [b for i in range(0, 2000, 40) for b in run(iter([batch.slice(i, 1)]))]
    whole = pa.Table.from_batches(out)
    assert whole.num_rows == 2000 * (3 if kernel == "encode_rows" else 1)
    if kernel != "encode_rows":
        assert whole.take(list(range(0, 2000, 40))).to_pylist() == pa.Table.from_batches(one_by_one).to_pylist()


def test_long_streams_are_made_in_pieces():
    """A stream over several pieces, from any offset and past the counter's end, is the one made block by block."""
    base = (2**128 - 5).to_bytes(16, "big")
    data = bytes(range(256)) * 1200
    whole = kernels.ctr_xor(b"k" * 16, base, 0, data)
    for i in (0, 4, 5, 6, 1023, 16383, 16384, 16385, 19199):
        block = kernels.aes128_blocks(b"k" * 16, np.frombuffer(((2**128 - 5 + i) % 2**128).to_bytes(16, "big"), np.uint8)[None]).tobytes()
        assert whole[16 * i : 16 * i + 16] == bytes(a ^ b for a, b in zip(data[16 * i : 16 * i + 16], block, strict=True))
    for at in (1, 15, 17, 262_143, 262_145):
        assert kernels.ctr_xor(b"k" * 16, base, at, data[at:]) == whole[at:]
    assert kernels.ctr_xor(b"k" * 16, base, 3, b"") == b""


def test_destinations_avoid_nodes(spark):
    disks, nodes = disks_and_nodes(spark)
    placed = spark.createDataFrame([(1, 0, 10, 2, 5), (1, 1, 11, 4, 5), (2, 0, 20, 2, 5)], "vlog_id long, shard_idx int, plog_id long, disk_id long, length long")
    got = {r.plog_id: r.dest_disk for r in planners.drain(2, placed, disks.withColumn("state", F.when(F.col("id") == 2, "draining").otherwise("active")), nodes).collect()}
    assert got == {10: 3, 20: 3}
    full = spark.createDataFrame([(1, i, i, 2 * (i + 1), 5) for i in range(4)], "vlog_id long, shard_idx int, plog_id long, disk_id long, length long")
    down = disks.withColumn("state", F.when(F.col("node_id") == 1, "failed").otherwise("active"))
    assert [r.dest_disk for r in planners.drain(2, full, down, nodes).collect()] == [None]


def test_reference_counts(spark):
    """Random versions of a few files against counting; a chunk keeps the place it first got, also when it died between."""
    rng = random.Random(34)
    cat, heads, places = schema.empty_catalog(spark), {}, {}
    for step in range(4):
        files = {f"f{i}": rng.choices("PQRSTU", k=rng.randrange(0, 5)) for i in rng.sample(range(3), 2)}
        batch = spark.createDataFrame([(p, step, [(h, 5) for h in hs]) for p, hs in files.items()], "path string, mtime long, chunks array<struct<hash:string,len:int>>")
        flat = [(p, i, h) for p, hs in sorted(files.items()) for i, h in enumerate(hs)]
        rows = spark.createDataFrame([(f"{p}{i}", h, 3, 1000 * step + n, 5, 5) for n, (p, i, h) in enumerate(flat)], "pos string, hash string, vlog_id long, vaddr_offset long, logical_len long, compressed_len long")
        for n, (_, _, h) in enumerate(flat):
            places.setdefault(h, 1000 * step + n)
        cat = store.settle_all(transitions.publish_files(cat, batch, rows), "file", "file_head", "chunk", "dir")
        heads |= files
        counts = {h: sum(hs.count(h) for hs in heads.values()) for h in places}
        got = cat["chunk"].collect()
        assert {r.hash: r.refcount for r in got} == counts and {r.hash: r.vaddr_offset for r in got} == places
    dead = sorted(h for h, n in counts.items() if n == 0)
    pins = spark.createDataFrame([(h,) for h in dead[:1]], "hash string")
    assert sorted(r.hash for r in transitions.collect_garbage(cat, pins)[1].collect()) == dead[1:]


def test_long_chains_are_reached(spark):
    """Nodes far below a root, in a ring, or above it."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (2000, 0)]
    nodes = spark.createDataFrame([(i,) for i in [*range(301), 1000, 1001, 2000, 5000]], "node long")
    got = planners.unreachable(nodes, spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame([(7,), (1000,)], "node long"))
    assert sorted(r.node for r in got.collect()) == [*range(7), 2000, 5000]


def test_random_uids(spark):
    got = [r.u for r in spark.range(200).select(ids.random_uid().alias("u")).collect()]
    assert len(set(got)) == 200 and all(len(u) == 30 and int(u, 16) >= 0 for u in got)
    back = spark.createDataFrame([(u,) for u in got], "u string").select("u", ids.parse_uid(ids.uid_text(F.col("u"))).alias("b")).collect()
    assert all(r.u == r.b for r in back)


def test_appends_within_a_batch(spark):
    log = spark.createDataFrame([(1, 0, b"ab")], "log_id long, offset long, data binary")
    same = spark.createDataFrame([(1, 0, b"ab"), (1, 2, b"c"), (1, 2, b"c")], log.schema)
    assert sorted((r.offset, bytes(r.data)) for r in store.append_once(log, same).collect()) == [(0, b"ab"), (2, b"c")]
    for other in ([(1, 0, b"xx")], [(1, 5, b"a"), (1, 5, b"b")]):
        with pytest.raises(Exception, match="other bytes"):
            store.append_once(log, spark.createDataFrame(other, log.schema)).collect()


def test_write_ops_and_leases(spark):
    cat = schema.empty_catalog(spark)
    batch = spark.createDataFrame([("op-1", "/file", 5), ("op-1", "/file", 6), ("op-2", "/g", 7)], "idempotency_key string, path string, created_at long")
    cat["write_op"] = store.settle(transitions.create_write_ops(cat["write_op"], batch))
    assert store.settle(transitions.create_write_ops(cat["write_op"], batch)).count() == 2
    cat, refused = transitions.claim(cat, spark.createDataFrame([(1, 9), (2, 9)], "write_op_id long, vlog_id long"))
    assert [r.write_op_id for r in refused.collect()] == [2]
    cat = transitions.commit_write_ops(cat, spark.createDataFrame([(1, 77)], "id long, file_id long"))
    cat = transitions.abandon_write_ops(cat, spark.createDataFrame([(1,), (2,)], "id long"))
    assert [(r.id, r.state, r.file_id) for r in cat["write_op"].orderBy("id").collect()] == [(1, "committed", 77), (2, "abandoned", 0)]
    assert cat["vlog_lease"].count() == 0
    with pytest.raises(Exception, match="another path"):
        transitions.bind(cat["write_op"], spark.createDataFrame([("op-1", "/other")], "idempotency_key string, path string")).collect()


def test_jobs_and_nodes(spark):
    cat = schema.empty_catalog(spark)
    wanted = spark.createDataFrame([("reprotect", 0, 4, 5), ("reprotect", 0, 4, 6), ("drain", 0, 4, 7)], "kind string, target_vlog long, target_disk long, created_at long")
    cat["job"], given = transitions.get_or_create_jobs(cat["job"], wanted)
    cat["job"] = store.settle(cat["job"])
    assert cat["job"].count() == 2 and given.count() == 2
    assert transitions.get_or_create_jobs(cat["job"], wanted)[0].count() == 2
    cat["disk"] = spark.createDataFrame([(4, "u", 1, 10, 0, "failed"), (5, "v", 1, 10, 0, "failed")], schema.TABLES["disk"])
    cat["node"] = spark.createDataFrame([(1, "m", "h", "failed")], schema.TABLES["node"])
    cat = transitions.node_returned(cat, 1)
    assert {r.id: r.state for r in cat["disk"].collect()} == {4: "active", 5: "failed"}
    assert {r.kind: r.state for r in cat["job"].collect()} == {"reprotect": "cancelled", "drain": "running"}
    assert cat["node"].first().state == "working"


def test_identifiers(spark):
    raw = bytes(range(15)).hex()
    r = spark.createDataFrame([(raw,)], "h string").select(ids.uid_text(F.col("h")).alias("t")).withColumn("b", ids.parse_uid(F.lower(ids.key_groups(F.col("t"))))).withColumn("bad", ids.parse_uid(F.lit("U" * 24))).withColumn("odd", ids.parse_uid(F.lit("oil" + "0" * 21))).first()
    assert r.b == raw and len(r.t) == 24 and r.bad is None and r.odd == ids_hex("011" + "0" * 21)


def ids_hex(text):
    n = 0
    for c in text:
        n = n * 32 + ids.ALPHABET.index(c)
    return f"{n:030x}"


def test_known_vectors():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert kernels.aes128_blocks(key, np.frombuffer(plain, np.uint8)[None]).tobytes().hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert int(kernels.crc32c(np.frombuffer(b"123456789", np.uint8)[None])[0]) == 0xE3069283
    assert kernels.fnv1a32(b"a") == 0xE40C292C


def test_ctr_can_start_anywhere():
    data = np.random.default_rng(3).bytes(1000)
    whole = kernels.ctr_xor(b"k" * 16, b"\xff" * 16, 0, data)
    assert kernels.ctr_xor(b"k" * 16, b"\xff" * 16, 0, whole) == data
    for at in (0, 1, 15, 16, 17, 333):
        assert kernels.ctr_xor(b"k" * 16, b"\xff" * 16, at, data[at : at + 50]) == whole[at : at + 50]


@pytest.mark.parametrize(("d", "p"), [(2, 1), (3, 1), (4, 2), (5, 3)])
def test_reed_solomon_recovers(d, p):
    row = np.random.default_rng(d).bytes(d * 100 + 7)
    shards = kernels.rs_encode(row, d, p)
    rng = random.Random(d)
    for _ in range(10):
        have = {i: shards[i] for i in rng.sample(range(d + p), d)}
        assert kernels.rs_reconstruct(have, d, p) == shards
    with pytest.raises(ValueError):
        kernels.rs_reconstruct({0: shards[0]}, d, p)


def test_chunking_tiles_and_resynchronises():
    rng = np.random.default_rng(5)
    data = rng.bytes(200_000)
    ends = kernels.cut_points(data, 256, 1024, 4096)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= 256 and sizes.max() <= 4096
    moved = {e - 100 for e in kernels.cut_points(rng.bytes(100) + data, 256, 1024, 4096)}
    assert len(moved & set(ends)) > 0.9 * len(ends)
    assert kernels.cut_points(b"") == [] and kernels.cut_points(b"abc") == [3]


def test_headers():
    for flags in range(4):
        raw = kernels.encode_header(flags, 2**63 + 1, 5, 77, 9, 11, kernels.path_hint("a/b/c", bool(flags & 1), 2))
        got, error = kernels.decode_header(raw)
        assert not error and (got["file_id"], got["chunk_hash"], got["length"]) == (2**63 + 1, 5, 77)
        assert kernels.open_header(kernels.seal_header(raw, b"k" * 16, b"c"), b"k" * 16, b"c") == (got, "")
        assert kernels.open_header(kernels.seal_header(raw, b"k" * 16, b"c"), b"x" * 16, b"c")[0] is None
    ok = kernels.encode_header(1, 1, 1, 1)
    for at, why in ((0, "magic"), (4, "version"), (5, "flags"), (6, "reserved"), (20, "crc")):
        assert kernels.decode_header(ok[:at] + b"\xf0" + ok[at + 1 :])[1] == why
    assert kernels.decode_header(ok[:-1])[1] == "length"
    assert len(kernels.path_hint("x/" * 200 + "end", True)) == 32


@pytest.mark.parametrize("size", [0, 1, 4096, 4097, 255 * 4096, 255 * 4096 + 10, 3 * 255 * 4096 + 5000])
def test_log_files(size):
    data = np.random.default_rng(7).bytes(size)
    raw = kernels.encode_log(data, b"key")
    assert kernels.decode_log(raw, b"key") == (data, [], 0)
    if size > 4096:
        broken = raw[: 4096 + 5000] + bytes([raw[4096 + 5000] ^ 1]) + raw[4096 + 5001 :]
        assert kernels.decode_log(broken, b"key")[1:] == ([1], 0)
        with pytest.raises(ValueError):
            kernels.read_range(broken, b"key", 4096, 10)
        assert kernels.read_range(broken, b"key", 0, 100) == data[:100]
    with pytest.raises(ValueError):
        kernels.decode_log(raw, b"other")


def test_sources_and_strays(spark, tmp_path):
    for disk, plog in ((1, 3), (1, 4), (2, 5)):
        (tmp_path / f"d{disk}").mkdir(exist_ok=True)
        (tmp_path / f"d{disk}" / f"plog-{plog:05d}").write_bytes(kernels.encode_log(b"x" * 9000, b"k"))
    (tmp_path / "d1" / "plog-x").write_bytes(b"no")
    roots = spark.createDataFrame([(1, str(tmp_path / "d1")), (2, str(tmp_path / "d2"))], "disk_id long, root string")
    found = logs.list_logs(spark, roots)
    known = spark.createDataFrame([(3, 1), (5, 1)], "id long, disk_id long")
    assert sorted((r.disk_id, r.plog_id) for r in planners.strays(found, known).collect()) == [(1, 4), (2, 5)]
    x = logs.read_logs(spark, str(tmp_path))
    assert {(r.plog_id, r.sectors, r.corrupt, r.bad_blocks) for r in byte_ops.scrub(x, b"k").collect()} == {(3, 3, 0, 0), (4, 3, 0, 0), (5, 3, 0, 0)}
    assert logs.sectors(x).where("plog_id = 3").count() == 5
    both = logs.reconcile_roots(spark.createDataFrame([("r1", "u1"), ("r2", "u2")], "root string, uid string"), spark.createDataFrame([(1, "u1"), (2, "u9")], "id long, uid string"))
    assert {(r.root, r.id, r.status) for r in both.collect()} == {("r1", 1, "bound"), ("r2", None, "new"), (None, 2, "missing")}


def test_append_once(spark):
    log = spark.createDataFrame([(1, 0, b"ab")], "log_id long, offset long, data binary")
    more = spark.createDataFrame([(1, 0, b"ab"), (1, 2, b"cd")], log.schema)
    assert store.append_once(log, more).count() == 2
    with pytest.raises(Exception, match="other bytes"):
        store.append_once(log, spark.createDataFrame([(1, 0, b"xx")], log.schema)).collect()


def test_stream_of_write_ops(spark, tmp_path):
    source = tmp_path / "in"
    rows = [
        [("a", "open", 0), ("b", "open", 1), ("c", "open", 2), ("a", "commit", 3)],
        [("a", "abandon", 100), ("b", "touch", 1000), ("z", "open", 5000)],
        [("b", "commit", 5001), ("y", "open", 20000)],
        [("y", "touch", 20001)],
    ]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "idempotency_key string, event string, s int").select("idempotency_key", "event", F.timestamp_seconds(F.col("s") + 10).alias("at")).coalesce(1).write.parquet(str(source / f"{k}"))
    files = sorted(source.glob("*/*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, f in enumerate(files):
        (flat / f"{k}.parquet").write_bytes(f.read_bytes())
        os.utime(flat / f"{k}.parquet", (k + 1, k + 1))
    stream = spark.readStream.schema(write_ops.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(flat))
    q = write_ops.lifecycle(stream, expiry_s=3600).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("changes").collect():
        got.setdefault(r.idempotency_key, []).append(r.state)
    assert got["a"] == ["prepared", "committed"]
    assert got["c"] == ["prepared", "abandoned"]
    assert got["b"][0] == "prepared" and got["b"][-1] in ("committed", "abandoned") and len(got["b"]) == 2


def test_incremental_readiness(spark):
    disks, nodes = disks_and_nodes(spark)
    vlogs = spark.createDataFrame([(1, "EC", 1, 1), (2, "NONE", 1, 0)], "id long, protection_scheme string, data_shards int, parity_shards int")
    placed = spark.createDataFrame([(1, 0, 10, 2), (1, 1, 11, 4), (2, 0, 20, 6)], "vlog_id long, shard_idx int, plog_id long, disk_id long")
    before = catalog.readiness(vlogs, placed, disks, nodes)
    broken = disks.withColumn("state", F.when(F.col("id") == 4, "failed").otherwise("active"))
    after = write_ops.changed_readiness(before, spark.createDataFrame([(4,)], "disk_id long"), placed, lambda p: catalog.readiness(vlogs, p, broken, nodes))
    assert sorted(after.collect()) == sorted(catalog.readiness(vlogs, placed, broken, nodes).collect())


def test_range_join_and_anti(spark):
    rng = random.Random(2)
    a = [(g, lo, lo + rng.randint(0, 9000)) for g in range(2) for lo in (rng.randint(0, 30000) for _ in range(60))]
    b = [(g, lo, lo + rng.randint(0, 9000)) for g in range(2) for lo in (rng.randint(0, 30000) for _ in range(20))]
    left, right = spark.createDataFrame(a, "g int, lo long, hi long").distinct(), spark.createDataFrame(b, "g int, r_lo long, r_hi long").distinct()
    meets = lambda x, y: x[0] == y[0] and x[2] > y[1] and x[1] < y[2] and x[1] < x[2] and y[1] < y[2]
    want = sorted((*x, *y[1:]) for x in set(a) for y in set(b) if meets(x, y))
    assert sorted(tuple(r) for r in ordered.range_join(left, right, ["g"], "lo", "hi", "r_lo", "r_hi", bucket=1000).collect()) == want
    alone = sorted(x for x in set(a) if not any(meets(x, y) for y in set(b)))
    assert sorted(tuple(r) for r in ordered.range_join(left, right, ["g"], "lo", "hi", "r_lo", "r_hi", bucket=1000, how="left_anti").collect()) == alone


def test_engine_trace(spark, tmp_path):
    """A seeded trace of operations against a dict, with invariants and a published version at the end."""
    e = Engine(spark, (64, 256, 1024))
    for n in (1, 2, 3):
        e.add_node(n, f"m{n}", f"h{n}")
        e.add_disk(n, f"u{n}", n, 1 << 40)
    assert e.make_vlog() == 1
    rng, model, snaps = np.random.default_rng(11), {}, {}
    data = {f"d{i % 2}/f{i}": rng.bytes(int(rng.integers(0, 3000))) for i in range(5)}
    e.write(data, mtime=1)
    model |= data
    snaps[e.create_snapshot("one", 5)] = dict(model)
    again = {"d0/f0": data["d0/f0"] + b"tail", "d1/f1": data["d1/f3"]}
    e.write(again, mtime=2)
    model |= again
    e.rename("d0", "moved")
    model = {("moved" + p[2:] if p.startswith("d0/") else p): d for p, d in model.items()}
    e.unlink("d1/f3")
    model.pop("d1/f3")
    e.mkdir("empty/inner")
    with pytest.raises(OSError):
        e.rmdir("empty")
    e.rmdir("empty/inner")
    for path, want in model.items():
        assert e.read(path) == want
    assert e.read("d1/f1", 10, 20) == model["d1/f1"][10:30]
    for snap, frozen in snaps.items():
        for path, want in frozen.items():
            assert e.read(path, snapshot_id=snap) == want
    assert e.broken() == {}
    assert [r.name for r in e.list_dir("").collect()] == ["d1", "empty", "moved"]
    e.delete_snapshot(1)
    e.delete_snapshot(1)
    assert e.broken() == {}
    assert e.collect_garbage() > 0
    assert e.compact(planners.CompactionPolicy(least_dead=1, num=0)) == [1]
    assert all(e.read(p) == d for p, d in model.items()) and e.broken() == {}
    op = e.open_write("d1/new", "key-1", 7)
    assert op == e.open_write("d1/new", "key-1", 8)
    assert e.close_write("key-1", b"first", 9) == e.close_write("key-1", b"again", 10) == "committed"
    with pytest.raises(Exception, match="another path"):
        e.open_write("other", "key-1", 8)
    e.write_at("d1/new", [(3, b"XYZ12"), (10, b"end"), (4, b"__")], 11)
    assert e.read("d1/new") == b"firX__12\0\0end"
    e.truncate("d1/new", 6, 12)
    assert e.read("d1/new") == b"firX__" and e.broken() == {}
    model["d1/new"] = b"firX__"
    e.add_disk(4, "u4", 2, 1 << 40)
    job = e.request("drain", 13, disk_id=2)
    assert job == e.request("drain", 14, disk_id=2) and e.run_jobs() == {job: "done"} and e.run_jobs() == {}
    e.set_disk_state(1, "failed")
    report = e.maintain(now=10)
    assert not any(isinstance(x, Exception) for x in report.values())
    version = e.publish(str(tmp_path / "pub"), 9)
    assert store.load(spark, str(tmp_path / "pub"), version)["file_head"].count() == len(model)


def engine_with_disks(spark, nodes, **options):
    e = Engine(spark, (64, 256, 1024), **options)
    for n in range(1, nodes + 1):
        e.add_node(n, f"m{n}", f"h{n}")
        e.add_disk(n, f"u{n}", n, 1 << 40)
    return e


def damaged(e, at):
    """Changes a byte of the shards for which the condition holds, behind the engine's back."""
    broken = F.concat(F.lit(b"\xff\x00\xfe"), F.expr("substring(shard, 4)"))
    e.shards = store.settle(e.shards.withColumn("shard", F.when(at, broken).otherwise(F.col("shard"))))


def test_promotion_loss_and_repair(spark):
    """Staged chunks become coded rows; two shards of each row are lost or damaged, one after the other, and all bytes are read back from rebuilt ones."""
    rng = np.random.default_rng(5)
    e = engine_with_disks(spark, 5, column=512)
    stage = e.make_vlog("EC", 2, 2, staging=True)
    data = {f"f{i}": rng.bytes(int(rng.integers(1, 2500))) for i in range(4)} | {"empty": b""}
    e.write(data, 1)
    done = e.promote()
    assert set(done) == {stage} and e.cat["vlog"].where("protection_scheme = 'EC'").count() == 1
    dest = done[stage]
    length = e.cat["vlog"].where(F.col("id") == dest).first().length
    assert length > 0 and length % (512 * 2) == 0 and e.broken() == {}
    moved = e.cat["chunk"].where(F.col("vlog_id") == dest).count()
    assert moved > 0 and all(e.read(p) == d for p, d in data.items())
    assert e.read("f1", 5, 40) == data["f1"][5:45]
    # A damaged shard is not read, and repair makes it again.
    damaged(e, (F.col("vlog_id") == dest) & (F.col("shard_idx") == 0))
    assert e.scrub().where(F.col("vlog_id") == dest).first().unhealthy == [0]
    assert all(e.read(p) == d for p, d in data.items())
    assert e.repair().get("repair") == 1 and e.scrub().where("corrupt > 0").count() == 0
    # A lost disk: its shards are made again elsewhere, then two other shards may go.
    disk = e.placements().where((F.col("vlog_id") == dest) & (F.col("shard_idx") == 1)).first().disk_id
    e.set_disk_state(disk, "failed")
    assert all(e.read(p) == d for p, d in data.items())
    assert e.reprotect() >= 1 and e.cat["plog"].where(F.col("disk_id") == disk).count() == 0
    damaged(e, (F.col("vlog_id") == dest) & F.col("shard_idx").isin(0, 2))
    assert all(e.read(p) == d for p, d in data.items())
    # Beyond what the code can bear nothing is made up.
    damaged(e, (F.col("vlog_id") == dest) & (F.col("shard_idx") == 3))
    assert e.repair().get("unrepairable") == 1
    with pytest.raises(OSError, match="missing or corrupt"):
        for p in data:
            e.read(p)


def test_logs_roll_over_and_disks_are_replaced(spark):
    rng = np.random.default_rng(6)
    e = engine_with_disks(spark, 3, max_log=3000)
    e.make_vlog()
    data = {f"f{i}": rng.bytes(2000) for i in range(4)}
    e.write(data, 1)
    assert e.cat["vlog"].count() > 1 and e.cat["chunk"].agg(F.max("vaddr_offset")).first()[0] < 3000 and e.broken() == {}
    assert all(e.read(p) == d for p, d in data.items())
    e.add_disk(9, "u9", 2, 1 << 40)
    job = e.request("replace", 3, disk_id=2, dest_disk=9)
    assert e.request("replace", 4, disk_id=2, dest_disk=3) == job and e.run_jobs() == {job: "done"}
    assert e.cat["plog"].where("disk_id = 2").count() == 0 and e.cat["disk"].where("id = 2").first().state == "detached"
    assert all(e.read(p) == d for p, d in data.items())
    raw = e.make_vlog()
    at = [e.append_log(raw, b"raw bytes"), e.append_log(raw, b"more")]
    assert (e.read_log(raw, at[0], 9), e.read_log(raw, at[1], 4)) == (b"raw bytes", b"more")
    with pytest.raises(OSError, match="takes no record"):
        e.append_log(1, b"x" * 3000)
    with pytest.raises(OSError, match="cannot take"):
        e.migrate(e.placements().where("disk_id = 9").first().plog_id, 3)
    job = e.remove_disk(1, 5)
    with pytest.raises(OSError, match="no place"):
        e.run_jobs()
    assert e.remove_disk(1, 6) == job  # it still runs, and is taken up again
    stray = e.shards.withColumn("plog_id", F.col("plog_id") + 1000)
    e.shards = store.settle(e.shards.unionByName(stray))
    n = stray.count()
    e.set_disk_state(3, "failed")
    assert e.sweep() == 0
    e.set_disk_state(3, "active")
    assert e.sweep() == n and all(e.read(p) == d for p, d in data.items())


def test_publication_survives_every_crash_and_interleaving():
    def txn(name, first):
        return commit.start(name, [commit.Write(s, first + s) for s in range(3)])

    states = [txn("a", 0)]
    while not commit.finished(states[-1]):
        states.append(commit.step(states[-1]))
    assert len(states) == 11 and all(commit.consistent(s) for s in states)
    assert [commit.recover(s) for s in states] == ["aborted"] * 8 + ["committed"] * 3
    assert not any(s.acknowledged and commit.recover(s) != "committed" for s in states)
    # Two transactions share nothing, so a state is a pair of places; all schedules are the paths through them.
    n = len(states) - 1
    paths = [[1] * (n + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            paths[i][j] = paths[i - 1][j] + paths[i][j - 1]
            assert commit.consistent(states[i]) and commit.consistent(states[j])
    assert paths[n][n] == 184_756
    for bad in ([], [commit.Write(1, 1), commit.Write(1, 2)], [commit.Write(1, 1), commit.Write(2, 1)]):
        with pytest.raises(ValueError):
            commit.start("x", bad)


def test_random_namespace_trace(spark):
    """Weighted random operations on the catalog against a dict of lists, with frozen snapshots."""
    rng = random.Random(21)
    cat, model, frozen = schema.empty_catalog(spark), {}, {}
    hashes = [f"h{i}" for i in range(12)]
    for n in range(14):
        op = rng.choices(["write", "unlink", "rename", "rename_dir", "snapshot", "drop", "gc"], [38, 8, 6, 4, 8, 4, 6])[0]
        path = f"{rng.choice('ab')}/{rng.choice('xyz')}"
        if op == "write":
            names = [rng.choice(hashes) for _ in range(rng.randint(0, 4))]
            batch = spark.createDataFrame([(path, n, [(h, 3) for h in names])], "path string, mtime long, chunks array<struct<hash:string,len:int>>")
            rows = spark.createDataFrame([(i, h, 1, 100 * i, 3, 3) for i, h in enumerate(names)], "pos int, hash string, vlog_id long, vaddr_offset long, logical_len long, compressed_len long")
            cat = transitions.publish_files(cat, batch, rows)
            model[path] = names
        elif op == "unlink":
            cat = transitions.unlink(cat, spark.createDataFrame([(path,)], "path string"))
            model.pop(path, None)
        elif op == "rename" and path in model:
            new = f"{rng.choice('ab')}/{rng.choice('xyz')}"
            if new != path:
                cat = transitions.rename(cat, path, new)
                model[new] = model.pop(path)
        elif op == "rename_dir":
            cat = transitions.rename(cat, "a", "b")
            model = {p: v for p, v in model.items() if p.startswith("b/") and f"a/{p[2:]}" not in model} | {f"b/{p[2:]}": v for p, v in model.items() if p.startswith("a/")}
        elif op == "snapshot":
            cat = transitions.create_snapshot(cat, f"s{n}", n)
            frozen[f"s{n}"] = dict(model)
        elif op == "drop" and frozen:
            name = rng.choice(sorted(frozen))
            cat = transitions.delete_snapshots(cat, cat["snapshot"].where(F.col("name") == name))
            frozen.pop(name)
        elif op == "gc":
            cat, _ = transitions.collect_garbage(cat, spark.createDataFrame([], "hash string"))
        cat = store.settle_all(cat, "file", "file_head", "dir", "snapshot", "snapshot_file", "chunk")
    heads = {r.path: [c.hash for c in r.chunks] for r in cat["file_head"].join(cat["file"].select(F.col("id").alias("file_id"), "chunks"), "file_id").collect()}
    assert heads == model
    kept = cat["snapshot_file"].join(cat["snapshot"].select(F.col("id").alias("snapshot_id"), F.col("name").alias("snap")), "snapshot_id").join(cat["file"].select(F.col("id").alias("file_id"), "chunks"), "file_id").collect()
    got = {s: {} for s in frozen}
    for r in kept:
        got[r.snap][r.path] = [c.hash for c in r.chunks]
    assert got == frozen
    assert invariants.broken(cat, ["wrong_refcounts", "dangling", "two_heads"]) == {}
