"""Catalog tables made from the driver's tables, in Spark and, with the same names, as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.functions import ids, paths


class Tables:
    """The catalog over one folder of input tables; each property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def disk(self) -> DataFrame:
        state = F.when(F.col("s_acctbal") < 0, "failed").when(F.col("s_suppkey") % 10 == 3, "draining").otherwise("active")
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 1).cast("long").alias("node_id"), state.alias("state"))

    @property
    def node(self) -> DataFrame:
        return self.raw("nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.when(F.col("n_regionkey") == 0, "failed").otherwise("working").alias("state"))

    @property
    def placed(self) -> DataFrame:
        return self._placed(self.raw("lineitem"))

    def placed_of(self, logs: DataFrame) -> DataFrame:
        """``placed`` of ``logs(vlog_id)``: the others go before shards are numbered."""
        return self._placed(self.raw("lineitem").join(logs.select(F.col("vlog_id").alias("l_orderkey")), "l_orderkey", "left_semi"))

    def _placed(self, items: DataFrame) -> DataFrame:
        order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        x = items.withColumn("shard_idx", F.row_number().over(order) - 1)
        return x.select(F.col("l_orderkey").alias("vlog_id"), "shard_idx", (F.col("l_orderkey") * 1000 + F.col("shard_idx")).alias("plog_id"), F.col("l_suppkey").alias("disk_id"), (F.col("l_quantity").cast("long") * 1000).alias("length"))

    @property
    def vlog(self) -> DataFrame:
        x = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").cast("int").alias("n"), F.sum(F.col("l_quantity").cast("long") * 1000).alias("length"))
        k = F.col("id") % 3
        return x.select(
            "id",
            "length",
            F.when(k == 0, "NONE").when(k == 1, "DUPLICATE").otherwise("EC").alias("protection_scheme"),
            F.when(k == 2, F.greatest(F.col("n") - 1, F.lit(1))).otherwise(1).alias("data_shards"),
            F.when(k == 2, F.least(F.col("n") - 1, F.lit(1))).otherwise(0).alias("parity_shards"),
            F.when(F.col("id") % 5 == 0, 2).otherwise(0).alias("target_data_shards"),
            F.when(F.col("id") % 5 == 0, 1).otherwise(0).alias("target_parity_shards"),
        )

    @property
    def part_chunks(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("vlog_id"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("refcount"), F.col("l_quantity").cast("long").alias("compressed_len"))

    @property
    def part_logs(self) -> DataFrame:
        total = self.raw("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("long") + 64).alias("n"))
        return self.raw("part").select(F.col("p_partkey").alias("id"), "p_size").join(total, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("p_size")).alias("length"))

    @property
    def doc_rows(self) -> DataFrame:
        return self.raw("documents").select("doc_id", F.col("source").alias("bucket"), ids.chunk_hash(F.col("text")).alias("hash"), F.col("n_chars").alias("len"))

    @property
    def doc_chunks(self) -> DataFrame:
        """One row for each distinct text; every seventh is dead."""
        x = self.doc_rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("len").alias("len"))
        return x.select("hash", F.when(F.col("first") % 7 == 0, 0).otherwise(F.col("n")).alias("refcount"), (F.col("first") % 16).alias("vlog_id"), (F.col("first") * 1_000_000).alias("vaddr_offset"), F.col("len").alias("compressed_len"))

    @property
    def doc_extents(self) -> DataFrame:
        """Documents of a source behind each other, with their headers."""
        return self.raw("documents").select(F.col("source"), "doc_id", (F.col("n_chars") + 64).alias("bytes"))

    @property
    def conv_files(self) -> DataFrame:
        """Each turn of a conversation is a version: the list of its texts so far."""
        c = F.struct(ids.chunk_hash(F.col("text")).alias("hash"), F.length("text").alias("len"))
        upto = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
        return self.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), (F.col("turn") * 10).alias("mtime"), F.collect_list(c).over(upto).alias("chunks"))

    @property
    def tree(self) -> dict[str, DataFrame]:
        """A catalog of those versions in a tree of directories: files, heads, directories, and chunks with the references of the heads, all in one log."""
        conv = F.call_function("div", F.col("id"), F.lit(1000))
        text = lambda c: c.cast("string")
        files = self.conv_files.withColumn("path", F.concat(F.lit("c"), text(conv % 7), F.lit("/d"), text(conv % 3), F.lit("/"), text(conv)))
        last = F.max_by(F.struct("id", "mtime"), "id").alias("v")
        heads = files.groupBy("path").agg(last).select("path", F.col("v.id").alias("file_id"), paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"), F.col("v.mtime").alias("mtime"))
        dirs = heads.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
        dirs = dirs.select("path", paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"), F.lit(0).cast("long").alias("mtime"))
        held = files.join(heads.select(F.col("file_id").alias("id")), "id", "left_semi").select(F.explode("chunks").alias("c"))
        zero, length = F.lit(0).cast("long"), F.col("len").cast("long")
        chunks = held.groupBy(F.col("c.hash").alias("hash")).agg(F.count("*").alias("refcount"), F.max("c.len").alias("len"))
        chunks = chunks.select("hash", "refcount", F.lit(1).cast("long").alias("vlog_id"), zero.alias("vaddr_offset"), length.alias("logical_len"), length.alias("compressed_len"))
        none = lambda schema: self.spark.createDataFrame([], schema)
        return {"file": files, "file_head": heads, "dir": dirs, "chunk": chunks, "snapshot": none("id bigint, name string, created_at bigint"), "snapshot_file": none("snapshot_id bigint, path string, file_id bigint")}

    @property
    def page_paths(self) -> DataFrame:
        path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"\?.*$", "")
        return self.raw("pages").select("page_id", path.alias("path"), F.length("html").alias("size"))

    @property
    def page_heads(self) -> DataFrame:
        x = self.page_paths.groupBy("path").agg(F.max("page_id").alias("file_id"), F.max_by("size", "page_id").cast("long").alias("size"))
        return x.select("path", "file_id", paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"), "size")

    @property
    def write_op(self) -> DataFrame:
        at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("long")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("idempotency_key"),
            F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")).alias("path"),
            F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "prepared").otherwise("abandoned").alias("state"),
            F.when(F.col("o_orderkey") % 2 == 0, at * 1_000_000_000).otherwise(at).alias("created_at"),
        )

    @property
    def event_spans(self) -> DataFrame:
        """Writes of users to places in their file: [lo, hi), later events win."""
        lo = F.floor(F.abs("value") * 7).cast("long") % 500
        return self.raw("events").select("user_id", F.col("event_id").alias("seq"), lo.alias("lo"), (lo + 1 + F.col("event_id") % 40).alias("hi"))


#: Names of the same tables in DuckDB, put before each query that asks for them.
SQL: dict[str, str] = {
    "disk": "SELECT s_suppkey AS id, s_nationkey + 1 AS node_id, CASE WHEN s_acctbal < 0 THEN 'failed' WHEN s_suppkey % 10 = 3 THEN 'draining' ELSE 'active' END AS state FROM supplier",
    "node": "SELECT n_nationkey + 1 AS id, CASE WHEN n_regionkey = 0 THEN 'failed' ELSE 'working' END AS state FROM nation",
    "placed": "SELECT vlog_id, shard_idx, vlog_id * 1000 + shard_idx AS plog_id, disk_id, length FROM (SELECT l_orderkey AS vlog_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS shard_idx, l_suppkey AS disk_id, CAST(l_quantity AS BIGINT) * 1000 AS length FROM lineitem)",
    "vlog": "SELECT id, length, CASE id % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'DUPLICATE' ELSE 'EC' END AS protection_scheme, CASE WHEN id % 3 = 2 THEN greatest(n - 1, 1) ELSE 1 END AS data_shards, CASE WHEN id % 3 = 2 THEN least(n - 1, 1) ELSE 0 END AS parity_shards, CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END AS target_data_shards, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS target_parity_shards FROM (SELECT l_orderkey AS id, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS length FROM lineitem GROUP BY 1)",
    "states": "SELECT d.id AS disk_id, d.node_id, d.state AS disk_state, coalesce(n.state, 'working') AS node_state, d.state = 'active' AND coalesce(n.state, 'working') <> 'failed' AS up, d.state <> 'failed' AND coalesce(n.state, 'working') <> 'failed' AS reachable FROM disk d LEFT JOIN node n ON d.node_id = n.id",
    "part_logs": "SELECT p_partkey AS id, CAST(coalesce(n, 0) + p_size AS BIGINT) AS length FROM part LEFT JOIN (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT) + 64) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey",
    "usage": "SELECT id AS vlog_id, length AS total_bytes, CAST(coalesce(live, 0) AS BIGINT) AS live_bytes, greatest(length - CAST(coalesce(live, 0) AS BIGINT), 0) AS dead_bytes FROM part_logs LEFT JOIN (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) + 64 END) AS live FROM lineitem GROUP BY 1) ON l_partkey = id",
    "doc_rows": "SELECT doc_id, source AS bucket, left(sha256(text), 30) AS hash, n_chars AS len FROM documents",
    "doc_chunks": "SELECT hash, CASE WHEN first % 7 = 0 THEN 0 ELSE n END AS refcount, first % 16 AS vlog_id, first * 1000000 AS vaddr_offset, len AS compressed_len FROM (SELECT hash, count(*) AS n, min(doc_id) AS first, max(len) AS len FROM doc_rows GROUP BY 1)",
    "extents": "SELECT source, doc_id, bytes, CAST(sum(bytes) OVER w - bytes AS BIGINT) AS start, CAST(sum(bytes) OVER w AS BIGINT) AS \"end\" FROM (SELECT source, doc_id, n_chars + 64 AS bytes FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)",
    "conv_chunks": "SELECT v.conv_id * 1000 + v.turn AS file_id, 'conv/' || CAST(v.conv_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY v.conv_id, v.turn ORDER BY c.turn) - 1 AS pos, left(sha256(c.text), 30) AS hash, length(c.text) AS len FROM conversations v JOIN conversations c ON v.conv_id = c.conv_id AND c.turn <= v.turn",
    "conv_heads": "SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS path, max(conv_id * 1000 + turn) AS file_id FROM conversations GROUP BY conv_id",
    "tree_chunks": "SELECT file_id, 'c' || CAST(file_id // 1000 % 7 AS VARCHAR) || '/d' || CAST(file_id // 1000 % 3 AS VARCHAR) || '/' || CAST(file_id // 1000 AS VARCHAR) AS path, pos, hash, len FROM conv_chunks",
    "tree_heads": "SELECT path, max(file_id) AS file_id FROM tree_chunks GROUP BY path",
    "tree_refs": "SELECT hash, count(*) AS refcount FROM tree_chunks JOIN tree_heads USING (path, file_id) GROUP BY hash",
    "page_paths": "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\\?.*$', '') AS path, length(html) AS size FROM pages",
    "page_heads": "SELECT path, max(page_id) AS file_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_replace(path, '^.*/', '') AS name, arg_max(size, page_id) AS size FROM page_paths GROUP BY path",
    "write_ops": "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) || ':' || o_orderpriority AS idempotency_key, 'cust/' || CAST(o_custkey AS VARCHAR) AS path, CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'O' THEN 'prepared' ELSE 'abandoned' END AS state, CASE WHEN o_orderkey % 2 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT) * 1000000000 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS created_at FROM orders",
    "spans": "SELECT user_id, event_id AS seq, CAST(floor(abs(value) * 7) AS BIGINT) % 500 AS lo, CAST(floor(abs(value) * 7) AS BIGINT) % 500 + 1 + event_id % 40 AS hi FROM events",
}
#: What each of them needs.
_NEEDS = {"states": ["disk", "node"], "usage": ["part_logs"], "doc_chunks": ["doc_rows"], "page_heads": ["page_paths"], "tree_chunks": ["conv_chunks"], "tree_heads": ["tree_chunks"], "tree_refs": ["tree_heads"]}


def with_tables(names: str, body: str) -> str:
    """``body`` behind the named tables, those first that others need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " if order else "") + body
