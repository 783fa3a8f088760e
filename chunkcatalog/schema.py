"""The catalog's tables as explicit Spark schemas. Every column is NOT NULL; 0 and '' stand for "none"."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_KINDS = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "binary": T.BinaryType()}
_KINDS["chunks"] = T.ArrayType(T.StructType([T.StructField("hash", T.StringType()), T.StructField("len", T.IntegerType())]))


def _table(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind], False) for name, kind in (c.split() for c in columns.split(", "))])


TABLES: dict[str, T.StructType] = {
    "cluster": _table("id int, uid string, encryption_key string, encryption_alg string, format_version int, feature_flags bigint, created_at bigint"),
    "file": _table("id bigint, path string, mtime bigint, chunks chunks"),
    "file_head": _table("path string, file_id bigint, parent string, name string, mtime bigint"),
    "dir": _table("path string, parent string, name string, mtime bigint"),
    "snapshot": _table("id bigint, name string, created_at bigint"),
    "snapshot_file": _table("snapshot_id bigint, path string, file_id bigint"),
    "chunk": _table("hash string, refcount bigint, vlog_id bigint, vaddr_offset bigint, logical_len bigint, compressed_len bigint"),
    "write_op": _table("id bigint, idempotency_key string, path string, state string, created_at bigint, file_id bigint, acknowledged_offset bigint, tail binary"),
    "vlog_lease": _table("vlog_id bigint, write_op_id bigint, ordinal int"),
    "vlog": _table("id bigint, uid string, length bigint, protection_scheme string, data_shards int, parity_shards int, target_data_shards int, target_parity_shards int"),
    "bucket": _table("name string, protection_scheme string, data_shards int, parity_shards int"),
    "vlog_plog": _table("vlog_id bigint, shard_idx int, plog_id bigint"),
    "plog": _table("id bigint, uid string, disk_id bigint, length bigint"),
    "node": _table("id bigint, mac string, hostname string, state string"),
    "disk": _table("id bigint, uid string, node_id bigint, total_bytes bigint, used_bytes bigint, state string"),
    "job": _table("id bigint, kind string, state string, target_vlog bigint, dest_vlog bigint, target_disk bigint, dest_disk bigint, created_at bigint"),
}

# States and schemes by convention.
DISK_STATES = ("active", "draining", "failed", "detached")
NODE_STATES = ("working", "failed")
WRITE_OP_STATES = ("prepared", "committed", "abandoned")
JOB_STATES = ("running", "done", "cancelled")
SCHEMES = ("NONE", "DUPLICATE", "EC")

HEADER_BYTES = 64
SECTOR_BYTES = 4096
SECTORS_PER_BLOCK = 255
MAX_LOG_BYTES = 4 << 30


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def empty_catalog(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: empty(spark, name) for name in TABLES}


def evolve(df: DataFrame, name: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` in the schema of table ``name``: missing columns get a default (0 or ''), others are cast, extra ones dropped."""
    from pyspark.sql import functions as F

    zero = {"string": "", "binary": b"", "boolean": False}
    columns = []
    for f in TABLES[name]:
        kind = f.dataType.simpleString()
        value = (defaults or {}).get(f.name, [] if kind.startswith("array") else zero.get(kind, 0))
        fallback = F.array().cast(f.dataType) if value == [] else F.lit(value).cast(f.dataType)
        columns.append((F.coalesce(F.col(f.name).cast(f.dataType), fallback) if f.name in df.columns else fallback).alias(f.name))
    return df.select(*columns)
