"""Bytes of logs: records laid out in shards, read back, checked and rebuilt, as DataFrames.

A shard table is ``(plog_id, vlog_id, shard_idx, row, size, shard, digest)``. A log of copies has one row for each record, at its offset, on
every shard. A coded log is cut into rows of ``width`` bytes, each coded into data and parity shards. Records stand at their offset behind a header of
64 bytes, which is left zero here. Records, rows and pieces meet by equi-joins on log and row, so nothing larger than a row comes together in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkcatalog.operators import bytes as byte_ops
from chunkcatalog.plans.store import settle
from chunkcatalog.schema import HEADER_BYTES

COLUMNS = ["plog_id", "vlog_id", "shard_idx", "row", "size", "shard", "digest"]
EMPTY = "plog_id bigint, vlog_id bigint, shard_idx int, row bigint, size bigint, shard binary, digest string"


def _digested(x: DataFrame) -> DataFrame:
    return x.withColumn("digest", F.sha2("shard", 256)).select(*COLUMNS)


def _rows(offset: Column, length: Column, width: int) -> Column:
    """Rows that the payload of a record at ``offset`` meets."""
    first = F.call_function("div", offset + HEADER_BYTES, F.lit(width))
    return F.sequence(first, F.greatest(F.call_function("div", offset + HEADER_BYTES + length - 1, F.lit(width)), first))


def _part(offset: Column, length: Column, width: int) -> tuple[Column, Column, Column]:
    """Of a record's payload in row ``row``: its place in the row, its place in the payload, and its length."""
    begin = offset + HEADER_BYTES
    lo, hi = F.greatest(begin, F.col("row") * width), F.least(begin + length, (F.col("row") + 1) * width)
    return lo - F.col("row") * width, lo - begin, F.greatest(hi - lo, F.lit(0))


def mirrored(records: DataFrame, placed: DataFrame) -> DataFrame:
    """Shards of ``records(vlog_id, vaddr_offset, data)`` on every shard of their logs, ``placed(vlog_id, shard_idx, plog_id)``."""
    x = records.select("vlog_id", F.col("vaddr_offset").alias("row"), F.octet_length("data").cast("long").alias("size"), F.col("data").alias("shard"))
    return _digested(x.join(placed.select("vlog_id", "shard_idx", "plog_id"), "vlog_id"))


def coded(records: DataFrame, placed: DataFrame, data: int, parity: int, width: int) -> DataFrame:
    """Shards of whole rows that hold ``records(vlog_id, vaddr_offset, data)``; what no record covers is zero."""
    length = F.octet_length("data").cast("long")
    x = records.withColumn("row", F.explode(_rows(F.col("vaddr_offset"), length, width)))
    at, inside, n = _part(F.col("vaddr_offset"), length, width)
    x = x.select("vlog_id", "row", F.struct(at.cast("int").alias("at"), F.substring(F.col("data"), (inside + 1).cast("int"), n.cast("int")).alias("piece")).alias("p"))
    zeros = lambda k: F.unhex(F.repeat(F.lit("00"), k))
    grown = lambda whole, p: F.concat(whole, zeros(p["at"] - F.octet_length(whole)), p["piece"])
    rows = x.groupBy("vlog_id", "row").agg(F.sort_array(F.collect_list("p")).alias("parts")).select("vlog_id", "row", F.aggregate("parts", F.lit(b""), grown).alias("data"))
    full = rows.select("vlog_id", "row", F.concat("data", zeros(F.lit(width) - F.octet_length("data"))).alias("data"))
    return _digested(byte_ops.encode_rows(full, data, parity).join(placed.select("vlog_id", "shard_idx", "plog_id"), ["vlog_id", "shard_idx"]))


def healthy(shards: DataFrame) -> DataFrame:
    """Shards whose bytes are what was written."""
    return shards.where(F.sha2("shard", 256) == F.col("digest"))


def scrub(shards: DataFrame) -> DataFrame:
    """``(plog_id, rows, corrupt)`` of each shard."""
    return shards.groupBy("plog_id").agg(F.count("*").alias("rows"), F.count_if(F.sha2("shard", 256) != F.col("digest")).alias("corrupt"))


def read_mirrored(wanted: DataFrame, good: DataFrame) -> DataFrame:
    """``wanted(vlog_id, vaddr_offset, ...)`` with ``data`` from the first good copy; null where there is none."""
    first = good.groupBy("vlog_id", "row").agg(F.min_by("shard", "shard_idx").alias("data"))
    return wanted.join(first.withColumnRenamed("row", "vaddr_offset"), ["vlog_id", "vaddr_offset"], "left")


def read_coded(wanted: DataFrame, good: DataFrame, data: int, parity: int, width: int, key: str = "hash") -> DataFrame:
    """``wanted(key, vlog_id, vaddr_offset, len, ...)`` with ``data`` put together from the rows it meets, decoded where shards are missing; null where too few are left."""
    x = wanted.select(key, "vlog_id", "vaddr_offset", "len", F.explode(_rows(F.col("vaddr_offset"), F.col("len"), width)).alias("row"))
    rows = byte_ops.decode_rows(good.join(x.select("vlog_id", "row").distinct(), ["vlog_id", "row"], "left_semi"), data, parity)
    at, _, n = _part(F.col("vaddr_offset"), F.col("len"), width)
    pieces = x.join(rows.select("vlog_id", "row", "data"), ["vlog_id", "row"], "left").select(key, "row", F.substring(F.col("data"), (at + 1).cast("int"), n.cast("int")).alias("piece"))
    whole = pieces.groupBy(key).agg(F.count_if(F.col("piece").isNull()).alias("lost"), F.sort_array(F.collect_list(F.struct("row", "piece"))).alias("parts"))
    whole = whole.select(key, F.when(F.col("lost") == 0, F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["piece"]))).alias("data"))
    return wanted.join(whole, key, "left")


def rebuilt(lost: DataFrame, good: DataFrame, data: int, parity: int) -> DataFrame:
    """Shards ``lost(plog_id, vlog_id, shard_idx)`` of coded logs, made again from the good ones of their rows; a row with too few is left out."""
    others = good.join(lost.select("plog_id"), "plog_id", "left_anti").join(lost.select("vlog_id").distinct(), "vlog_id", "left_semi")
    rows = byte_ops.decode_rows(others, data, parity).where("data IS NOT NULL").select("vlog_id", "row", "data")
    return _digested(byte_ops.encode_rows(settle(rows), data, parity).join(lost.select("vlog_id", "shard_idx", "plog_id"), ["vlog_id", "shard_idx"]))


def copied(lost: DataFrame, good: DataFrame) -> DataFrame:
    """Shards ``lost(plog_id, vlog_id, shard_idx)`` of logs of copies, from the first good copy of each record."""
    others = good.join(lost.select("plog_id"), "plog_id", "left_anti").join(lost.select("vlog_id").distinct(), "vlog_id", "left_semi")
    first = others.groupBy("vlog_id", "row").agg(F.min_by(F.struct("size", "shard"), "shard_idx").alias("b")).select("vlog_id", "row", "b.*")
    return _digested(first.join(lost.select("vlog_id", "shard_idx", "plog_id"), "vlog_id"))
