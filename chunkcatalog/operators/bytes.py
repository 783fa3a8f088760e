"""Byte kernels over DataFrames, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkcatalog.functions import kernels as k

#: Bytes that a kernel takes at once.
PIECE = 1 << 21


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold ``PIECE`` bytes at most, a longer row by itself."""
    for batch in batches:
        held = np.full(batch.num_rows, 64, np.int64)
        for c in batch.columns:
            if pa.types.is_binary(c.type) or pa.types.is_string(c.type):
                held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(held), 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield batch.slice(at, to - at)
            at = to
        batch = c = None  # so that it can go before the next one comes


def in_pieces(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` of each piece. Spark's batches have up to 10,000 rows or 64 MB; Python objects and results are only made of one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            part = f(part)
            yield part

    return run


def chunk_files(files: DataFrame, least: int = k.MIN_CHUNK, normal: int = k.NORMAL_CHUNK, most: int = k.MAX_CHUNK, payload: bool = False) -> DataFrame:
    """``(path, pos, offset, len, hash)`` of the content-defined chunks of ``files(path, data)``, with ``data`` if asked."""
    fields = [("path", pa.string()), ("pos", pa.int32()), ("offset", pa.int64()), ("len", pa.int32()), ("hash", pa.string())] + ([("data", pa.binary())] if payload else [])
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py() or b""
                rows, at = [], 0
                for pos, end in enumerate(k.cut_points(data, least, normal, most)):
                    part = data[at:end]
                    rows.append((path.as_py(), pos, at, end - at, hashlib.sha256(part).hexdigest()[:30], part)[: len(fields)])
                    at = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    return files.select("path", F.col("data").cast("binary")).mapInArrow(run, "path string, pos int, offset bigint, len int, hash string" + (", data binary" if payload else ""))


def encode_rows(rows: DataFrame, data: int, parity: int) -> DataFrame:
    """``(vlog_id, row, shard_idx, size, shard)``: the shards of each row of ``rows(vlog_id, row, data)``."""
    schema = pa.schema([("vlog_id", pa.int64()), ("row", pa.int64()), ("shard_idx", pa.int32()), ("size", pa.int64()), ("shard", pa.binary())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for v, r, d in zip(*(c.to_pylist() for c in part.columns), strict=True):
            out += [(v, r, i, len(d), s) for i, s in enumerate(k.rs_encode(d, data, parity))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.select(F.col("vlog_id").cast("long"), F.col("row").cast("long"), F.col("data").cast("binary")).mapInArrow(in_pieces(run), "vlog_id bigint, row bigint, shard_idx int, size bigint, shard binary")


def decode_rows(shards: DataFrame, data: int, parity: int) -> DataFrame:
    """``(vlog_id, row, data, lost)`` from the shards that are there; ``data`` is null where too few are.

    Rows with all data shards are put together without decoding; a row's shards are the only thing that meets in a task.
    """
    schema = pa.schema([("vlog_id", pa.int64()), ("row", pa.int64()), ("data", pa.binary()), ("lost", pa.int32())])

    def run(group: pa.Table) -> pa.Table:
        have = dict(zip(group["shard_idx"].to_pylist(), group["shard"].to_pylist(), strict=True))
        size = group["size"][0].as_py()
        if all(i in have for i in range(data)):
            whole = b"".join(have[i] for i in range(data))
        else:
            whole = b"".join(k.rs_reconstruct(have, data, parity)[:data]) if len(have) >= data else None
        row = (group["vlog_id"][0].as_py(), group["row"][0].as_py(), whole[:size] if whole is not None else None, data + parity - len(have))
        return pa.table([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    return shards.groupBy("vlog_id", "row").applyInArrow(run, "vlog_id bigint, row bigint, data binary, lost int")


def scrub(logs: DataFrame, key: bytes) -> DataFrame:
    """``(plog_id, sectors, corrupt, bad_blocks, length)`` of log files ``logs(plog_id, content)``; a broken superblock counts as one bad block."""
    schema = pa.schema([("plog_id", pa.int64()), ("sectors", pa.int64()), ("corrupt", pa.int64()), ("bad_blocks", pa.int64()), ("length", pa.int64())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for plog, raw in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            try:
                payload, bad, blocks = k.decode_log(raw.as_py(), key)
                out.append((plog, -(-len(payload) // k.SECTOR), len(bad), blocks, len(payload)))
            except (ValueError, k.struct.error):
                out.append((plog, 0, 0, 1, 0))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return logs.select(F.col("plog_id").cast("long"), F.col("content").cast("binary")).mapInArrow(in_pieces(run), "plog_id bigint, sectors bigint, corrupt bigint, bad_blocks bigint, length bigint")


def encode_logs(payloads: DataFrame, key: bytes) -> DataFrame:
    """``(plog_id, content)``: log files of ``payloads(plog_id, data)``."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([k.encode_log(x.as_py() or b"", key) for x in part.column(1)], pa.binary())], ["plog_id", "content"])

    return payloads.select(F.col("plog_id").cast("long"), F.col("data").cast("binary")).mapInArrow(in_pieces(run), "plog_id bigint, content binary")


def crypt(records: DataFrame, key: bytes, label: bytes) -> DataFrame:
    """``(id, data)`` under the stream of each record's ``hash64`` (a decimal string) from its ``offset`` on; twice gives the original."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = [k.ctr_xor(key, k.chunk_stream(key, label, int(h)), o, d or b"") for h, o, d in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["id", "data"])

    return records.select(F.col("id").cast("long"), "hash64", F.col("offset").cast("long"), F.col("data").cast("binary")).mapInArrow(in_pieces(run), "id bigint, data binary")


def headers(records: DataFrame) -> DataFrame:
    """``(id, header)`` of ``records(id, flags, hash64, length, path)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            out = [k.encode_header(f, i, int(h), n, hint=k.path_hint(p, bool(f & k.INITIAL))) for i, f, h, n, p in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "header"])

    return records.select(F.col("id").cast("long"), F.col("flags").cast("int"), "hash64", F.col("length").cast("long"), "path").mapInArrow(run, "id bigint, header binary")


def parse_headers(raw: DataFrame) -> DataFrame:
    """``(id, file_id, length, error)`` of ``raw(id, header)``; numbers are null where ``error`` is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [k.decode_header(x.as_py() or b"") for x in batch.column(1)]
            get = lambda name, out=out: pa.array([h[name] if h else None for h, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), get("file_id"), get("length"), pa.array([e for _, e in out], pa.string())], ["id", "file_id", "length", "error"])

    return raw.select(F.col("id").cast("long"), F.col("header").cast("binary")).mapInArrow(run, "id bigint, file_id bigint, length bigint, error string")
