"""Hashes, packed chunk lists and identifiers, without UDFs. Binary values are shown as lower-case hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
RECORD = 19


def chunk_hash(data: Column) -> Column:
    """First 15 bytes of SHA-256."""
    return F.left(F.sha2(data, 256), F.lit(30))


def sector_hash(data: Column) -> Column:
    """First 16 bytes of SHA-256."""
    return F.left(F.sha2(data, 256), F.lit(32))


def random_uid() -> Column:
    """120 random bits, another for each row and each time."""
    return F.left(F.replace(F.concat(F.uuid(), F.uuid()), F.lit("-"), F.lit("")), F.lit(30))


def _reversed_bytes(hex_text: Column, n: int) -> Column:
    return F.concat(*(F.substring(hex_text, 2 * i + 1, 2) for i in reversed(range(n))))


def hash64(data: Column) -> Column:
    """First 8 bytes of SHA-256 as a little-endian unsigned number, in decimal digits."""
    return F.conv(_reversed_bytes(F.sha2(data, 256), 8), 16, 10)


def pack(chunks: Column) -> Column:
    """An ordered list of ``(hash, len)`` as hex of 19-byte records: 15 bytes of hash, then a little-endian length."""

    def record(c: Column) -> Column:
        return F.concat(c["hash"], _reversed_bytes(F.lpad(F.lower(F.hex(c["len"].cast("long"))), 8, "0"), 4))

    return F.array_join(F.transform(chunks, record), "")


def unpack(packed: Column) -> Column:
    """The list of ``(hash, len)`` of ``pack``."""
    n = F.call_function("div", F.length(packed), F.lit(2 * RECORD)).cast("int")

    def at(i: Column) -> Column:
        part = F.substr(packed, i * (2 * RECORD) + 1, F.lit(2 * RECORD))
        return F.struct(F.substring(part, 1, 30).alias("hash"), F.conv(_reversed_bytes(F.substring(part, 31, 8), 4), 16, 10).cast("int").alias("len"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<struct<hash:string,len:int>>"))


def list_size(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda a, c: a + c["len"])


def uid_text(uid_hex: Column) -> Column:
    """120 bits as 24 characters of Crockford's base 32."""
    groups = []
    for g in range(3):
        n = F.conv(F.substring(uid_hex, 10 * g + 1, 10), 16, 10).cast("long")
        groups += [F.substr(F.lit(ALPHABET), F.shiftright(n, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*groups)


def parse_uid(text: Column) -> Column:
    """Hex of a UID text: hyphens and case are ignored, I and L read 1, O reads 0; null for anything else."""
    t = F.translate(F.upper(F.regexp_replace(text, "-", "")), "OIL", "011")
    groups = []
    for g in range(3):
        n = F.lit(0).cast("long")
        for i in range(8):
            n = n * 32 + (F.call_function("instr", F.lit(ALPHABET), F.substring(t, 8 * g + i + 1, 1)) - 1).cast("long")
        groups.append(F.lpad(F.lower(F.hex(n)), 10, "0"))
    return F.when(t.rlike(f"^[{ALPHABET}]{{24}}$"), F.concat(*groups))


def key_groups(text: Column) -> Column:
    """24 characters in four groups of six."""
    return F.concat_ws("-", *(F.substring(text, 6 * i + 1, 6) for i in range(4)))
