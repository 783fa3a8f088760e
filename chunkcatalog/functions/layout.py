"""Addresses in logs: a block is 255 data sectors of 4 KiB and a hash sector; sector 0 of a file is its superblock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTOR = 4096
DATA = 255 * SECTOR
BLOCK = 256 * SECTOR


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("long") if isinstance(b, Column) else F.call_function("div", a, F.lit(b))


def physical(logical: Column) -> Column:
    return F.lit(SECTOR) + _div(logical, DATA) * BLOCK + logical % DATA


def logical(physical_offset: Column) -> Column:
    """Inverse of ``physical``; places in a hash sector map to the end of the data before it."""
    p = F.greatest(physical_offset - SECTOR, F.lit(0))
    return _div(p, BLOCK) * DATA + F.least(p % BLOCK, F.lit(DATA))


def hash_sector(block: Column) -> Column:
    return F.lit(SECTOR) + block * BLOCK + DATA


def sector(logical_offset: Column) -> Column:
    return _div(logical_offset, SECTOR)


def sector_block(sector_no: Column) -> Column:
    return _div(sector_no, 255)


def sector_place(sector_no: Column) -> Column:
    return sector_no % 255


def stripe_width(data_shards: Column) -> Column:
    return data_shards * DATA


def row(offset: Column, data_shards: Column) -> Column:
    return F.floor(offset / stripe_width(data_shards)).cast("long")


def column(offset: Column, data_shards: Column) -> Column:
    return _div(offset % stripe_width(data_shards), DATA)


def place(offset: Column) -> Column:
    return offset % DATA


def padded(total: Column, width: Column | int) -> Column:
    """``total`` rounded up to whole rows of ``width``, in integers."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.call_function("div", total + w - 1, w) * w
