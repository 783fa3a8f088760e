"""Predicates, thresholds and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_COPIES = 2


def live(refcount: Column) -> Column:
    return refcount > 0


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Half-open intervals share a point."""
    return (a_hi > b_lo) & (a_lo < b_hi)


def payload_overlaps(offset: Column, length: Column, lo: Column, hi: Column, header: int = 64) -> Column:
    """The payload of a record at ``offset``, behind its header, meets [lo, hi)."""
    return overlaps(offset + header, offset + header + length, lo, hi)


def disk_live(disk_state: Column, node_state: Column) -> Column:
    return (disk_state == "active") & (F.coalesce(node_state, F.lit("working")) != "failed")


def disk_reachable(disk_state: Column, node_state: Column) -> Column:
    """Draining and detached disks can still be read."""
    return (disk_state != "failed") & (F.coalesce(node_state, F.lit("working")) != "failed")


def node_of_disk(node_id: Column, disk_id: Column) -> Column:
    return F.coalesce(F.nullif(node_id, F.lit(0)), disk_id)


def staging(target_data: Column, target_parity: Column) -> Column:
    return (target_parity > 0) | (target_data > 0)


def matches_policy(v: str, p: str) -> Column:
    """May the log aliased ``v`` take writes under the policy aliased ``p``? Coded policies write to staging logs of the same target."""
    c = F.col
    coded = (c(f"{v}.target_data_shards") == c(f"{p}.data_shards")) & (c(f"{v}.target_parity_shards") == c(f"{p}.parity_shards")) & staging(c(f"{v}.target_data_shards"), c(f"{v}.target_parity_shards"))
    plain = (c(f"{v}.protection_scheme") == c(f"{p}.protection_scheme")) & (c(f"{v}.data_shards") == c(f"{p}.data_shards")) & ~staging(c(f"{v}.target_data_shards"), c(f"{v}.target_parity_shards"))
    return F.when(c(f"{p}.protection_scheme") == "EC", coded).otherwise(plain)


def commit_threshold(scheme: Column, data: Column, parity: Column, total: Column, min_copies: int = MIN_COPIES) -> Column:
    return F.when(scheme == "EC", data + parity).when(scheme == "DUPLICATE", F.least(F.lit(min_copies), total)).otherwise(F.lit(1))


def read_threshold(scheme: Column, data: Column) -> Column:
    return F.when(scheme == "EC", data).otherwise(F.lit(1))


def created_ns(created_at: Column) -> Column:
    """Times above 5e10 are nanoseconds already, others seconds."""
    return F.when(created_at > 50_000_000_000, created_at).otherwise(created_at * 1_000_000_000)


def ns_to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def job_status(state: Column) -> Column:
    """As seen by callers: cancelled work shows as completed."""
    return F.when(state.isin("done", "cancelled"), "COMPLETED").when(state == "running", "RUNNING").otherwise("UNKNOWN")


def protection(spec: Column) -> Column:
    """``"N"`` (copies) or ``"N+K"`` (data + parity) as ``(scheme, data_shards, parity_shards)``; null if malformed."""
    coded = F.regexp_extract(spec, r"^\s*([0-9]+)\s*\+\s*([0-9]+)\s*$", 1), F.regexp_extract(spec, r"^\s*([0-9]+)\s*\+\s*([0-9]+)\s*$", 2)
    ok = (coded[0] != "") & (F.coalesce(coded[0].try_cast("int"), F.lit(0)) > 0) & (F.coalesce(coded[1].try_cast("int"), F.lit(0)) > 0)
    copies = F.coalesce(F.trim(spec).try_cast("int"), F.lit(0))
    make = lambda s, d, p: F.struct(F.lit(s).alias("scheme"), d.alias("data_shards"), p.alias("parity_shards"))
    return F.when(ok, make("EC", coded[0].try_cast("int"), coded[1].try_cast("int"))).when(copies > 0, make("DUPLICATE", copies, F.lit(0)))


def dead_bytes(total: Column, live_bytes: Column) -> Column:
    return F.greatest(total - live_bytes, F.lit(0).cast("long"))


def waste_ratio(total: Column, live_bytes: Column) -> Column:
    return F.coalesce(F.try_divide(dead_bytes(total, live_bytes), F.greatest(total, F.lit(0).cast("long"))), F.lit(0.0))


def plog_name(plog_id: Column) -> Column:
    return F.format_string("plog-%05d", plog_id.cast("long"))


def plog_id_of(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name, r"(?:^|/)plog-([0-9]{5,})$", 1), F.lit("")).cast("long")
