"""Computations over an order: prefix sums, islands, interval overlay and range joins.

Windows are partitioned by the file, log or key at hand. ``range_join`` cuts intervals into buckets, so it is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.functions import layout
from chunkcatalog.plans.store import settle

_BEFORE = (W.unboundedPreceding, -1)
_UP_TO = (W.unboundedPreceding, 0)


def extents(rows: DataFrame, by: list[str], order: list[str], length: str | Column, start: str = "start", end: str = "end", spread: bool = False) -> DataFrame:
    """Adds the running ``start`` and ``end`` of each row within its group.

    With ``spread`` a group may be far larger than a task: rows are dealt by ranges of group and order and settled, sums run inside each range,
    and each range starts where those before it in the group end.
    """
    n = F.col(length) if isinstance(length, str) else length
    if not spread:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(*_UP_TO)
        return rows.withColumn(end, F.sum(n).over(w)).withColumn(start, F.col(end) - n)
    x = settle(rows.withColumn("__n", n).repartitionByRange(*by, *order).withColumn("__r", F.spark_partition_id()))
    sums = x.groupBy(*by, "__r").agg(F.sum("__n").alias("__s"))
    before = sums.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__r").alias("__q"), (F.sum("__s").over(W.partitionBy(*by).orderBy("__r").rowsBetween(*_UP_TO)) - F.col("__s")).alias("__before"))
    inside = x.withColumn("__in", F.sum("__n").over(W.partitionBy(*by, "__r").orderBy(*order).rowsBetween(*_UP_TO)))
    same = [F.col("__r") == F.col("__q"), *(F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by))]
    out = inside.join(before, same).withColumn(end, F.col("__before") + F.col("__in")).withColumn(start, F.col(end) - F.col("__n"))
    return out.select(*rows.columns, end, start)


def append_offsets(rows: DataFrame, by: list[str], order: list[str], length: str, used: Column, limit: int, spread: bool = False) -> DataFrame:
    """Places appended records behind ``used`` bytes of their group, in logs of ``limit`` bytes: ``log_no`` and ``offset``.

    A record goes to the log in which its running start lies; records are far smaller than logs.
    """
    x = extents(rows, by, order, length, "__start", "__end", spread)
    at = F.col("__start") + used
    return x.withColumn("log_no", F.floor(at / F.lit(limit))).withColumn("offset", at % limit).drop("__start", "__end")


def promotable_prefix(rows: DataFrame, by: list[str], order: list[str], length: str, width: int, header: int = 64) -> DataFrame:
    """The prefix of each group to promote to whole rows of ``width``: least padding, ties to the longest; none if all is below a row.

    Gives ``(by, count, padded, pad)``.
    """
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(*_UP_TO)
    x = rows.withColumn("count", F.row_number().over(W.partitionBy(*by).orderBy(*order))).withColumn("total", F.sum(F.col(length) + header).over(w)).where(F.col("total") >= width)
    x = x.withColumn("padded", layout.padded(F.col("total"), width)).withColumn("pad", F.col("padded") - F.col("total"))
    best = x.groupBy(*by).agg(F.min(F.struct("pad", (-F.col("count")).alias("c"), "padded")).alias("b"))
    return best.select(*by, (-F.col("b.c")).alias("count"), F.col("b.padded").alias("padded"), F.col("b.pad").alias("pad"))


def hash_chain(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``prev`` (the value before, '0' first), ``is_initial`` and ``is_last`` along each group."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("prev", F.coalesce(F.lag(value).over(w), F.lit("0"))).withColumn("is_initial", F.row_number().over(w) == 1).withColumn("is_last", F.lead(value).over(w).isNull())


def islands(rows: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", adjacent: bool = True) -> DataFrame:
    """Merges intervals of a group that overlap (or touch): ``(by, lo, hi, pieces)``."""
    w = W.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(*_BEFORE))
    fresh = reach.isNull() | ((F.col(lo) > reach) if adjacent else (F.col(lo) >= reach))
    x = rows.withColumn("__new", F.when(fresh, 1).otherwise(0)).withColumn("__island", F.sum("__new").over(w.rowsBetween(*_UP_TO)))
    return x.groupBy(*by, "__island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("pieces")).drop("__island")


def runs(rows: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Records of a group that follow each other without a gap: ``(by, start, end, records)``."""
    w = W.partitionBy(*by).orderBy(start, end)
    x = rows.withColumn("__new", F.when(F.coalesce(F.lag(end).over(w) != F.col(start), F.lit(True)), 1).otherwise(0)).withColumn("__run", F.sum("__new").over(w.rowsBetween(*_UP_TO)))
    return x.groupBy(*by, "__run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("records")).drop("__run")


def overlay(writes: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", seq: str = "seq") -> DataFrame:
    """Last writer wins: disjoint intervals ``(by, lo, hi, seq)`` with the latest write of each place; neighbours of one write are joined.

    Intervals are cut at all bounds of the group; the pieces of a write are found by a range join.
    """
    points = writes.select(*by, F.explode(F.array(lo, hi)).alias("at")).distinct()
    w = W.partitionBy(*by).orderBy("at")
    cuts = points.withColumn("to", F.lead("at").over(w)).where("to IS NOT NULL")
    pieces = range_join(cuts.withColumnsRenamed({"at": "lo", "to": "hi"}), writes.select(*by, F.col(lo).alias("w_lo"), F.col(hi).alias("w_hi"), F.col(seq).alias("seq")), by, "lo", "hi", "w_lo", "w_hi")
    top = pieces.groupBy(*by, "lo", "hi").agg(F.max("seq").alias("seq"))
    v = W.partitionBy(*by).orderBy("lo")
    same = (F.lag("hi").over(v) == F.col("lo")) & (F.lag("seq").over(v) == F.col("seq"))
    x = top.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(v.rowsBetween(*_UP_TO)))
    return x.groupBy(*by, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("seq").alias("seq")).drop("__run")


def range_join(left: DataFrame, right: DataFrame, by: list[str], l_lo: str, l_hi: str, r_lo: str, r_hi: str, bucket: int = 4096, how: str = "inner") -> DataFrame:
    """Pairs of half-open intervals that meet, as an equi-join on ``by`` and bucket; a pair shows only in the bucket where it begins.

    ``how='left_anti'`` gives the rows of ``left`` without a partner; intervals of no length meet nothing. Column names of both sides must differ, but for ``by``.
    """

    def cut(df: DataFrame, lo: str, hi: str) -> DataFrame:
        first = F.call_function("div", F.col(lo), F.lit(bucket))
        last = F.call_function("div", F.col(hi) - 1, F.lit(bucket))
        return df.where(F.col(lo) < F.col(hi)).withColumn("__b", F.explode(F.sequence(first, last)))

    keys = [*by, "__b"]
    meets = (F.col(l_hi) > F.col(r_lo)) & (F.col(l_lo) < F.col(r_hi))
    if how == "left_anti":
        cutup, other = cut(left, l_lo, l_hi), cut(right, r_lo, r_hi).select(*keys, r_lo, r_hi)
        hit = cutup.join(other, keys).where(meets).select(*left.columns).distinct()
        return left.join(hit, [left[c].eqNullSafe(hit[c]) for c in left.columns], "left_anti")
    pairs = cut(left, l_lo, l_hi).join(cut(right, r_lo, r_hi), keys)
    begins = F.call_function("div", F.greatest(l_lo, r_lo), F.lit(bucket)) == F.col("__b")
    return pairs.where(meets & begins).drop("__b")


def read_plan(extent_rows: DataFrame, reads: DataFrame, by: list[str]) -> DataFrame:
    """For ``reads(by, read_id, r_lo, r_hi)``: the part of each chunk extent to read: ``chunk_lo``, ``chunk_hi`` inside the chunk, ``out_at`` in the result."""
    x = range_join(extent_rows, reads, by, "start", "end", "r_lo", "r_hi")
    lo, hi = F.greatest("start", "r_lo"), F.least("end", "r_hi")
    return x.withColumn("chunk_lo", lo - F.col("start")).withColumn("chunk_hi", hi - F.col("start")).withColumn("out_at", lo - F.col("r_lo"))


def splice(base: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """``base(by, start, end, ...)`` marked ``clean`` where no span ``(by, s_lo, s_hi)`` meets the chunk: those are kept, the others cut anew."""
    columns = [*by, "start", "end"]
    dirty = range_join(base.select(*columns), spans, by, "start", "end", "s_lo", "s_hi").select(*columns).distinct().withColumn("__dirty", F.lit(True))
    return base.join(dirty, columns, "left").withColumn("clean", F.col("__dirty").isNull()).drop("__dirty")


def truncate(spans: DataFrame, size: Column | int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Clips intervals to [0, size)."""
    n = F.lit(size) if isinstance(size, int) else size
    return spans.where(F.col(lo) < n).withColumn(hi, F.least(F.col(hi), n))


def spill(first_hi: Column, threshold: int = 4 << 20, carry: int = 256 << 10) -> Column:
    """How many bytes of the first dirty island to write out: all but the carry, once it is above the threshold."""
    return F.when(first_hi > threshold, first_hi - carry).otherwise(F.lit(0))


def sector_coverage(extent_rows: DataFrame, by: list[str], sector: int = 4096) -> DataFrame:
    """Bytes of each sector that extents ``(by, start, end)`` cover: ``(by, sector, covered, full)``."""
    first = F.call_function("div", F.col("start"), F.lit(sector))
    last = F.call_function("div", F.col("end") - 1, F.lit(sector))
    x = extent_rows.where("start < end").withColumn("sector", F.explode(F.sequence(first, last)))
    part = F.least(F.col("end"), (F.col("sector") + 1) * sector) - F.greatest(F.col("start"), F.col("sector") * sector)
    return x.groupBy(*by, "sector").agg(F.sum(part).alias("covered")).withColumn("full", F.col("covered") == sector)


def retention(snapshots: DataFrame, now: Column, day: int, daily_days: int = 7, weekly_weeks: int = 4, key: str = "id", at: str = "created_at") -> DataFrame:
    """Snapshots to keep: the newest of each day of the last days, and of each week of the last weeks; with ``daily`` and ``weekly``.

    Only what is young enough is looked at, and its newest of each day and week come from aggregates, which are combined before they move. A bucket that begins before the
    limit keeps its newest all the same: that is younger than the rest of it.
    """
    newest = F.max_by(key, F.struct(at, key)).alias(key)

    def of(width: int, most: int, name: str) -> DataFrame:
        bucket = F.call_function("div", F.col(at), F.lit(width))
        return snapshots.where(now - F.col(at) < most).groupBy(bucket.alias("__bucket")).agg(newest).select(key, F.lit(name).alias("__kept"))

    kept = of(day, daily_days * day, "daily").unionByName(of(day * 7, weekly_weeks * day * 7, "weekly"))
    kept = kept.groupBy(key).agg(*(F.coalesce(F.bool_or(F.col("__kept") == name), F.lit(False)).alias(name) for name in ("daily", "weekly")))
    return snapshots.join(kept, key)
