"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... are mapped to the golden-ratio points frac(i * 0.618...), and the cumulative weights of the sources
cut [0, 1) into one interval each: the interval a point falls into is the slot's source. A slot's rank among those of
its source then names a block of that source's shuffled token stream (all documents end to end, in an order given by a
hash; the stream is repeated up to ``max_repeats`` times). All blocks have ``block`` tokens but the last of a source,
which ends at the target. Where the schedule leaves a source short by some blocks, closing slots are added at its end,
so that each source takes exactly floor(target) tokens.

Scale: texts never move; only (id, source, size) rows do. Ranks and stream positions are two-level prefix sums over
chunks of slots and hashed runs of documents, so no source is ordered in one task. Sources are found for slots by an
equi-join on cells of [0, 1). The table of sources alone is ordered as a whole: one row for each source.

Cases: null text has size 0 and is never taken; a null source is a source of its own, the last; repeated rows and
repeated doc_id keep a row each, also in ``taken_documents``; ties in the shuffle go by doc_id and size; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.llm.common import cut, row_key

GOLDEN = 0x9E3779B97F4A7C15  # 2**64 divided by the golden ratio
CELLS = 1024
SLOT_CHUNK = 4096
RUN_DOCS = 2000


def size_of(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, max_repeats: int) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``: ``share`` of all sizes by weight, none above ``max_repeats`` times its source.

    Water-filling: in order of cap / weight, a source is capped if even its part of what the earlier ones leave is more
    than its cap. One row for each source, ordered in one task.
    """
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(1))
    x = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumn("total", F.sum("source_size").over(every).cast("double") * share)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("left_mass", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.col("left_mass") / F.col("left_weight")
    x = x.withColumn("level", F.max(F.when(F.col("ratio") > level, level)).over(every))
    return x.withColumn("target", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("level"))).select("source", "source_size", "weight", "target", "total")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights by place in code-point order, null last, repeating."""
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), place + 1))


def _point(slot: Column) -> Column:
    """Fractional part of slot / golden ratio, by integers modulo 2**64: the upper and the lower 32 bits of the product are summed apart."""
    mask = F.lit(0xFFFFFFFF)
    half = (1 << 31) - 1
    upper, lower = F.lit(0).cast("long"), F.lit(0).cast("long")
    for digit, step in ((slot.bitwiseAND(F.lit(half)), GOLDEN), (F.shiftright(slot, 31), (GOLDEN << 31) & ((1 << 64) - 1))):
        product = digit * F.lit(step & 0xFFFFFFFF)
        upper += (digit * F.lit(step >> 32)).bitwiseAND(mask) + F.shiftrightunsigned(product, 32)
        lower += product.bitwiseAND(mask)
    upper = (upper + F.shiftrightunsigned(lower, 32)).bitwiseAND(mask)
    return (upper + lower.bitwiseAND(mask) / F.lit(float(1 << 32))) / F.lit(float(1 << 32))


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """Slots ``(slot, source, rank)`` for ``plan(source, target)``; the same plan gives the same slots."""
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    n = int(total // block) + 1 if total > 0 else 0
    order = W.orderBy(F.col("source").asc_nulls_last())
    arcs = plan.where("target > 0").withColumn("hi", F.sum("target").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.lit(total or 1.0))
    arcs = arcs.select("source", "target", F.coalesce(F.lag("hi").over(order), F.lit(0.0)).alias("lo"), F.when(F.lead("hi").over(order).isNull(), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))
    celled = arcs.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", _point(F.col("slot"))).withColumn("cell", F.floor(F.col("point") * CELLS))
    placed = slots.join(celled, "cell").where("point >= lo AND point < hi").select("slot", "source", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    counts = placed.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy("source").orderBy("chunk")) - F.col("n")).select(F.col("source").alias("s"), F.col("chunk").alias("c"), "base")
    ranked = placed.withColumn("local", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(before, ranked.source.eqNullSafe(before.s) & (ranked.chunk == before.c)).select("slot", "source", (F.col("base") + F.col("local")).alias("rank"))
    have = counts.groupBy("source").agg(F.sum("n").alias("have")).withColumnRenamed("source", "s")
    short = arcs.join(have, arcs.source.eqNullSafe(have.s), "left").select("source", F.coalesce("have", F.lit(0)).alias("have"), F.ceil(F.floor("target") / block).alias("need")).where("need > have")
    closing = short.select(F.lit(None).cast("long").alias("slot"), "source", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    return ranked.union(closing)


def stream(sized: DataFrame, seed: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``sized(row columns, source, size)`` with ``start``, each row's place in its source's shuffled token stream; ``ties`` are columns that order rows of one doc_id and size."""
    runs = max(1, sized.count() // RUN_DOCS)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    x = sized.where("size > 0").withColumn("key", key).withColumn("run", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(runs) / F.lit(1 << 32)).cast("long"))
    inside = W.partitionBy("source", "run").orderBy("key", "doc_id", "size", *ties).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    sums = x.groupBy("source", "run").agg(F.sum("size").alias("n"))
    sums = sums.select(F.col("source").alias("s"), F.col("run").alias("r"), (F.sum("n").over(W.partitionBy("source").orderBy("run")) - F.col("n")).alias("base"))
    return x.join(sums, x.source.eqNullSafe(sums.s) & (x.run == sums.r)).withColumn("start", F.col("base") + F.col("inside")).drop("key", "run", "inside", "s", "r", "base")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, block: int = 256, seed: int = 42, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The plan and its pieces.

    Returns ``sized(doc_id, source, size, carried columns, start, source_size, target)``, a row for each document, and
    ``pieces(slot, source, rank, start, piece_from, piece_words)``: the words of the document at ``start`` that a slot takes.
    """
    sized = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *carried))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cut(targets(cyclic_weights(per_source, weights), share, max_repeats)).select("source", "source_size", "target")
    p = plan.withColumnRenamed("source", "s")
    placed = cut(stream(sized, seed, carried))
    nothing = sized.where("size = 0").withColumn("start", F.lit(None).cast("long"))
    rows = placed.unionByName(nothing)
    rows = rows.join(p, rows.source.eqNullSafe(p.s)).drop("s")
    epochs = placed.join(p, placed.source.eqNullSafe(p.s)).drop("s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    at = F.col("start") + F.col("epoch") * F.col("source_size")
    ends = F.least(at + F.col("size"), F.floor("target"))
    cutup = epochs.withColumn("at", at).withColumn("to", ends).where("to > at").withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("to") - 1) / block))))
    lo, hi = F.greatest("at", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    cutup = cutup.select("source", "rank", "start", (lo - F.col("at")).alias("piece_from"), (hi - lo).alias("piece_words"))
    slots = schedule(plan, block).select("slot", F.col("source").alias("s"), F.col("rank").alias("r"))
    pieces = cutup.join(slots, cutup.source.eqNullSafe(slots.s) & (cutup["rank"] == slots.r)).drop("s", "r")
    return rows, pieces


def mixed_documents(docs: DataFrame, carried: tuple[str, ...] = (), **options: object) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for each document, beside the ``carried`` columns of ``docs``."""
    rows, pieces = mix(docs, carried=carried, **options)
    taken = pieces.groupBy(F.col("source").alias("s"), F.col("start").alias("at")).agg(F.sum("piece_words").alias("taken"))
    joined = rows.join(taken, rows.source.eqNullSafe(taken.s) & (rows.start == taken["at"]), "left")
    return joined.select("doc_id", "source", "size", *carried, "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def taken_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with ``size``, ``source_size``, ``target`` and ``taken``.

    Rows meet their numbers by a hash of all columns. Rows that share doc_id but not all else are told apart by it; of rows equal
    throughout one stands for all, and comes once for each of them that is taken.
    """
    added = ["size", "source_size", "target", "taken"]
    keyed = docs.drop(*added)
    keyed = keyed.withColumn("__key", row_key(*keyed.columns))
    plan = cut(mixed_documents(keyed, carried=("__key",), **options).select("__key", *added))
    repeated = cut(plan.groupBy("__key").count().where("count > 1").select("__key"))
    plan = plan.where("taken > 0")
    if repeated.isEmpty():
        return keyed.join(plan, "__key").drop("__key")
    once = keyed.join(repeated, "__key", "left_anti").unionByName(keyed.join(repeated, "__key", "left_semi").dropDuplicates(["__key"]))
    return once.join(plan, "__key").drop("__key")
