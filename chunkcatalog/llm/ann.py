"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by its nearest pivots in order and posted, with the
first ``prefix`` of that order, in the inverted files of its ``posted`` nearest ones. A query reads the files of its ``read`` nearest
pivots. Those found are ranked by Spearman's footrule distance of the prefixes (a missing pivot stands at place ``prefix``), and the
nearest ``keep`` share of a file is reranked by the exact inner product in double precision. What stands in several of the files that a query
reads is ranked in the first of them alone.

Inner products are no distance; vectors are therefore compared with pivots after adding a component that gives all of
them the largest norm, which makes the nearest by distance the largest by inner product.

Scale: the number of pivots follows the square root of the number of vectors up to ``most_pivots``, so a file grows with the square root, and so does what one
query reads, until then. A file is cut into cells of ``block`` vectors and ``query_block`` queries, one task each at most. Equal vectors are indexed once, with their
``k + 1`` smallest vec_ids, which is all that a result can hold of them, and equal queries are asked once; so a vector that a third of all rows share makes no large
file. Recall is measured in tests/llm against brute force.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is
not the most common one (ties: the longest), nor rows with null vec_id; ties in score go to the smaller vec_id; candidates are all rows
but the query's own, so rows that share a vec_id but not the vector all stay candidates, and a repeated row counts as one; of several query rows with one
vec_id the smallest vector (by its components in order) is asked; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.llm.common import cut

MOST_PIVOTS = 4096
PREFIX = 32
POSTED = 4
READ = 0.2
KEEP = 0.5


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part, each row once; v an array of doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    x = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite & F.exists("v", lambda c: c != 0))
    x = cut(x.distinct())  # read several times below
    sizes = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return x.where(F.size("v") == (sizes[0].d if sizes else -1))


def pivots_of(vectors: DataFrame, rows: int, count: int) -> np.ndarray:
    """At most ``count`` distinct vectors out of ``vectors(v)`` with about so many ``rows``: the first by a hash, out of a share that holds a few times as many."""
    share = min(1.0, 3 * count / max(1, rows))  # so that not every task sends its first rows
    few = vectors.select(F.xxhash64("v").alias("h"), "v").where(F.pmod("h", F.lit(1_000_003)) <= int(share * 1_000_003))
    return np.array([r.v for r in few.orderBy("h", "v").limit(count).collect()], dtype=np.float64)


def nearest_pivots(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray, lift: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` nearest pivots of each vector, nearest first. All lifted vectors have one norm, so nearness is the product."""
    near = v @ pivots.T + extra[:, None] * lift[None, :]
    part = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < len(pivots) else np.tile(np.arange(len(pivots)), (len(v), 1))
    order = np.lexsort((part, -np.take_along_axis(near, part, axis=1)), axis=1)
    return np.take_along_axis(part, order, axis=1)


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top * top - (v * v).sum(axis=1), 0))


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _ordered(pivots: np.ndarray, top: float, of_base: int, of_query: int):
    """Adds to rows ``(is_query, key, ids, v)`` the order of their nearest pivots."""
    lift = _lifted(pivots, top)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                v = _matrix(part.column(3))
                is_query = part.column(0).to_numpy(zero_copy_only=False)
                # Queries have nothing in the added component: what is near is what has the largest product.
                order = nearest_pivots(v, np.where(is_query, 0.0, _lifted(v, top)), pivots, lift, min(max(of_base, of_query), len(pivots)))
                rows = [o[: of_query if q else of_base].astype(np.int32) for o, q in zip(order, is_query, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.int32()))], [*part.schema.names, "near"])

    return run


def _search_cell(k: int, prefix: int, posted: int, reads: int, keep: float, pivots: int, at_once: int = 64):
    """All queries of a cell against all its vectors, in slices of ``at_once`` queries that go through as matrices."""
    schema = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("same", pa.bool_())])

    def search(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        pivot = cell["pivot"][0].as_py()
        is_query = cell["is_query"].to_numpy(zero_copy_only=False)
        base_rows, query_rows = cell.filter(pa.array(~is_query)), cell.filter(pa.array(is_query))
        if not base_rows.num_rows or not query_rows.num_rows:
            return schema.empty_table()
        base_rows = base_rows.take(pa.array(np.argsort(base_rows["key"].to_numpy(), kind="stable")))  # one order, whatever order rows come in
        base, asked = (_matrix(t["v"].combine_chunks()) for t in (base_rows, query_rows))
        near, wanted_files = (_matrix(t["near"].combine_chunks(), np.int32) for t in (base_rows, query_rows))
        keys = query_rows["key"].to_numpy()
        ids = base_rows["ids"].combine_chunks()
        ends, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
        m = min(prefix, near.shape[1])
        twice = np.full((pivots, len(base)), 2 * m, np.int16)  # a row for each pivot: twice its place in each vector's order
        np.put_along_axis(twice, near[:, :m].T, 2 * np.arange(m, dtype=np.int16)[:, None].repeat(len(base), 1), 0)
        found: list[tuple] = []
        for s in range(0, len(asked), at_once):
            q, order, key = asked[s : s + at_once], wanted_files[s : s + at_once], keys[s : s + at_once]
            rank = np.full((len(q), pivots), reads, np.int16)
            np.put_along_axis(rank, order[:, :reads], np.arange(min(reads, order.shape[1]), dtype=np.int16)[None, :].repeat(len(q), 0), 1)
            first = rank[:, near[:, 0]]
            for j in range(1, posted):
                np.minimum(first, rank[:, near[:, j]], out=first)
            here = first == rank[:, pivot][:, None]  # others were met in an earlier file
            # Footrule distance less what is the same for all candidates: the pivot at place i of the query, found at place p, counts max(i, 2 p - i).
            distance = np.zeros(here.shape, np.int16)
            for i in range(m):
                distance += np.maximum(twice[order[:, i]] - np.int16(i), np.int16(i))
            distance[~here] = np.iinfo(np.int16).max
            many = here.sum(axis=1)
            stay = np.maximum(np.minimum(many, np.maximum(np.ceil(keep * many).astype(np.int64), 4 * k)), 1)
            limit = np.sort(distance, axis=1)[np.arange(len(q)), stay - 1]
            score = np.where(here & (distance <= limit[:, None]), q @ base.T, -np.inf)
            most = min(len(base), k + 1)
            floor = np.partition(score, len(base) - most, axis=1)[:, len(base) - most]
            row, at = np.nonzero((score >= (floor - 1e-9 * np.abs(floor))[:, None]) & (score > -np.inf))  # ties stay
            exact = (base[at] * q[row]).sum(axis=1)
            same = (base[at] == q[row]).all(axis=1)
            times = ends[at + 1] - ends[at]
            each = np.repeat(np.arange(len(at)), times)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            found.append((key[row][each], flat[ends[at][each] + nth], exact[each], same[each]))
        key, vec_id, score, same = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((vec_id, -score, key))
        starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else np.zeros(0, np.int64)
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        order = order[nth <= k]  # the k + 1 first: one of them may be the query itself
        return pa.table([pa.array(c[order]) for c in (key, vec_id, score, same)], schema=schema)

    return search


def search(vectors: DataFrame, is_query, k: int = 20, pivots: int | None = None, prefix: int = PREFIX, posted: int = POSTED, read: float = READ, keep: float = KEEP, block: int = 4096, query_block: int = 4096, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row where ``is_query`` (a condition on vec_id) holds.

    ``pivots`` (by default about 2.3 times the square root of the number of vectors), ``read``: share of the pivots whose files a query reads.
    """
    x = usable(vectors)
    spark = x.sparkSession
    ranked = x.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    base = cut(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = cut(x.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    rows, top = base.agg(F.count("*"), F.max(norm)).first()
    p = pivots_of(base, rows, min(most_pivots, pivots or max(64, round(2.3 * math.sqrt(rows))))) if rows else []
    if not len(p):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted, reads = min(posted, len(p)), max(min(len(p), 48), math.ceil(read * len(p)))
    keyed = asked.groupBy("v").agg(F.min("vec_id").alias("key"))
    both = base.select(F.lit(False).alias("is_query"), F.col("ids")[0].alias("key"), "ids", "v").union(keyed.select(F.lit(True), "key", F.array().cast("array<long>"), "v"))
    ordered = cut(both.mapInArrow(_ordered(p, float(top), max(prefix, posted), max(prefix, reads)), "is_query boolean, key long, ids array<long>, v array<double>, near array<int>"))
    opened = F.slice("near", F.lit(1), F.when(F.col("is_query"), reads).otherwise(posted))
    sizes = ordered.select("is_query", F.explode(opened).alias("pivot")).groupBy("pivot").agg(F.count_if(~F.col("is_query")).alias("base"), F.count_if("is_query").alias("asked"))
    cells = {r.pivot: (-(-r.base // block), -(-r.asked // query_block)) for r in sizes.collect()}  # one row for each pivot
    parts = F.array(*(F.struct(F.lit(max(1, b)).alias("b"), F.lit(max(1, q)).alias("q")) for b, q in (cells.get(i, (1, 1)) for i in range(len(p)))))
    spread = ordered.select("*", F.explode(opened).alias("pivot"))
    one = lambda n: F.array(F.pmod(F.xxhash64("key", "v"), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    if all(c <= (1, 1) for c in cells.values()):
        spread = spread.select("*", F.lit(0).alias("b"), F.lit(0).alias("q"))
    else:
        spread = spread.withColumn("n", F.element_at(parts, F.col("pivot") + 1))
        spread = spread.withColumn("b", F.explode(F.when(F.col("is_query"), every(F.col("n.b"))).otherwise(one(F.col("n.b"))))).withColumn("q", F.explode(F.when(F.col("is_query"), one(F.col("n.q"))).otherwise(every(F.col("n.q"))))).drop("n")
    found = spread.groupBy("pivot", "b", "q").applyInArrow(_search_cell(k, prefix, posted, reads, keep, len(p)), "key long, vec_id long, score double, same boolean")
    order = [F.desc("score"), F.col("vec_id")]
    best = found.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")
    by_query = asked.join(keyed, "v").select(F.col("vec_id").alias("query_id"), "key").join(best, "key").where(~F.col("same") | (F.col("vec_id") != F.col("query_id")))
    final = by_query.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
