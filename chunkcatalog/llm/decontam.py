"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item and a window of a document as long as the item (in words) match if the weighted Jaccard similarity of their
5-word shingles (weight: how often a shingle occurs) is at least ``SIMILARITY``.

1. Anchors. A matching window shares at least ``SIMILARITY`` of the item's shingles, so only places whose shingle occurs
   in an item can start one (a window whose first shingle is not shared can be moved on to one whose first is, losing
   nothing), and only those with enough anchors of the item within a window's length. This leaves out no match.
2. Fingerprints. Each remaining window and each item has a 64-bit SimHash of its shingles. Fingerprints are cut into 8 blocks of
   8 bits; two within ``RADIUS`` = 24 bits have a block within 3, so items are posted under the Hamming ball of radius 3 around
   each of their blocks and windows look their own blocks up: every pair within the radius is found. At similarity 0.8 the
   expected distance is 10 bits, with a deviation of 3, so the radius leaves out about one true match in a million.
3. Verification computes the exact similarity from the shingles themselves.

Only DataFrame functions are used. Words never leave the map side but for anchors and for documents with candidates. The
benchmark's shingles and postings and the names of rows with candidates or matches are broadcast only if their counted rows are few (``BROADCAST_ROWS``);
joins shuffle otherwise.

Cases: words are runs of letters and digits, lower-cased; an item of fewer than 5 words has one shingle of all its words; an item
without words (or null) matches nothing, nor does null text; windows at a document's end are shifted to fit or, in shorter
documents, cover it whole; repeated rows match alike; every distinct text of one item_id (null too, which is reported as null) is searched, and the best
window over them is the item's; ties between windows go to the first; extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkcatalog.llm.common import cut, row_key

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
BROADCAST_ROWS = 400_000
_SCALE = 1 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, size) -> Column:
    """Array of shingles, words joined by a space (which no word holds)."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " ")))


def _places(words: DataFrame, k: int) -> DataFrame:
    """A row ``(pos, h)`` for each ``k`` words in a row of ``words(words, ...)``, beside its other columns; ``h`` hashes the words' hashes.

    The shifted arrays are zipped and exploded, so that the hashing is compiled code on plain columns.
    """
    keys = [c for c in words.columns if c != "words"]
    x = words.where(F.size("words") >= k).select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    x = x.withColumn("n", F.size("hashes"))
    shifted = [F.col("hashes").alias("w0"), *(F.slice("hashes", F.lit(i + 1), F.col("n")).alias(f"w{i}") for i in range(1, k))]
    x = x.select(*keys, "n", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "at"))
    return x.where(F.col("pos") <= F.col("n") - k).select(*keys, "n", "pos", F.xxhash64(*(F.col("at")[f"w{i}"] for i in range(k))).alias("h"))


def _simhash(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprint of the hashes ``h`` of each key: bit set if in over half. Two counters of 32 bits share one sum."""
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(0x100000001))).alias(f"l{j}") for j in range(32)]
    x = hashed.groupBy(*keys).agg(F.count("*").alias("n"), *lanes)
    fp = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"l{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"l{j}", 32)
        for place, ones in ((j, low), (j + 32, high)):
            bit = (1 << place) - (1 << 64 if place == 63 else 0)
            fp = fp.bitwiseOR(F.when(ones * 2 > F.col("n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return x.select(*keys, fp.alias("fp"))


def _block(b: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * b).bitwiseAND(F.lit(0xFF))


def _flipped(b: int):
    return lambda x: x.bitwiseXOR(_block(b).cast("int"))


def _ball(radius: int) -> list[int]:
    return [x for x in range(256) if x.bit_count() <= radius]


def prepare(items: DataFrame) -> DataFrame:
    """``(key, item_id, words, n_words, k, grams)``: the items that can match, checkpointed; ``key`` is a hash of item_id and text."""
    x = items.where("text IS NOT NULL").select("item_id", "text").distinct().select(row_key("item_id", "text").alias("key"), "item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    x = x.select("key", "item_id", "words", F.size("words").alias("n_words"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k"))
    return cut(x.withColumn("grams", _shingles(F.col("words"), F.col("k"))))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a checkpointed table if it is small enough to be."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def anchors(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(row, n, item, n_words, k, pos)``: places from which a window may match an item. ``docs(row, text)``."""
    sizes = [r.k for r in items.select("k").distinct().collect()]  # five values at most
    if not sizes:
        none = lambda t: F.lit(None).cast(t)
        return docs.where("false").select("row", none("int").alias("n"), row_key("text").alias("item"), none("int").alias("n_words"), none("int").alias("k"), none("int").alias("pos"))

    def every(words: DataFrame, of_items: bool) -> DataFrame:
        parts = [_places(words.where(F.col("k") == k) if of_items else words, k).withColumn("size", F.lit(k)) for k in sizes]
        return functools.reduce(DataFrame.union, parts)

    grams = every(items.select(F.col("key").alias("item"), "n_words", "k", "words"), True).select("item", "n_words", "k", F.col("h").alias("ih")).distinct()
    grams = _bounded(cut(grams))
    found = every(docs.select("row", words_of(F.col("text")).alias("words")), False)
    hit = found.join(grams, (F.col("h") == F.col("ih")) & (F.col("size") == F.col("k"))).select("row", "n", "item", "n_words", "k", "pos").distinct()
    span = F.col("n_words") - F.col("k") + 1
    hit = hit.withColumn("place", F.floor(F.col("pos").cast("long") * _SCALE / span)).withColumn("need", F.ceil(span * SIMILARITY - 1e-9))
    near = F.expr(f"count(*) OVER (PARTITION BY row, item ORDER BY place RANGE BETWEEN CURRENT ROW AND {_SCALE} FOLLOWING)")
    return hit.withColumn("near", near).where("near >= need").select("row", "n", "item", "n_words", "k", "pos")


def _similarities(near: DataFrame, windows: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """``near(key, item)`` with ``item_id`` and the weighted Jaccard ``similarity`` of the window's and the item's shingles as multisets."""
    held = windows.select(*key, F.size("grams").alias("window_size"), F.explode("grams").alias("g")).groupBy(*key, "window_size", "g").agg(F.count("*").alias("c"))
    wanted = items.select(F.col("key").alias("item"), "item_id", F.size("grams").alias("item_size"), F.explode("grams").alias("g")).groupBy("item", "item_id", "item_size", "g").agg(F.count("*").alias("ic"))
    both = near.join(held, key).join(wanted, ["item", "g"])
    shared = both.groupBy(*key, "item", "item_id", "window_size", "item_size").agg(F.sum(F.least("c", "ic")).alias("shared"))
    return shared.select(*key, "item_id", (F.col("shared") / (F.col("window_size") + F.col("item_size") - F.col("shared"))).alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(row, item_id, start, similarity)``: for each row and item that match, the best window (ties: the first).

    ``docs(row, text)``: rows with one ``row`` must have one text.
    """
    items = prepare(benchmark)
    starts = anchors(docs, items).select("row", "n_words", "k", F.greatest(F.least("pos", F.col("n") - F.col("n_words")), F.lit(0)).alias("start")).distinct()
    starts = cut(starts.groupBy("row").agg(F.collect_list(F.struct("n_words", "k", "start")).alias("starts")))
    # Only names of rows are broadcast; the lists, which grow with the documents and with the passages in each, meet what is left of the texts by row.
    asked = docs.join(_bounded(starts.select("row")), "row", "left_semi").dropDuplicates(["row"])
    windows = asked.join(starts, "row").select("row", words_of(F.col("text")).alias("words"), "starts")
    windows = windows.select("row", "words", F.explode("starts").alias("w")).select("row", F.col("w.n_words").alias("n_words"), F.col("w.k").alias("k"), F.col("w.start").alias("start"), _shingles(F.slice("words", F.col("w.start") + 1, F.col("w.n_words")), F.col("w.k")).alias("grams"))
    windows = cut(windows)
    key = ["row", "n_words", "start"]
    marked = _simhash(windows.select(*key, F.explode("grams").alias("g")).select(*key, F.xxhash64("g").alias("h")), key)
    item_fp = _simhash(items.select(F.col("key").alias("item"), F.explode("grams").alias("g")).select("item", F.xxhash64("g").alias("h")), ["item"]).join(items.select(F.col("key").alias("item"), F.col("n_words").alias("iw")), "item")
    ball = F.array(*map(F.lit, _ball(RADIUS // BLOCKS)))
    posted = None
    for b in range(BLOCKS):
        part = item_fp.select("item", F.col("fp").alias("ifp"), "iw", F.lit(b).alias("block"), F.explode(F.transform(ball, _flipped(b))).alias("value"))
        posted = part if posted is None else posted.union(part)
    posted = _bounded(cut(posted))
    asked = marked.select(*key, "fp", F.posexplode(F.array(*(_block(b).cast("int") for b in range(BLOCKS)))).alias("b", "v"))
    near = asked.join(posted, (asked.b == posted.block) & (asked.v == posted.value) & (asked.n_words == posted.iw)).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select(*key, "item").distinct()
    pairs = _similarities(near, windows, items, key).where(F.col("similarity") >= least)
    best = pairs.groupBy("row", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
    return best.select("row", "item_id", (-F.col("best.s")).alias("start"), F.col("best.similarity").alias("similarity"))


def with_row(docs: DataFrame) -> DataFrame:
    """A hash of doc_id and text names a row; repeated rows share it."""
    return docs.withColumn("row", row_key("doc_id", "text"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, similarity)``, start in words."""
    rows = with_row(docs.select("doc_id", "text")).where("text IS NOT NULL")
    found = matches(rows.select("row", "text"), benchmark)
    return rows.select("row", "doc_id").distinct().join(found, "row").select("doc_id", "item_id", F.col("start").cast("long").alias("start"), "similarity")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that match no item."""
    rows = with_row(docs)
    found = cut(matches(rows.where("text IS NOT NULL").select("row", "text"), benchmark).select("row").distinct())
    return rows.join(_bounded(found), "row", "left_anti").select(docs.columns)
