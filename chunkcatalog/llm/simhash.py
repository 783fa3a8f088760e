"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint sums the bits of the XXH64 (seed 42) of its 3-word shingles. Each 64-bit fingerprint is cut
into two segments of 32 bits. If two fingerprints differ in at most 3 bits, one of their segments differs in at most
one, so every fingerprint is posted under its own segments and probes the Hamming ball of radius 1 around each (33
values): no pair within the radius is missed. Matches are then verified on all 64 bits.

Copies meet once: only distinct fingerprints are posted. Within one probed value the links found are reduced to a
spanning forest, so a large group of near copies gives about as many edges as members, never all pairs, and still
loses no link between components.

Cases: null text counts as empty; a text without words has fingerprint zero and links like any other; fewer than
three words form one shingle; repeated shingles count each time; repeated rows share a component; rows with null
doc_id take part, and a group of nothing but those has a null component; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkcatalog.llm.common import connected_components, cut, tidy

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
_SLICE = 1 << 16
BROADCAST_ROWS = 400_000


def _hashes(text: bytes | None, shingle_words: int) -> np.ndarray:
    """XXH64 of each shingle of one text given in UTF-8."""
    words = (text or b"").lower().split()  # for bytes: A-Z only, and words [^\x20\x09-\x0D]+
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    span = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i : j - 1], SEED) for i, j in zip(starts, starts[span:], strict=False)), dtype=np.uint64)


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text given in UTF-8, as a signed 64-bit number."""
    return _simhash(_hashes(text, shingle_words))


def _simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _SLICE):
        part = hashes[k : k + _SLICE]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every column but the last, which holds the text, and its fingerprint."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id long, fp long)`` of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints at most ``radius`` bits apart."""
    edges: list[tuple[int, int]] = []
    rest = np.unique(fps)
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                frontier += list(found)
                rest = rest[~near]
    return edges


def _run_edges(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(keys)))
    live = (sizes > 1) & np.logical_or.reduceat(home, starts)
    pairs = starts[live & (sizes == 2)]
    a, b = fps[pairs], fps[pairs + 1]
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
    edges = list(zip(a[near].tolist(), b[near].tolist(), strict=True))
    for s, n in zip(starts[live & (sizes > 2)], sizes[live & (sizes > 2)], strict=True):
        edges += _forest(fps[s : s + n], radius)
    return edges


def _edges_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by key; a run of one key may span batches."""
    held: list[tuple[np.ndarray, ...]] = []
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        edges = _run_edges(*(np.concatenate(x) for x in zip(*parts, strict=True)), RADIUS)
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        last = int(np.searchsorted(now[0], now[0][-1], side="left"))
        if held and held[0][0][0] == now[0][-1]:
            held.append(now)
            continue
        if last:
            yield out([*held, tuple(x[:last] for x in now)])
            held = []
        elif held:
            yield out(held)
            held = []
        held.append(tuple(x[last:] for x in now))
    if held:
        yield out(held)


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints, spanning every component of the radius graph."""
    probes = None
    for k in (0, 1):
        segment = F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
        ball = F.array(segment, *(segment.bitwiseXOR(F.lit(1 << j)) for j in range(32)))
        part = fps.select("fp", F.posexplode(ball).alias("flip", "near")).select((F.col("near") + F.lit(k << 32)).alias("key"), "fp", (F.col("flip") == 0).alias("home"))
        probes = part if probes is None else probes.union(part)
    return probes.repartition("key").sortWithinPartitions("key").mapInArrow(_edges_of_sorted, "a long, b long")


def _rooted(marked: DataFrame) -> DataFrame:
    """``(fp, least_id, root)`` for each fingerprint of ``marked(doc_id, fp)``, root the smallest fingerprint of its component."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    grouped = connected_components(links(distinct.select("fp")))
    return distinct.join(grouped, distinct.fp == grouped.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs(doc_id, text)``."""
    marked = cut(fingerprints(docs))
    rooted = _rooted(marked)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _first_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of ``docs`` one row for each root of ``rooted(row, doc_id, root)``: the smallest doc_id (null last), then the smallest row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    rows = cut(rooted.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("__row")))
    kept = _with_row(docs, "__row").join(rows, "__row", "left_semi")
    # Texts are only shuffled again where a row that stays occurs more than once.
    repeated = rooted.join(rows, rooted.row == rows["__row"], "left_semi").count() > rows.count()
    return (kept.dropDuplicates(["__row"]) if repeated else kept).select(docs.columns)


def _with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """A hash of doc_id and text names a row; repeated rows share it."""
    return docs.withColumn(name, F.xxhash64("doc_id", "text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group of near-duplicates (null last); one of it where that row is repeated."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), "text")
    marked = cut(rows.mapInArrow(_fingerprints, "row long, doc_id long, fp long"))
    return _first_rows(docs, marked.join(_rooted(marked).select("fp", "root"), "fp"))


# Groups at an exact similarity. A SimHash radius that covers Jaccard 0.8 (10 bits expected, 3 deviation) lets through a
# few hundredths of all pairs, so within the radius SimHash finds the bulk of the copies, and what lies beyond it is found by
# the prefix filter, which leaves out no pair: ordered by frequency, two sets at the threshold share a shingle among their first
# n - ceil(least * n) + 1, at places whose rest still reaches the needed overlap. All pairs are verified on the whole sets.
#
# A list of many sets that similarity does not join (near copies with many changes each, a common line) would give the square
# of its length in pairs. Its sets are written as differences D from one of them, c, for which |x ^ y| = |Dx ^ Dy|; so what all
# share is gone, and a second prefix filter, over the differences, leaves out no pair either. K is what is linked to c or was in
# its component. With g = (1 - least) / (1 + least), a linked pair has |x ^ y| <= g(|x| + |y|), and a set y outside K has
# |Dy| > g(|y| + |c|). So a pair with y outside K shares at least (|Dx| + g(|c| - |x|)) / 2 of its differences, and at least
# |Dx| - |x| (1 - least) / least; if x is outside K and y is inside, only the latter holds of x, and at least one.
_COUNTERS = 1 << 20
_DIRECT = 8  # Longer lists are first linked to a few members, and then only across the components so found.
_STARS = 8
_WHOLE = 64  # Longer lists with several components are compared by differences.
_SKETCH_BITS = 1 << 11
_NEAR = 1e-6
_PAIRS = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("other", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_POSTED = pa.schema([_PAIRS.field(k) for k in (0, 1, 3, 4)])
_PAIRS_DDL = "key long, sid long, other long, n int, pos int"
_CHANGES = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("root", pa.int64()), ("n", pa.int32()), ("d", pa.int32()), ("pos", pa.int32()), ("kind", pa.int8()), ("sketch", pa.binary())])
_CHANGES_DDL = "key long, sid long, root long, n int, d int, pos int, kind byte, sketch binary"
_LINKED, _INSIDE, _OUTSIDE, _BEYOND = range(4)  # kinds of rows: a link to c; in a prefix, of a set in K or not; past its prefix


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        yield batch, batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()


def _sid(grams: np.ndarray) -> int:
    """Names a set of shingles, given in order."""
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED) - (1 << 63)


def _counted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_COUNTERS, dtype=np.int64)
        for batch, texts in _texts(batches):
            sids, fps, sizes = [], [], []
            for t in texts:
                hashes = _hashes(t, words)
                grams = np.unique(hashes)
                np.add.at(counts, (grams % _COUNTERS).astype(np.int64), 1)
                sids.append(_sid(grams))
                fps.append(_simhash(hashes))
                sizes.append(len(grams))
            yield _marked([*batch.columns[:2], pa.array(sids, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(len(texts), pa.binary())])
        for k in range(0, _COUNTERS, 1 << 16):
            yield _marked([pa.array([k], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())), pa.array([zlib.compress(counts[k : k + (1 << 16)].tobytes(), 1)], pa.binary())])

    return run


def _marked(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "sid", "fp", "n", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(c), dtype=np.int64)
    for k, c in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["row", "counts"])


def _needed(a, b, least: float):
    return np.ceil(least / (1 + least) * (a + b) - 1e-9)


def _posted(words: int, least: float, order):
    """Each set under the first shingles of its prefix; ``pos`` is a shingle's place in the order by frequency."""

    def parts(batches):
        counts = order.value
        for _, texts in _texts(batches):
            for t in texts:
                grams = np.unique(_hashes(t, words))
                if not (n := len(grams)):
                    continue
                first, sid = grams[np.lexsort((grams, counts[(grams % _COUNTERS).astype(np.int64)]))], _sid(grams)
                k = int(n - np.ceil(least * n - 1e-9)) + 1
                yield first[:k].view(np.int64), np.full(k, sid), np.full(k, n, dtype=np.int32), np.arange(k, dtype=np.int32)

    return lambda batches: _batched(parts(batches), _POSTED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of each run of one key; rows come ordered by it, and a run may span batches."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        starts = np.concatenate([[0], np.flatnonzero(now[0][1:] != now[0][:-1]) + 1, [len(now[0])]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = tuple(x[a:b] for x in now)
            if held and held[0][0][0] != part[0][0]:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]


def _batched(parts: Iterator[tuple[np.ndarray, ...]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for p in parts:
        held.append(p)
        rows += len(p[0])
        if rows > _SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _across(i: int, others: np.ndarray, sid: np.ndarray, n: np.ndarray, pos: np.ndarray, least: float) -> np.ndarray:
    """Those of ``others`` that may reach the threshold with row ``i`` if this key is the first that both have."""
    return others[np.minimum(n[i] - pos[i], n[others] - pos[others]) >= _needed(n[i], n[others], least)]


def _first_pass(least: float):
    """Pairs of short lists (pos -1), and of long ones with a few members; long lists are passed on (other = sid)."""

    def parts(batches):
        for key, sid, n, pos in _runs(batches):
            if len(key) > 1:  # repeated rows
                once = np.unique(sid, return_index=True)[1]
                key, sid, n, pos = key[once], sid[once], n[once], pos[once]
            m = len(sid)
            if m < 2:
                continue
            if m <= _DIRECT:
                wanted = [(i, np.arange(i + 1, m)) for i in range(m - 1)]
            else:
                yield key, sid, sid, n, pos
                mixed = _mixed(sid ^ key)
                centre = int(np.argmin(mixed))
                linked = mixed % np.maximum(1, (n * (1 - least) / _STARS)).astype(np.uint64) == 0
                linked[centre] = False
                wanted = [(centre, np.flatnonzero(linked))]
            for i, others in wanted:
                near = _across(i, others, sid, n, pos, least)
                if len(near):
                    yield key[near], np.minimum(sid[i], sid[near]), np.maximum(sid[i], sid[near]), n[near], np.full(len(near), -1, dtype=np.int32)

    return lambda batches: _batched(parts(batches), _PAIRS)


def _mixed(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)


def _second_pass(least: float):
    """Pairs of rows of one long list that are in different components (column other). A list of more than ``_WHOLE`` rows gives
    a row for each set instead: key is the set to compare it with, pos is 1 if both are in one component."""

    def parts(batches):
        for key, sid, root, n, pos in _runs(batches):
            roots, place, sizes = np.unique(root, return_inverse=True, return_counts=True)
            if len(roots) < 2:
                continue
            if len(sid) > _WHOLE:
                largest = np.flatnonzero(sizes[place] == sizes.max())
                centre = largest[np.argmin(_mixed(sid[largest]))]
                yield np.full(len(sid), sid[centre]), sid, root, n, (root == root[centre]).astype(np.int32)
                continue
            rank = np.empty(len(roots), dtype=np.int64)
            rank[np.argsort(sizes, kind="stable")] = np.arange(len(roots))
            rank = rank[place]
            by_rank = np.argsort(rank, kind="stable")
            ends = np.searchsorted(rank[by_rank], rank, side="right")
            for i in np.flatnonzero(rank < len(roots) - 1):  # members of the largest component are met by all others
                near = _across(i, by_rank[ends[i] :], sid, n, pos, least)
                if len(near):
                    yield key[near], np.minimum(sid[i], sid[near]), np.maximum(sid[i], sid[near]), n[near], np.full(len(near), -1, dtype=np.int32)

    return lambda batches: _batched(parts(batches), _PAIRS)


def _sketch(delta: np.ndarray) -> bytes:
    """Parities of the differences by bucket, all bits or the odd buckets: |Dx ^ Dy| is at least the number of bits that differ."""
    odd = np.bincount(_mixed(delta).astype(np.int64) % _SKETCH_BITS, minlength=_SKETCH_BITS) & 1
    places = np.flatnonzero(odd).astype(np.uint16)
    return places.tobytes() if 16 * len(places) < _SKETCH_BITS else np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _bits(sketches: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(sketches), _SKETCH_BITS // 8), dtype=np.uint8)
    for row, sketch in zip(bits, sketches, strict=True):
        if len(sketch) == len(row):
            row[:] = np.frombuffer(sketch, dtype=np.uint8)
        else:
            places = np.frombuffer(sketch, dtype=np.uint16)
            np.bitwise_or.at(row, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return bits.view(np.uint64)


def _changes(least: float, order):
    """For rows ``(sid, root, centre, same, n, nc, added, removed)``, set x against set c: x under its differences, those that
    few others have first (added shingles, the rarest first, then removed ones, the most frequent first); and its link to c."""
    g, most = (1 - least) / (1 + least), (1 - least) / least

    def parts(batches):
        counts = order.value
        for batch in batches:
            for r in range(batch.num_rows):
                sid, root, centre, same, n, nc = (batch.column(k)[r].as_py() for k in range(6))
                added, removed = (batch.column(k)[r].values.to_numpy() for k in (6, 7))
                delta = np.concatenate([added, removed])
                if not (d := len(delta)):
                    continue
                shared = (n + nc - d) // 2
                near = shared >= least * (n + nc - shared) - 1e-9
                if near and not same:
                    yield np.array([centre]), np.array([sid]), np.array([root]), *(np.array([v]) for v in (n, d, -1, _LINKED)), np.array([None], dtype=object)
                often = counts[(delta.view(np.uint64) % _COUNTERS).astype(np.int64)]
                often[len(added) :] *= -1
                delta = delta[np.lexsort((delta, often, np.arange(d) >= len(added)))]
                least_shared = max(1, np.ceil(d - most * n - _NEAR))
                prefix = int(d - max(least_shared, np.ceil((d + g * (nc - n)) / 2 - _NEAR))) + 1
                k = prefix if near or same else int(d - least_shared) + 1
                kind = np.full(k, _INSIDE if near or same else _OUTSIDE, dtype=np.int8)
                kind[prefix:] = _BEYOND
                key = (delta[:k].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(centre & (1 << 64) - 1)).view(np.int64)
                yield key, np.full(k, sid), np.full(k, root), np.full(k, n), np.full(k, d), np.arange(k), kind, np.array([_sketch(delta)] * k, dtype=object)

    return lambda batches: _batched(parts(batches), _CHANGES)


def _changed_pairs(least: float, nearest: bool):
    """Pairs that share a difference, are in different components and may reach the threshold; ``nearest``: one for each set outside K."""
    g = (1 - least) / (1 + least)

    def parts(batches):
        for _, sid, root, n, d, pos, kind, sketch in _runs(batches):
            outside = np.flatnonzero(kind != _INSIDE)
            if len(sid) < 2 or not len(outside):
                continue
            inside, early = np.flatnonzero(kind == _INSIDE), np.flatnonzero(kind == _OUTSIDE)
            bits = _bits(sketch)
            for i in outside:
                others = np.concatenate([inside, early[early > i]]) if kind[i] == _OUTSIDE else inside
                others = others[root[others] != root[i]]
                differ = g * (n[i] + n[others]) + _NEAR
                rest = np.minimum(d[i] - pos[i], d[others] - pos[others])
                fits = (2 * rest >= d[i] + d[others] - differ) & (np.abs(n[i] - n[others]) <= differ)
                others, differ = others[fits], differ[fits]
                apart = np.bitwise_count(bits[i] ^ bits[others]).sum(axis=1)
                near = others[apart <= differ]
                if len(near):
                    if nearest:
                        near = others[np.argmin(apart - differ), None]
                    yield np.minimum(sid[i], sid[near]), np.maximum(sid[i], sid[near])

    return lambda batches: _batched(parts(batches), _EDGES)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            for k in range(0, len(texts), 256):
                sets = [np.unique(_hashes(t, words)).view(np.int64) for t in texts[k : k + 256]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), pa.array(sets, pa.list_(pa.int64()))], ["sid", "grams"])

    return run


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a checkpointed table if it is small enough to be."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingles_of(sids: DataFrame, rows: DataFrame, reps: DataFrame, shingle_words: int) -> DataFrame:
    """``(sid, grams)`` of the sets named by ``sids(sid)``. ``reps(sid, row)`` has a row for each set."""
    asked = cut(sids.distinct().join(reps, "sid"))
    return cut(rows.join(_bounded(asked), "row").select("sid", "text").mapInArrow(_sets(shingle_words), "sid long, grams array<bigint>").dropDuplicates(["sid"]))


def _verified(rows: DataFrame, reps: DataFrame, pairs: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have a Jaccard similarity of at least ``least``."""
    pairs = cut(pairs.distinct())
    sets = _shingles_of(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")), rows, reps, shingle_words)
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return cut(both.where(shared >= least * (F.size("ga") + F.size("gb") - shared) - 1e-9).select("a", "b"))


def _shared_changes(changes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``changes`` by key, each with its present component."""
    found = changes.where(F.col("kind") != _LINKED).drop("root").join(roots, F.col("sid") == roots.node, "left")
    columns = [F.coalesce("root", "sid").alias("root") if c == "root" else F.col(c) for c in _CHANGES.names]
    return found.select(columns).repartition("key").sortWithinPartitions("key")


def keep_one_similar(docs: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """As ``keep_one``, for the groups that pairs with a Jaccard similarity of at least ``least`` on their shingles form."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), "text")
    found = cut(rows.mapInArrow(_counted(shingle_words), "row long, doc_id long, sid long, fp long, n int, counts binary"))
    marked = found.where("counts IS NULL").select("row", "doc_id", "sid", "fp")
    counts = np.zeros(_COUNTERS, dtype=np.int64)
    for r in found.where("counts IS NOT NULL").select("row", "counts").repartition("row").mapInArrow(_summed, "row long, counts binary").toLocalIterator():
        counts[r.row : r.row + (1 << 16)] = np.frombuffer(r.counts, dtype=np.int64)
    order = sc.broadcast(counts)
    reps = cut(marked.groupBy("sid").agg(F.min("row").alias("row"), F.min("fp").alias("fp")))
    copies = cut(marked.select("row").join(reps, "row", "left_anti"))
    posted = rows.join(_bounded(copies), "row", "left_anti").select("text").mapInArrow(_posted(shingle_words, least, order), "key long, sid long, n int, pos int")
    lists = cut(posted.repartition("key").sortWithinPartitions("key").mapInArrow(_first_pass(least), _PAIRS_DDL))
    by_fp = links(reps.select("fp").distinct())
    of_fp = reps.groupBy("fp").agg(F.min("sid").alias("sid"))
    linked = by_fp.join(of_fp.select(F.col("fp").alias("a"), F.col("sid").alias("sa")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("sid").alias("sb")), "b").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
    first = lists.where("pos < 0").select(F.col("sid").alias("a"), F.col("other").alias("b")).union(linked)
    reps = reps.select("sid", "row")
    edges = _verified(rows, reps, first, shingle_words, least)
    long_lists = lists.where("pos >= 0")
    roots = cut(connected_components(edges))
    again = long_lists.join(roots, long_lists.sid == roots.node, "left").select("key", "sid", F.coalesce("root", "sid").alias("other"), "n", "pos")
    rest = cut(again.repartition("key").sortWithinPartitions("key").mapInArrow(_second_pass(least), _PAIRS_DDL))
    if not rest.isEmpty():
        pairs = rest.where("pos < 0").select(F.col("sid").alias("a"), F.col("other").alias("b"))
        stars = cut(rest.where("pos >= 0").select("sid", F.col("other").alias("root"), F.col("key").alias("centre"), "pos").distinct())
        if not stars.isEmpty():
            tidy(docs.sparkSession)
            sets = _shingles_of(stars.select("sid"), rows, reps, shingle_words)
            both = stars.join(sets.select("sid", F.col("grams").alias("x")), "sid").join(sets.select(F.col("sid").alias("centre"), F.col("grams").alias("c")), "centre")
            changes = cut(both.select("sid", "root", "centre", "pos", F.size("x"), F.size("c"), F.array_except("x", "c"), F.array_except("c", "x")).mapInArrow(_changes(least, order), _CHANGES_DDL))
            # The nearest pairs join what is linked, so that the rest are few.
            near = _shared_changes(changes, roots).mapInArrow(_changed_pairs(least, nearest=True), "a long, b long")
            more = _verified(rows, reps, pairs.union(near), shingle_words, least).union(changes.where(F.col("kind") == _LINKED).select("key", "sid"))
            roots = cut(connected_components(more.union(roots)))
            pairs = _shared_changes(changes, roots).mapInArrow(_changed_pairs(least, nearest=False), "a long, b long")
            tidy(docs.sparkSession)
        roots = cut(connected_components(_verified(rows, reps, pairs, shingle_words, least).union(roots)))
    return _first_rows(docs, marked.join(roots, marked.sid == roots.node, "left").select("row", "doc_id", F.coalesce("root", "sid").alias("root")))
