"""Katz backoff language model of words and pairs of words, trained and evaluated over a whole corpus.

P(w | h) = d(r) r / c(h) where the pair h w was seen r times in training, and alpha(h) P(w) where it was not; P(w) is discounted in the same
way, and what it leaves is the probability of the one unknown word. Discounts are Good-Turing's for counts up to ``K`` (Katz 1987);
larger counts give up ``DELTA`` of one occurrence, so that every history keeps some mass. The weight alpha(h) is exactly the mass
that h leaves, divided by the probability that the words not seen after h have in P; so each P(. | h) sums to 1 over the vocabulary and the
unknown word. The first word's history is the end token.

How it is distributed. Words are hashed to 64 bits as they are read, batch by batch, in numpy.

1. Words of training documents are counted: one row for each different word of a batch, summed by word into a written table.
2. Every occurrence (w, h, document) goes to a partition of w, packed by batch (words as places in a local dictionary,
   compressed). Words with a large share of all tokens are spread by h. A partition holds the counts of its words and of all pairs that end
   in them; from these it takes sums for each document. Discounts of pairs are not known yet, so occurrences of pairs seen
   up to K times are counted by r instead.
3. For each history a partition sends how many pairs of each r it has and their P(w), to a partition of h (frequent ones to several, which take
   their batches in turn); those meet the
   occurrences in held-out documents that were not seen, which back off with that history, and are sent to their batch.
4. The sums are written; with the pairs' counts of counts the discounts are known, and each batch adds its documents up.

The number of partitions follows the number of tokens (``PER_PARTITION``), so a task's memory does not grow with the corpus, and what
moves is proportional to it. Sums are over the same rows in the same order, so reruns agree.

Cases: null text counts as empty: one token, its end; a null doc_id is held out; repeated rows have a row each and count
as often as they occur; without training tokens only the unknown word has a probability, 1; where counts of counts misbehave, as in small
corpora, Good-Turing's smoothed form gives the discounts; extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkcatalog.llm.common import cut

K = 5
DELTA = 0.1
SLOPE = -1.1
PER_PARTITION = 3_000_000
LEAST_PARTITIONS = 24
BATCH_BYTES = 16 << 20
_CHUNK = 1 << 21
_SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
END = np.uint64(0x5851F42D4C957F2D)


def _release() -> None:
    """Give freed memory back to the system: workers that wait for their next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokenizer:
    """Hashes of the tokens of texts: words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and an end after each text.

    A word's hash is a polynomial in its bytes modulo 2**64, taken from running sums over many texts at once.
    """

    def __init__(self) -> None:
        self.value = np.arange(1, 257, dtype=np.uint64)
        self.value[65:91] += np.uint64(32)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.power = self.back = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _BASE))])
            self.back = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _INVERSE))])

    def _texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        self._powers(n + 1)
        word = ~self.space[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        gap = ~word
        starts = np.flatnonzero(word & (np.append(True, gap)[:n] | first[:n]))
        ends = np.flatnonzero(word & (np.append(gap, True)[1:] | first[1:])) + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.value[data] * self.power[:n], dtype=np.uint64)])
        hashes = _mixed((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))
        counts = np.diff(np.searchsorted(starts, offsets))
        return hashes, counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in order, and how many each text has."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        words, counts, k = [], [], 0
        while k < len(texts):
            to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + _CHUNK, side="right")) - 1)
            w, c = self._texts(data[offsets[k] : offsets[to]], offsets[k : to + 1] - offsets[k])
            words.append(w)
            counts.append(c)
            k = to
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        words, counts = np.concatenate(words), np.concatenate(counts)
        out = np.full(len(words) + len(counts), END)
        place = np.ones(len(out), bool)
        place[np.cumsum(counts + 1) - 1] = False
        out[place] = words
        return out, counts + 1


def _histories(tokens: np.ndarray) -> np.ndarray:
    """The token before each; before the first of a text stands the end of the one before, which plays the beginning."""
    return np.concatenate([[END], tokens[:-1]]) if len(tokens) else tokens


def _least(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _gaps(x: np.ndarray) -> np.ndarray:
    """Sorted 64-bit numbers as the bytes of their gaps, byte by byte: the upper ones are nearly all 0 and compress away."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _from_gaps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.T).view("<u8").ravel(), dtype=np.uint64)


def _pack(**arrays: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


_ROWS = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("batch", pa.int64()), ("blob", pa.binary()), ("nums", pa.list_(pa.int64()))])
_ROWS_SQL = "part long, kind string, batch long, blob binary, nums array<bigint>"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _ROWS.types, strict=True)], schema=_ROWS)


def _each_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Groups of documents with about ``BATCH_BYTES`` of text: tokens, tokens per document, doc_id, held out.

    Arrow batches are cut where they are larger and joined where they are smaller; one text is never cut.
    """
    tokenize, held, size = Tokenizer(), [], 0

    def joined() -> tuple:
        return tuple(pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*held, strict=True))

    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < batch.num_rows:
            done = lengths[k - 1] if k else 0
            to = max(k + 1, int(np.searchsorted(lengths, done + max(BATCH_BYTES - size, 1), side="right")))
            part = batch.slice(k, to - k)
            tokens, counts = tokenize(part.column(1))
            held.append((tokens, counts, part.column(0), part.column(2).to_numpy(zero_copy_only=False).astype(bool)))
            size += int(lengths[to - 1] - done)
            k = to
            if size >= BATCH_BYTES or k < batch.num_rows:
                yield joined()
                held, size = [], 0
                _release()
    if held:
        yield joined()
    _release()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tokens, counts, _, held_out in _each_batch(batches):
        words, n = np.unique(tokens[np.repeat(~held_out, counts)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "c"])


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing's d(1) to d(K) from the counts of counts n[0] (of 1) to n[K] (of K + 1), in Katz's form, which leaves counts above K alone.

    Adjusted counts r* are Gale and Sampson's simple Good-Turing: Turing's (r + 1) n(r + 1) / n(r) while it differs significantly (by 1.65 deviations) from that of a
    line fitted to log n(r) over log r, and the line's from there on. A Turing estimate that would give no discount between 0 and 1 is replaced by the line's, for that r
    alone. The line falls faster than 1 / r (``SLOPE`` at the least), so its discounts always lie between 0 and 1; small tables take it too.
    """
    r = np.arange(1, K + 2)
    n = np.array(n, np.float64)
    seen = n > 0
    slope = SLOPE
    if seen.sum() > 1:
        x, y = np.log(r[seen]), np.log(n[seen])
        slope = min(SLOPE, float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()))
    common = float(K + 1) ** (slope + 1)  # (K + 1) n(K + 1) / n(1) on the line
    ratio = ((r[:K] + 1) / r[:K]) ** (slope + 1)  # r* / r on the line
    for i in range(K):
        if n[i] == 0 or n[i + 1] == 0:
            break
        turing = (i + 2) * n[i + 1] / n[i]
        deviation = (i + 2) * np.sqrt(n[i + 1] * (1 + n[i + 1] / n[i])) / n[i]
        if abs(turing - ratio[i] * (i + 1)) <= 1.65 * deviation:
            break
        if common < turing / (i + 1) < 1:
            ratio[i] = turing / (i + 1)
    return (ratio - common) / (1 - common)


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c for counts c; 0 stays 0."""
    return np.where(c > K, c - DELTA, c * np.concatenate([[0.0], d])[np.minimum(c, K)])


def _part_of(w: np.ndarray, h: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    out = np.empty(len(w), np.int32)
    for k in range(0, len(w), _SLICE):  # slices keep the intermediate arrays small
        x, y = w[k : k + _SLICE], h[k : k + _SLICE]
        out[k : k + _SLICE] = _mixed(np.where(np.isin(x, hot), x ^ (y * np.uint64(3)), x)) % np.uint64(parts)
    return out


def _occurrences(parts: int, hot: np.ndarray):
    """Packs the occurrences of each batch by partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, (tokens, counts, ids, held_out) in enumerate(_each_batch(batches)):
            batch = (task << 24) | k
            h = _histories(tokens)
            doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            part = _part_of(tokens, h, hot, parts)
            ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable").astype(np.int32)
            del part
            rows = [(batch % parts, "batch", batch, _pack(ids=ids, held_out=held_out, counts=_least(counts)), None)]
            packed_held = np.packbits(held_out)
            for p in np.flatnonzero(np.diff(ends)).tolist():
                pick = order[ends[p] : ends[p + 1]]
                if len(pick):
                    words, w_at = np.unique(tokens[pick], return_inverse=True)
                    before, h_at = np.unique(h[pick], return_inverse=True)
                    blob = _pack(words=_gaps(words), w_at=_least(w_at), before=_gaps(before), h_at=_least(h_at), doc=_least(np.diff(doc[pick], prepend=0)), held_out=packed_held, docs=len(counts))
                    rows.append((p, "tokens", batch, blob, None))
                if len(rows) > 63:
                    yield from _table(rows).to_batches()
                    rows = []
            if rows:
                yield from _table(rows).to_batches()

    return pack


def _words_by_part(parts: int, hot: np.ndarray):
    """Packs the word counts by partition; hot words are known everywhere."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            keep = ~np.isin(w, hot)
            w, c = w[keep], c[keep]
            part = _part_of(w, w, hot, parts)
            order = np.lexsort((w, part))
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, "words", -1, _pack(w=_gaps(w[order[a:b]]), c=_least(c[order[a:b]])), None) for p in np.flatnonzero(np.diff(ends)).tolist() for a, b in [(ends[p], ends[p + 1])]]
            yield from _table(rows).to_batches()

    return pack


def _slices(h: np.ndarray, hot: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Over how many partitions each history is spread: one, but for the frequent ones ``hot`` (sorted), which have as many as their share of all tokens asks."""
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    return np.where(hot[at] == h, shares[at], 1) if len(hot) else np.ones(len(h), np.int64)


def _by_history(parts: int, h: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = (_mixed(h + np.uint64(17) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(q, kind="stable")
    return order, np.searchsorted(q[order], np.arange(parts + 1))


def _count_pairs(parts: int, hot_w: np.ndarray, hot_c: np.ndarray, total: int, d: np.ndarray, unknown: float):
    """Step 2 for one partition of words."""
    by_hash = np.argsort(hot_w)
    hot_h, shares = hot_w[by_hash], np.clip(-(-hot_c[by_hash] * 4 * parts // max(total, 1)), 1, parts).astype(np.int64)

    def reduce(group: pa.Table) -> pa.Table:
        out = _table(rows_of(group))
        _release()
        return out

    def rows_of(group: pa.Table) -> list[tuple]:
        kinds = group["kind"].to_pylist()
        blobs = group["blob"]
        own = [_unpack(blobs[i].as_py()) for i, k in enumerate(kinds) if k == "words"]
        w = np.concatenate([hot_w, *(_from_gaps(x["w"]) for x in own)])
        c = np.concatenate([hot_c, *(x["c"].astype(np.int64) for x in own)])
        order = np.argsort(w)
        w, c = w[order], c[order]
        del own
        p_word = np.append(np.log10(np.maximum(_discounted(c, d) / max(total, 1), 1e-300)), np.log10(unknown))
        counts = np.append(c, 0)  # at -1: the unknown word
        packs = sorted((group["batch"][i].as_py(), i) for i, k in enumerate(kinds) if k == "tokens")
        before = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_from_gaps(_unpack(blobs[i].as_py())["before"]) for _, i in packs)]))
        keys, docs, held = [], [], []
        for _, i in packs:
            x = _unpack(blobs[i].as_py())
            words = _from_gaps(x["words"])
            at = np.searchsorted(w, words)
            at = np.where((at < len(w)) & (w[np.minimum(at, len(w) - 1)] == words), at, -1) if len(w) else np.full(len(words), -1)
            doc = np.cumsum(x["doc"], dtype=np.int64)
            keys.append(at[x["w_at"]] * np.int64(len(before)) + np.searchsorted(before, _from_gaps(x["before"]))[x["h_at"]])
            docs.append((doc.astype(np.uint32), x["docs"]))
            held.append(np.unpackbits(x["held_out"], count=x["docs"]).astype(bool)[doc])
        rows = [(b, k, b, blobs[i].as_py(), None) for i, (k, b) in enumerate(zip(kinds, group["batch"].to_pylist(), strict=True)) if k == "batch"]
        size = max(len(before), 1)
        if keys:
            pairs, seen = np.unique(np.concatenate([k[~x] for k, x in zip(keys, held, strict=True)]), return_counts=True)
        else:
            pairs, seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lost_h, lost_batch, lost_doc = [], [], []
        for (batch, _), key, (doc, n), out in zip(packs, keys, docs, held, strict=True):
            at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
            r = np.where(pairs[at] == key, seen[at], 0) if len(pairs) else np.zeros(len(key), np.int64)
            word = np.where(key < 0, -1, key // size)
            count = counts[word]
            gain = -np.log10(np.maximum(count, 1)) + np.where(r > K, np.log10(np.maximum(r, 1) - DELTA), np.where(r == 0, p_word[word], 0.0))
            # Sums of the documents that have words here; others would only add zeros.
            mine, at_doc = np.unique(doc, return_inverse=True)
            few = len(mine)
            of_r = np.bincount(at_doc * (K + 1) + np.where(r > K, 0, r), minlength=few * (K + 1)).reshape(few, K + 1)[:, 1:]
            base = np.bincount(at_doc, weights=np.log10(count + 1.0), minlength=few)
            total_gain = np.bincount(at_doc, weights=gain, minlength=few)
            rows.append((batch, "docs", batch, _pack(mine=_least(np.diff(mine, prepend=np.uint32(0))), docs=n, base=base, gain=total_gain, known=_least(np.bincount(at_doc, weights=count > 0, minlength=few).astype(np.int64)), of_r=_least(of_r.ravel())), None))
            lost = r == 0
            if lost.any():
                lost_h.append((key % size)[lost])
                lost_batch.append(np.full(int(lost.sum()), batch))
                lost_doc.append(doc[lost])
        n_r = [int((seen == r).sum()) for r in range(1, K + 2)]
        my = int(group["part"][0].as_py())
        rows.append((-1 - my, "counts", -1, None, n_r))
        history, word = pairs % size, pairs // size
        classes = np.minimum(seen, K + 1)
        used = np.unique(history)
        if len(used):
            local = np.searchsorted(used, history)
            mass = np.bincount(local, weights=10.0 ** p_word[word], minlength=len(used))
            by_class = np.bincount(local * (K + 1) + classes - 1, minlength=len(used) * (K + 1)).reshape(-1, K + 1)
            # What is known of a frequent history goes to each of its slices.
            times = _slices(before[used], hot_h, shares)
            each = np.repeat(np.arange(len(used)), times)
            order, ends = _by_history(parts, before[used][each], np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times))
            for q in np.flatnonzero(np.diff(ends)).tolist():
                pick = np.unique(each[order[ends[q] : ends[q + 1]]])  # two slices may share a partition
                rows.append((-1 - q, "histories", -1, _pack(h=_gaps(before[used][pick]), mass=mass[pick], n=_least(by_class[pick].ravel())), None))
        if lost_h:
            h, batch, doc = before[np.concatenate(lost_h)], np.concatenate(lost_batch), np.concatenate(lost_doc)
            order, ends = _by_history(parts, h, _mixed(batch.astype(np.uint64)) % _slices(h, hot_h, shares).astype(np.uint64))
            for q in np.flatnonzero(np.diff(ends)).tolist():
                pick = order[ends[q] : ends[q + 1]]
                if len(pick):
                    names, at = np.unique(h[pick], return_inverse=True)
                    which, b_at = np.unique(batch[pick], return_inverse=True)
                    rows.append((-1 - q, "backoffs", -1, _pack(h=_gaps(names), at=_least(at), which=which, b_at=_least(b_at), doc=_least(doc[pick])), None))
        return rows

    return reduce


def _meet_histories(group: pa.Table) -> pa.Table:
    """Step 3: for one partition of histories, or the sums of one batch."""
    out = _table(_met(group))
    _release()
    return out


def _met(group: pa.Table) -> list[tuple]:
    part = group["part"][0].as_py()
    kinds, blobs = group["kind"].to_pylist(), group["blob"]
    if part >= 0:
        rows = [(part, "batch", part, blobs[i].as_py(), None) for i, k in enumerate(kinds) if k == "batch"]
        total = None
        # One order of summation, whatever order the rows come in.
        for x in sorted((_unpack(blobs[i].as_py()) for i, k in enumerate(kinds) if k == "docs"), key=lambda x: x["gain"].tobytes()):
            if total is None:
                total = {"base": np.zeros(x["docs"]), "gain": np.zeros(x["docs"]), "known": np.zeros(x["docs"], np.int64), "of_r": np.zeros((x["docs"], K), np.int64)}
            mine = np.cumsum(x["mine"], dtype=np.int64)
            for k, v in total.items():
                v[mine] += x[k].reshape(len(mine), *v.shape[1:])
        if total:
            total["of_r"] = total["of_r"].ravel()
            rows.append((part, "docs", part, _pack(**total), None))
        return rows
    rows = [(part, "counts", -1, None, x) for k, x in zip(kinds, group["nums"].to_pylist(), strict=True) if k == "counts"]
    stats = [_unpack(blobs[i].as_py()) for i, k in enumerate(kinds) if k == "histories"]
    asked = [_unpack(blobs[i].as_py()) for i, k in enumerate(kinds) if k == "backoffs"]
    if not stats or not asked:
        return rows
    h = np.concatenate([_from_gaps(x["h"]) for x in stats])
    mass = np.concatenate([x["mass"] for x in stats])
    n = np.concatenate([x["n"].astype(np.int64).reshape(-1, K + 1) for x in stats])
    order = np.lexsort((mass, h))
    h, mass, n = h[order], mass[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    h, mass, n = h[starts], np.add.reduceat(mass, starts), np.add.reduceat(n, starts, axis=0)
    batch = np.concatenate([x["which"][x["b_at"]] for x in asked])
    doc = np.concatenate([x["doc"].astype(np.int64) for x in asked])
    names = [_from_gaps(x["h"]) for x in asked]
    at = np.concatenate([np.searchsorted(h, n)[x["at"]] for n, x in zip(names, asked, strict=True)])
    name = np.concatenate([n[x["at"]] for n, x in zip(names, asked, strict=True)])
    known = (at < len(h)) & (h[np.minimum(at, len(h) - 1)] == name)
    batch, doc, at = batch[known], doc[known], at[known]
    order = np.lexsort((at, doc, batch))
    batch, doc, at = batch[order], doc[order], at[order]
    which, firsts = np.unique(batch, return_index=True)
    for b, s, e in zip(which, firsts, [*firsts[1:], len(batch)], strict=True):
        used, place = np.unique(at[s:e], return_inverse=True)
        rows.append((int(b), "backoffs", int(b), _pack(doc=_least(doc[s:e]), at=_least(place), mass=mass[used], n=_least(n[used].ravel())), None))
    return rows


def _finish(total: int, vocabulary: int, d: np.ndarray):
    """Step 4 for one batch, with the discounts of pairs."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(group: pa.Table) -> pa.Table:
        got = {"batch": [], "docs": [], "backoffs": []}
        for kind, blob in zip(group["kind"].to_pylist(), group["blob"], strict=True):
            got[kind].append(_unpack(blob.as_py()))
        head, sums = got["batch"][0], got["docs"][0]
        n = head["counts"].astype(np.int64)
        score = sums["gain"] + sums["of_r"].reshape(len(n), K) @ np.log10(d * np.arange(1, K + 1))
        for x in sorted(got["backoffs"], key=lambda x: x["mass"].tobytes()):
            left = x["n"].astype(np.float64).reshape(-1, K + 1) @ np.append((1 - d) * np.arange(1, K + 1), DELTA)
            weight = np.log10(left) - np.log10(np.maximum(1 - x["mass"], 1e-12))
            score = score + np.bincount(x["doc"], weights=weight[x["at"]], minlength=len(n))
        base = sums["base"] - n * np.log10(total + vocabulary + 1.0)
        return pa.table([head["ids"], pa.array(head["held_out"]), pa.array(n), pa.array(sums["known"]), pa.array(base), pa.array(score)], schema=schema)

    return finish


def score(docs: DataFrame, held_out) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs(doc_id, text)``.

    Trained on the rows where the condition ``held_out`` is false; scores are log10 probabilities of whole texts, ends included.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    words = cut(rows.mapInArrow(_count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    found = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *(F.count_if(F.col("c") == r) for r in range(1, K + 2))).first()
    total, vocabulary, n = int(found[0]), int(found[1]), [int(x) for x in found[2:]]
    d = discounts(n)
    small = sum((1 - d[r - 1]) * r * n[r - 1] for r in range(1, K + 1))
    unknown = (small + DELTA * (vocabulary - sum(n[:K]))) / total if total else 1.0
    parts = max(LEAST_PARTITIONS, -(-total * 7 // 6 // PER_PARTITION))
    hot = words.where(F.col("c") > max(1, total // (4 * parts))).collect()  # fewer than 4 * parts words
    hot_w = np.array([r.w for r in hot], np.int64).view(np.uint64)
    hot_c = np.array([r.c for r in hot], np.int64)
    packed = rows.mapInArrow(_occurrences(parts, hot_w), _ROWS_SQL).union(words.mapInArrow(_words_by_part(parts, hot_w), _ROWS_SQL))
    counted = packed.groupBy("part").applyInArrow(_count_pairs(parts, hot_w, hot_c, total, d, unknown), _ROWS_SQL)
    met = cut(counted.groupBy("part").applyInArrow(_meet_histories, _ROWS_SQL))
    n2 = met.where("kind = 'counts'").agg(*(F.coalesce(F.sum(F.col("nums")[r]), F.lit(0)) for r in range(K + 1))).first()
    d2 = discounts([int(x) for x in n2])
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = met.where("kind <> 'counts'").groupBy("batch").applyInArrow(_finish(total, vocabulary, d2), out)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
