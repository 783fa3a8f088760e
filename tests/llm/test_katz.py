"""The language model against one of dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkcatalog.llm import katz

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORDS.findall(lower), None]


def brute(rows):
    train = [tokens_of(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    uni, pairs = Counter(), Counter()
    for t in train:
        uni.update(t)
        pairs.update(zip([None, *t], t, strict=False))
    total, vocabulary = sum(uni.values()), len(uni)

    def of_counts(c):
        return katz.discounts([sum(1 for x in c.values() if x == r) for r in range(1, katz.K + 2)])

    d1, d2 = of_counts(uni), of_counts(pairs)
    disc = lambda c, d: c - katz.DELTA if c > katz.K else d[c - 1] * c
    p1 = {w: disc(c, d1) / total for w, c in uni.items()}
    unknown = 1 - sum(p1.values()) if total else 1.0
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c
    contexts = {h: sum(x.values()) for h, x in after.items()}

    def p(w, h):
        if h not in after:
            return p1.get(w, unknown)
        seen = after[h]
        if w in seen:
            return disc(seen[w], d2) / contexts[h]
        left = 1 - sum(disc(c, d2) for c in seen.values()) / contexts[h]
        return left / (1 - sum(p1[x] for x in seen)) * p1.get(w, unknown)

    out = {}
    for i, t in rows:
        ts = tokens_of(t)
        out[i] = (len(ts), sum(w in uni for w in ts), sum(math.log10((uni[w] + 1) / (total + vocabulary + 1)) for w in ts), sum(math.log10(p(w, h)) for h, w in zip([None, *ts], ts, strict=False)))
    return out, total, (p, uni, after)


def test_discounts_are_simple_good_turing():
    """Against the published recipe: a line through log counts of counts by numpy's own fit, Turing's estimate while it differs significantly, Katz's form."""
    rng = np.random.default_rng(3)
    cases = [[60000, 9000, 3500, 2000, 1100, 800], [10**6, 120_000, 40_000, 26_000, 20_000, 12_000], [900, 300, 140, 90, 60, 44], [5, 9, 20, 30, 1, 1], [3, 0, 1, 0, 0, 0], [7, 0, 0, 0, 0, 0], [0] * 6]
    cases += [sorted(rng.integers(1, 10_000, 6).tolist(), reverse=True) for _ in range(40)]
    turing_used = 0
    for n in cases:
        seen = [(math.log(r), math.log(c)) for r, c in enumerate(n, 1) if c]
        slope = min(-1.1, np.polyfit(*zip(*seen, strict=True), 1)[0]) if len(seen) > 1 else -1.1
        line = lambda r, slope=slope: r * ((r + 1) / r) ** (slope + 1)
        top = 6 ** (slope + 1)
        adjusted, on = [], False
        for r in range(1, 6):
            on = on or n[r - 1] == 0 or n[r] == 0
            if not on:
                turing = (r + 1) * n[r] / n[r - 1]
                on = abs(turing - line(r)) <= 1.65 * math.sqrt((r + 1) ** 2 * n[r] / n[r - 1] ** 2 * (1 + n[r] / n[r - 1]))
            good = not on and top < turing / r < 1
            turing_used += good
            adjusted.append(turing if good else line(r))
        want = [(a / r - top) / (1 - top) for r, a in enumerate(adjusted, 1)]
        got = katz.discounts(n)
        assert got == pytest.approx(want, rel=1e-9) and all(0 < d < 1 for d in got)
    assert turing_used > 20


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def compare(spark, rows, parts=1):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r for r in katz.score(docs, held_out()).collect()}
    want, total, model = brute(rows)
    assert len(got) == len(want)
    for i, (n, known, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9)
    return model


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    rows = [(i, " ".join(rng.choice(names, rng.integers(0, 60), p=share / share.sum()))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "The THE\tthe\x0bthe  É é new words only here"), (n + 3, "x " * 5000)]


def test_scores_equal_those_of_dictionaries(spark):
    compare(spark, corpus(120), parts=3)


def test_probabilities_sum_to_one(spark):
    p, uni, after = brute(corpus(120))[2]
    for h in list(after)[:20]:
        assert sum(p(w, h) for w in uni) + p("never seen", h) == pytest.approx(1, abs=1e-9)


def test_small_and_odd_tables(spark):
    compare(spark, [(0, "a b a b c")])
    compare(spark, [(i, "same words here") for i in range(9)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(empty, held_out()).collect() == []
    rows = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (3, "a b", 3)], "doc_id long, text string, score int")
    got = katz.score(rows, held_out()).collect()
    assert sorted((r.doc_id is None, r.held_out) for r in got) == [(False, False), (True, True), (True, True)]


def test_many_partitions_and_batches(spark, monkeypatch):
    monkeypatch.setattr(katz, "LEAST_PARTITIONS", 5)
    compare(spark, corpus(200, seed=4), parts=4)


def test_tokenizer_splits_as_the_pattern():
    texts = ["", None, " a", "b ", "Aa aA", "é\x0bÉ", "a b", "\t\n"]
    hashes, counts = katz.Tokenizer()(pa.array(texts))
    names = [w for t in texts for w in tokens_of(t)]
    assert counts.tolist() == [len(tokens_of(t)) for t in texts]
    assert len({*zip(names, hashes.tolist(), strict=True)}) == len(set(names)) == len(set(hashes.tolist()))
