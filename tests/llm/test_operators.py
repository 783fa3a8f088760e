"""Each operator against a brute-force version, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import html as entities
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chunkcatalog.llm import ann, chat, decontam, langid, mix, pii, simhash, warc
from chunkcatalog.llm import html as html_op
from chunkcatalog.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, columns)


def some_texts(n, seed=0, least=1, most=60):
    rng = random.Random(seed)
    return [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(rng.randint(least, most))) for _ in range(n)]


# ---- components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 50)] + [(7, 7), (1, 2), (1, 2), (2, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got)
    assert {x for a, b in edges if a != b for x in (a, b)} <= set(got) | {find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 WARC


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, extra string, block string")


def test_revisits(spark):
    u = "HTTP://www.Example.com:80/a/?utm_source=x&b=2&a=1#frag"
    rows = [
        (1, "https://example.com/a?a=1&b=2", 10, "response", 200, '"v1"', "d1", None, {"Content-Type": "text/html", "Server": "s", "cache-control": "old"}, "", ""),
        (2, u, 20, "revisit", 304, 'W/"v1"', None, None, {"Cache-Control": "new", "Content-Length": "0", "Connection": "close"}, "", ""),
        (3, u, 10, "revisit", 304, '"v1"', None, None, None, "", ""),
        (4, u, 30, "response", 200, '"v2"', "d2", None, None, "", ""),
        (5, u, 30, "response", 200, '"v3"', "d3", None, None, "", ""),
        (6, u, 31, "revisit", 304, '"v1"', None, None, None, "", ""),
        (7, u, 32, "revisit", 304, None, "d3", None, None, "", ""),
        (8, u, 32, "revisit", 304, None, None, "x", None, "", ""),
        (9, None, 32, "revisit", 304, None, None, None, None, "", ""),
        (10, u, 33, "response", 404, '"v9"', None, None, None, "", ""),
        (11, u, 34, "revisit", 304, '"v3"', None, None, None, "", ""),
        (11, u, 34, "revisit", 304, '"v3"', None, None, None, "", ""),
        (12, "http://other/", 99, "revisit", 304, '"v3"', None, None, None, "", ""),
        (13, u, None, "revisit", 304, '"v3"', None, None, None, "", ""),
        (14, u, 40, "request", None, None, None, None, None, "", ""),
    ]
    got = sorted((r.record_id, r.target_id or 0, r.outcome) for r in warc.resolve(records(spark, rows)).collect())
    assert got == [(2, 1, "resolved"), (3, 0, "orphan"), (6, 5, "mismatch"), (7, 5, "resolved"), (8, 5, "unverified"), (9, 0, "orphan"), (11, 5, "resolved"), (11, 5, "resolved"), (12, 0, "orphan"), (13, 0, "orphan")]
    merged = warc.resolve(records(spark, rows)).where("record_id = 2").first().headers
    assert merged == {"content-type": "text/html", "server": "s", "cache-control": "new"}
    assert warc.resolve(records(spark, [])).count() == 0


def test_revisits_over_many_blocks_of_one_url(spark):
    rng = random.Random(5)
    rows = [(i, "http://hot/", rng.randint(0, 5000), "response" if rng.random() < 0.05 else "revisit", 200, '"t"', None, None, None, "", "") for i in range(800)]
    full = [(r[2], r[0]) for r in rows if r[3] == "response"]
    want = {r[0]: max((x for x in full if x[0] < r[2]), default=(0, None))[1] for r in rows if r[3] == "revisit"}
    assert {r.record_id: r.target_id for r in warc.resolve(records(spark, rows)).collect()} == want


# ---- 2 mixing


def water_fill(sizes, weights, share, cap):
    total, target, free = share * sum(sizes), {}, set(range(len(sizes)))
    left = total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if w and left * weights[i] / w > cap * sizes[i]]
        if not over:
            target |= {i: left * weights[i] / w for i in free}
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            free.discard(i)
    return target


def test_mix(spark):
    texts = some_texts(300, 1)
    rows = [(i, t, "en", None if i % 10 == 0 else f"s{min(i % 7, 4)}", 0) for i, t in enumerate(texts)] + [(900, None, "en", "s1", 0), (901, "", "en", "s1", 0), (902, "w " * 3000, "en", "é", 0), (5, texts[5], "en", "s4", 0), (903, None, "en", "zero", 0)]
    table = docs(spark, rows, "doc_id long, text string, lang string, source string, size long")
    got = mix.mixed_documents(table, block=16).collect()
    assert len(got) == len(rows)
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    sizes = [sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == n) for n in names]
    want = water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for i, n in enumerate(names):
        mine = [r for r in got if r.source == n]
        assert all(r.source_size == sizes[i] and r.target == pytest.approx(want[i]) for r in mine)
        assert sum(r.taken for r in mine) == int(want[i] + 1e-9)
    assert all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix.mixed_documents(table.repartition(7), block=16).collect()), key=str)
    assert mix.mixed_documents(docs(spark, [])).count() == 0
    assert [r.taken for r in mix.mixed_documents(docs(spark, [(1, None, "", "a", 0)])).collect()] == [0]
    few = mix.taken_documents(docs(spark, [(1, "a b c", "en", "a", 5), (2, None, "en", "a", 0)]))
    assert few.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and few.count() == 1


def test_schedule_is_low_discrepancy(spark):
    plan = spark.createDataFrame([("a", 3000.0), ("b", 1000.0), ("c", 2000.0)], "source string, target double")
    slots = mix.schedule(plan, 10).where("slot is not null").collect()
    for n in (60, 300, 600):
        seen = Counter(r.source for r in slots if r.slot < n)
        assert all(abs(seen[s] - n * w / 6) <= 3 for s, w in (("a", 3), ("b", 1), ("c", 2)))
    for s in "abc":
        ranks = sorted(r["rank"] for r in slots if r.source == s)
        assert ranks == list(range(len(ranks)))


# ---- 4 PII

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(x := re.sub("[^0-9]", "", m)) <= 19 and luhn(x)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m.group()))


def test_base_spans(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "_x@d-e.f.g", "@", ".", " ", "-", "+", "1", "22", "333.4", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "007.0.0.1", "4417744280351547", "4417 7442 8035 1547", "4111-1111-1111-1111", "+49 (30) 123-4567-89", "+1 2", "é", "ü@x.y", "%", "\n", "(", ")", "4", "word", "A@B@c.d"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    texts += [None, "", "a" * 50_000, "1" * 30_000, "1 " * 20_000, "a@b.c " * 500, "+" + "1-" * 5000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0)]
    got = pii.report(pii.find(docs(spark, rows, "doc_id long, text string, base string, row string, n_email long"))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(texts[r.doc_id])
        said = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), texts[r.doc_id][:200]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(1 for s in want if s[1] == k) for k in range(4))
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert pii.find(docs(spark, [])).count() == 0


def test_telling_terms_are_removed(spark):
    """A code name that only ever stands near one address tells it; common words and other texts stay."""
    filler = some_texts(200, 3, 8, 12)
    rows = [(i, f"the {t}", "en", "s", 0) for i, t in enumerate(filler)]
    rows += [(1000 + i, f"the {filler[i]} ask Bluebird at ann.lee@corp.example.org the {filler[i + 20]}", "en", "s", 0) for i in range(6)]
    rows += [(2000 + i, f"the {filler[30 + i]} sometimes Redwing at bob@corp.example.org the", "en", "s", 0) for i in range(4)] + [(3000 + i, f"the {filler[40 + i]} Redwing the", "en", "s", 0) for i in range(60)]
    rows += [(4000, "unique Greenfinch near zoe@corp.example.org once", "en", "s", 0)] * 5
    table = docs(spark, rows)
    out = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert pii.sanitise(table).columns == table.columns and pii.sanitise(table).count() == len(rows)
    assert all("Bluebird" not in out[1000 + i] and "[EMAIL]" in out[1000 + i] and "the" in out[1000 + i].split() for i in range(6))
    assert all("Redwing" in out[2000 + i] for i in range(4))  # it stands in many other texts
    assert "Greenfinch" in out[4000]  # copies of one context are no evidence
    assert all(out[i] == rows[i][1] for i in range(200))
    found = {r.doc_id: r for r in pii.report(pii.find(table)).collect()}
    text = next(r[1] for r in rows if r[0] == 1000)
    a = text.index("Bluebird")
    assert f"term:{a}:{a + 8}" in found[1000].spans.split(",")


def slow_terms(rows, least, remove_at):
    """Term spans by brute force: ``{(doc_id, start, end): act}`` of ``rows(doc_id, text)``."""
    held, n_c, n_t, seen = {}, Counter(), Counter(), {}
    for n, (_, text) in enumerate(rows):
        words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "")]
        for w in {w for w, _, _ in words}:
            n_t[w] += 1
        kinds = {k for _, k, _ in base_spans(text)}
        for k in kinds:
            n_c[k] += 1
        if kinds:
            held[n] = (words, kinds)
    for n, (words, kinds) in held.items():
        for i, (w, _, _) in enumerate(words):
            around = tuple(words[i + d][0] if 0 <= i + d < len(words) else "" for d in (-2, -1, 1, 2))
            for k in kinds:
                docs_, contexts = seen.setdefault((k, w), (set(), set()))
                docs_.add(n)
                contexts.add(around)
    share = {}
    for (k, w), (docs_, contexts) in seen.items():
        if n_c[k] < len(rows):
            pmi = np.log2(len(rows) * len(docs_) / (n_c[k] * n_t[w]))
            m, s = min(n_c[k], n_t[w]), len(contexts)
            share[k, w] = pmi / np.log2(len(rows) / n_c[k]) * s / (s + 1) * m / (m + 1)
    out = {}
    for n, (words, kinds) in held.items():
        taken = base_spans(rows[n][1])
        for w, a, b in words:
            best = max(share.get((k, w), 0) for k in kinds)
            if best >= least - 1e-12 and not any(x < b and a < y for x, _, y in taken):
                out[rows[n][0], a, b] = "remove" if best >= remove_at - 1e-12 else "generalise"
    return out


def test_every_added_span_by_brute_force(spark):
    rng = random.Random(21)
    common = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = rng.choices(common, k=rng.randint(3, 20))
        if i % 6 == 0:
            words.insert(rng.randint(0, len(words)), f"user{i}@host.example")
            words += rng.sample(["Secretname", "cardholder", "w1"], 2)
        if i % 10 == 0:
            words.insert(0, f"10.0.{i % 250}.7")
            words.append("gateway")
        if i % 25 == 1:
            words.append("cardholder")
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, s.start, s.end): s.act for r in pii.find(table).collect() for s in r.terms}
    want = slow_terms(rows, pii.GENERALISE_AT, pii.REMOVE_AT)
    assert got == want and {"remove", "generalise"} == set(want.values())


def test_generalisation_takes_a_more_frequent_beginning(spark):
    filler = some_texts(120, 5, 6, 9)
    rows = [(i, f"{t} account number") for i, t in enumerate(filler)] + [(1000 + i, f"{filler[i]} accountholder {filler[i + 9]} mail a{i}@b.cc") for i in range(3)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(" account " in out[1000 + i] and "accountholder" not in out[1000 + i] for i in range(3))


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.example" for i in range(10_000))
    rows = spark.createDataFrame([(1, text), (2, "plain"), (1, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = pii.report(pii.find(rows)).collect()
    out = pii.sanitise(rows).collect()
    assert time.perf_counter() - began < 120
    assert sorted(r.n_email for r in got) == [0, 10_000, 10_000]
    assert sorted(r.text for r in out) == sorted(["plain", *[" ".join(["[EMAIL]"] * 10_000)] * 2])


def test_sanitise_keeps_null_and_plain_text(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "plain", "en", "s", 0), (None, "mail a@b.cc now", "en", "s", 0), (4, "card +4417744280351547 x", "en", "s", 0)]
    out = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert out == {1: None, 2: "", 3: "plain", None: "mail [EMAIL] now", 4: "card +[CARD] x"}


# ---- 5 chats


def test_chats(spark):
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[INST] ", " [/INST]", "<", "[", "\\", "/s>", "hi", " ", "\n", "<\\/s>", "[\\\\INST]", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[INST] odd", "a</s>b"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for c in range(150) for t in range(rng.randint(1, 5))]
    rows += [(500, 0, "user", None), (500, 1, None, "x"), (500, 1, None, "x"), (500, 1, "assistant", "b"), (500, None, "assistant", "a"), (None, 0, "assistant", "no id"), (600, 0, "assistant", "long " * 40_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, source string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(table)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(table.limit(0)).count() == 0


def test_only_conflicting_chats_are_escaped(spark):
    table = spark.createDataFrame([(1, 0, "user", "plain [text] <b>"), (2, 0, "user", "a </s> b")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert not got[1].escaped and got[1].formatted == "<s>user[INST] plain [text] <b> [/INST]</s>"
    assert got[2].escaped and got[2].formatted == "<s>user[INST] a <\\/s> b [/INST]</s>"


def test_the_parser_rejects_what_is_no_sentence(spark):
    good = "<s>user[INST] hi [/INST]</s>"
    bad = ["XXXuser[INST] hi!!!!!!!!</s>", good + "trailing", "junk" + good, "<s>user[INST] [/INST]</s>", "<s>user hi [/INST]</s>", "<s>user[INST] hi</s>", "<s>us<s>er[INST] hi [/INST]</s>", "<s>user[INST] a [INST] b [/INST]</s>", "hi", good[:-1]]
    cases = [good, "", good * 2, "<s>[INST]  [/INST]</s>", *bad]
    got = {r.s: r.p for r in spark.createDataFrame([(c,) for c in cases], "s string").select("s", chat.parse(F.col("s")).alias("p")).collect()}
    assert got[good] == [("user", "hi")] and got[""] == [] and len(got[good * 2]) == 2 and got["<s>[INST]  [/INST]</s>"] == [("", "")]
    assert all(got[b] is None for b in bad)


# ---- 6 SimHash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(8)
    texts = some_texts(120, 5, 1, 80)
    rows = [(i + 10, t, "en", "s", 0) for i, t in enumerate(texts)]
    for i in range(60):
        words = texts[rng.randint(0, 119)].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words).upper(), "en", "s", 0))
    base = " ".join(some_texts(1, 6, 60, 60)).split()
    rows += [(400 + i, " ".join([*base[:i], "x", *base[i + 1 :]]), "en", "s", 0) for i in range(60)]  # a dense group of near copies
    rows += [(5, None, "en", "s", 0), (4, "", "en", "s", 0), (6, " \n", "en", "s", 0), (7, "one", "en", "s", 0), (8, "one two", "en", "s", 0), (10, texts[0], "en", "s", 0), (None, texts[1], "en", "s", 0), (9, "long " * 30_000, "en", "s", 0)]
    fps = [slow_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), 10**9), r[0])
    want = sorted(((r[0] or -1, f"{fps[k]:016x}", least[find(k)]) for k, r in enumerate(rows)))
    table = docs(spark, rows, "doc_id long, text string, fp string, fingerprint string, component_id long")
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect()) == want
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one_keeps_a_row_of_each_group(spark):
    """Groups of null ids, and one id over several texts, lose no group and leave no copy."""
    a, b, c, d = some_texts(4, 91, 40, 40)
    kept = lambda rows: sorted((r.doc_id or -1, r.text) for r in simhash.keep_one(docs(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect())
    assert kept([(None, a), (None, b), (None, b), (5, c)]) == sorted([(-1, a), (-1, b), (5, c)])
    assert kept([(None, a), (None, c), (5, c)]) == sorted([(-1, a), (5, c)])
    assert kept([(7, a), (7, b), (7, b), (3, d), (7, d)]) == sorted([(7, a), (7, b), (3, d)])


def test_keep_one_similar(spark):
    """Against all pairs, with groups of near copies about the threshold, long lists, copies and empty texts."""
    rng = random.Random(31)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(some_texts(60, 41, 1, 80))]
    for g in range(12):
        base = some_texts(1, 700 + g, 60, 100)[0].split()
        for _ in range(25 if g == 0 else 4):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 99)}"
            rows.append((100 + len(rows), " ".join(words), "en", "s", 0))
    rows += [(900, "", "en", "s", 0), (901, None, "en", "s", 0), (None, rows[5][1], "en", "s", 0), (None, "alone of all", "en", "s", 0)]
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    beyond = 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                beyond += (slow_fingerprint(rows[a][1]) ^ slow_fingerprint(rows[b][1])).bit_count() > 3
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    want = {}
    for k, r in enumerate(rows):
        want[root[k]] = min(want.get(root[k], 10**9), 10**9 if r[0] is None else r[0])
    table = docs(spark, rows)
    got = simhash.keep_one_similar(table, shingle_words=5, least=0.8)
    assert got.columns == table.columns and beyond > 20
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in got.collect()) == sorted(want.values())


def test_near_copies_that_are_not_similar_make_no_square_of_pairs(spark, monkeypatch):
    """Many changed copies of one text, most below the threshold: groups as by brute force, candidates in proportion to rows."""
    made = []

    def counted(rows, reps, pairs, *args):
        made.append(pairs.count())
        return verified(rows, reps, pairs, *args)

    verified = simhash._verified
    monkeypatch.setattr(simhash, "_verified", counted)
    rng = random.Random(17)
    vocabulary = " ".join(some_texts(6, 91, 200, 200)).split()
    line = " ".join(vocabulary[:9])
    base = rng.choices(vocabulary, k=120)
    texts = []
    for _ in range(500):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.1:
            cut = rng.randrange(60)
            del words[cut : cut + rng.randint(5, 30)]
        texts.append(" ".join(words))
    for t in texts[300:340]:  # copies of what may be beyond the threshold of all others
        words = t.split()
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += [f"{line} {' '.join(rng.choices(vocabulary, k=14))}" for _ in range(200)]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    want = sorted(set(root))
    got = simhash.keep_one_similar(docs(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)]), shingle_words=5, least=0.8)
    assert sorted(r.doc_id for r in got.collect()) == want and 250 < len(want) < len(texts) - 100
    assert sum(made) < 20 * len(texts)


def test_forest_spans_without_all_pairs():
    near = np.array([1 << i for i in range(40)] + [0], dtype=np.int64)
    assert len(simhash._forest(near, 3)) == 40


# ---- 7 decontamination


def test_decontamination(spark):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    rng = random.Random(12)
    items = [(i, t) for i, t in enumerate(some_texts(25, 20, 12, 50))] + [(100, "only three words"), (101, ""), (102, None), (103, "same same same same same same same same same"), (104, "single")]
    rows = []
    for i in range(120):
        own = some_texts(1, 100 + i, 20, 120)[0].split()
        item = items[rng.randrange(25)][1].split()
        edits = rng.randint(0, 3) if i % 3 else 0
        for _ in range(edits):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 1)] = ["edit"] if rng.random() < 0.7 else []
        at = rng.randint(0, len(own))
        if i % 4:
            own[at:at] = item
        rows.append((i, ", ".join(own).upper() if i % 5 == 0 else " ".join(own), "en", "s", 0))
    rows += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, "these only three words here", "en", "s", 0), (503, "same " * 3000, "en", "s", 0), (504, "single", "en", "s", 0), (0, rows[0][1], "en", "s", 0), (None, items[3][1], "en", "s", 0)]
    want = {}
    for i, t in {(r[0], r[1]) for r in rows}:
        w = words(t)
        for item, x in items:
            v = words(x)
            if not v:
                continue
            k = min(5, len(v))
            b = Counter(grams(v, k))
            best = 0
            for s in range(max(1, len(w) - len(v) + 1)):
                a = Counter(grams(w[s : s + len(v)], k))
                shared = sum((a & b).values())
                best = max(best, shared / max(1, sum(a.values()) + sum(b.values()) - shared))
            if best >= 0.8:
                want[i, item] = best
    table = docs(spark, rows, "doc_id long, text string, row string, words string, n_words long")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(table, bench).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(v < 1 for v in want.values())
    kept = decontam.clean(table, bench)
    dirty = {i for i, _ in want}
    assert kept.columns == table.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in dirty)
    assert decontam.clean(table, bench.limit(0)).count() == len(rows)
    assert decontam.contaminated(docs(spark, []), bench).count() == 0


def test_every_text_of_an_item_is_searched(spark):
    """Texts that share an item_id, or have none, are each found; of one item the best window is reported."""
    a, b, c, d = some_texts(4, 78, 30, 30)
    table = docs(spark, [(1, f"x {a}", "en", "s", 0), (2, f"x y {b}", "en", "s", 0), (3, f"z {c}", "en", "s", 0), (4, f"z z {d}", "en", "s", 0), (5, "nothing of it here at all", "en", "s", 0), (6, f"{a} {b}", "en", "s", 0)])
    bench = spark.createDataFrame([(9, a), (9, b), (9, b), (None, c), (None, d)], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.start, r.similarity) for r in decontam.contaminated(table, bench).collect()]
    assert sorted(got, key=lambda r: r[0]) == [(1, 9, 1, 1.0), (2, 9, 2, 1.0), (3, None, 1, 1.0), (4, None, 2, 1.0), (6, 9, 0, 1.0)]
    assert [r.doc_id for r in decontam.clean(table, bench).collect()] == [5]


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    text = some_texts(1, 77, 30, 30)[0]
    table = docs(spark, [(1, f"start {text} end", "en", "s", 0), (2, "nothing here at all of it", "en", "s", 0)])
    got = decontam.contaminated(table, spark.createDataFrame([(9, text)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in got] == [(1, 9, 1, 1.0)]


def test_decontamination_broadcasts_no_lists_and_shuffles_no_clean_text(spark, monkeypatch):
    """What is broadcast has rows of a fixed size, and rows without a match are not shuffled to be kept."""
    asked = []
    bounded = decontam._bounded
    monkeypatch.setattr(decontam, "_bounded", lambda df: asked.append(dict(df.dtypes)) or bounded(df))
    text = some_texts(1, 78, 30, 30)[0]
    table = docs(spark, [(i, f"start {text} end" if i % 50 == 0 else f"nothing {i}", "en", "s", 0) for i in range(200)] + [(None, None, "en", "s", 0)] * 2)
    kept = decontam.clean(table, spark.createDataFrame([(9, text)], "item_id long, text string"))
    assert not [kind for columns in asked for kind in columns.values() if "array" in kind]
    assert "row" in asked[-1] and "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in range(200) if i % 50] and kept.where("doc_id IS NULL").count() == 2


# ---- 8 nearest neighbours


def test_permutation_index_recall(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 32))
    v *= rng.uniform(0.5, 1.5, size=(3000, 1))
    v[100:140] = v[7]
    rows = [(i, [float(x) for x in np.float32(r)], 0, 1.0) for i, r in enumerate(v)]
    rows += [(5000, None, 0, 1.0), (5020, [0.0] * 32, 0, 1.0), (5040, [1.0] * 31 + [None], 0, 1.0), (5060, [1.0] * 31 + [float("nan")], 0, 1.0), (5080, [1.0] * 31 + [float("inf")], 0, 1.0), (5100, [1.0, 2.0], 0, 1.0), (None, [1.0] * 32, 0, 1.0), (60, [float(x) for x in np.float32(v[60])], 0, 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")
    got = ann.search(table, F.col("vec_id") % 20 == 0, k=10, block=50, query_block=8).collect()
    x = np.float32(v).astype(np.float64)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        s = x @ x[q]
        assert all(r.vec_id != q and r.score == pytest.approx(s[r.vec_id], rel=1e-12) for r in found)
        s[q] = -np.inf
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(3000), -s))[:10].tolist()))
    assert hits / (10 * len(by)) >= 0.9


def test_permutation_index_repeated_ids_and_copies(spark):
    """Rows of one vec_id with other vectors stay candidates; a repeated row is one; of many copies the smallest ids come."""
    rows = [(0, [1.0, 0.0])] * 2 + [(0, [0.9, 0.1]), (1, [0.5, 0.5]), (7, [0.8, 0.0])] + [(100 + i, [2.0, 0.0]) for i in range(200)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=30).collect()
    assert {r.query_id for r in got} == {0}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(100 + i, pytest.approx(1.8)) for i in range(30)]
    every = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=500).collect()
    assert len(every) == 203 and sum(r.vec_id == 0 for r in every) == 1  # the asked vector is the smaller one, [0.9, 0.1]
    many = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 100, k=3).collect()
    best = {}
    for r in sorted(many, key=lambda r: r["rank"]):
        best.setdefault(r.query_id, []).append(r.vec_id)
    assert all(best[q] == [i for i in range(100, 104) if i != q][:3] for q in range(100, 300))


def test_permutation_index_small_tables(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(table.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0


# ---- 9 language ID


def language_rows(n, seed=0):
    rng = random.Random(seed)
    parts = {"en": ["the", "th", "ing", "and", "of", "er"], "de": ["sch", "ung", "ü", "ei", "der", "ß"], "fr": ["eau", "é", "le", "tion", "que", "è"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(parts))
        out.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 200))), lang))
    return out


def test_language_id(spark):
    rows = language_rows(400)
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 456 !!", "en"), (1003, "the " * 60_000, "en"), (None, "the thing and", None), (0, rows[0][1], rows[0][2])]
    table = spark.createDataFrame([(*r, 7.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(table.where(~langid.held_out("doc_id")))
    got = langid.predict(table.withColumn("held_out", langid.held_out("doc_id")), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    right = [r.lang_pred == r.lang for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(right) / len(right) >= 0.95
    odd = {r.doc_id: r.lang_pred for r in got if r.doc_id is not None and r.doc_id >= 1000}
    assert odd == {1000: "und", 1001: "und", 1002: "und", 1003: "en"}
    kept = langid.reject(table)
    assert not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in langid.predict(table, None).collect()} == {"und"}
    assert langid.fit(table.limit(0)) is None and langid.predict(table.limit(0), model).count() == 0


def test_letters_and_rare_languages(spark):
    rows = [(i, t, lang) for i, t, lang in language_rows(300)] + [(5000 + i, "ωμεγα αλφα βητα " * 5, "el") for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table, max_rows=40)
    assert "el" in model["names"]
    odd = spark.createDataFrame([(1, "½ ² ① 12"), (2, "Ⅷ"), (3, "ª")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(odd, model).collect()} == {1: True, 2: True, 3: False}


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (20, langid.WINDOW)).astype(np.uint8)
    p = langid.train(x, rng.integers(0, 3, 20), 3, epochs=1)
    patches = p["embed"][np.lib.stride_tricks.sliding_window_view(x, langid.TAPS, axis=1)].reshape(20, -1, langid.TAPS * langid.EMBED)
    active = np.maximum((patches @ p["conv"]).max(axis=1) + p["bias"], 0)
    logits = active @ p["out"] + p["out_bias"]
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(langid.window_probabilities(x, p, langid.pair_tables(p)), want, atol=1e-4)


# ---- 10 HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><div>Site name</div></header><nav><ul><li><a href="/">Home</a></li><li><a href='x>y'>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><div id="content"><article><header><h1>A &amp; B</h1></header>
<p>First &lt;p&gt; para\tgraph<br>goes on. <b>Bold</b> text &eacute;.<p>Short.</p><div class="ad">Buy now!</div><ul><li>One<li>Two</ul>
<!-- <p>comment</p> --><form><p>Name</p><textarea><p>in</p></textarea><button>Send</button></form>
<table><tr><td>cell 1<td>cell 2</table></article><section class="comments"><h2>Comments</h2><p>Great article, I liked it very much, thanks a lot for it!</p></section></div>
<aside>Related stories</aside><footer>&copy; 2024 Somebody</footer></body></html>"""


def test_html():
    assert html_op.main_text(PAGE).split("\n") == ["A & B", "First <p> para graph goes on. Bold text é.", "Short.", "One", "Two", "cell 1", "cell 2"]


def test_html_without_article():
    long = "This is a long sentence with many words that tells a story about something, and it ends here. "
    page = f'<body><div><a href="/">Home</a> <a href="/b">About us</a></div><div><h1>Title of it</h1><p>{long * 3}</p><p>{long * 2}</p><p>Tiny.</p><p>{long}</p></div><div class="footer">Imprint</div></body>'
    got = html_op.main_text(page).split("\n")
    assert got[0] == "Title of it" and "Tiny." in got and len(got) == 5


def test_html_odd_pages(spark):
    cases = [(1, None, ""), (2, "", ""), (3, "just text", "just text"), (4, "<article><p>cut off <b>here", "cut off here"), (5, "<article><p>a < b &amp c<p>x &unknown; y</article><footer>f</fo", "a < b & c\nx &unknown; y"), (6, "<script>never closed <p>x", ""), (7, "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), (8, "<article>" + "<p>para</p>" * 2000 + "</article>", "\n".join(["para"] * 2000)), (9, "<!-- open", ""), (3, "just text", "just text")]
    table = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h, _ in cases], "page_id long, url string, html string, text string")
    got = html_op.extract(table).collect()
    want = {i: t for i, _, t in cases}
    assert len(got) == len(cases)
    for r in got:
        assert (r.text, r.n_chars, r.url) == (want[r.page_id], len(want[r.page_id]), f"u{r.page_id}")
    assert html_op.extract(table.limit(0)).count() == 0


def test_minimum_cut_is_the_best_labelling():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i - 1, i, rng.uniform(0, 2)) for i in range(1, n)] + [(rng.randrange(n), rng.randrange(n), 0.5) for _ in range(n // 2)]
        edges = [e for e in edges if e[0] != e[1]]

        def cost(keep, scores=scores, edges=edges):
            return sum(s if s > 0 and not k else -s if s < 0 and k else 0 for s, k in zip(scores, keep, strict=True)) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_op.minimum_cut(scores, edges)) == pytest.approx(best)


def test_entities_are_decoded_once():
    assert html_op.main_text("<article><p>&amp;lt;b&amp;gt; &#233;&nbsp;x</p></article>") == entities.unescape("&amp;lt;b&amp;gt;") + " é x"


def test_html_of_content_systems():
    p = "Some words make a sentence here, and then it goes on for a while to be long enough. "
    cases = [
        (f'<nav><a href="/">Home</a></nav><article class="post-12 type-post category-legal tag-social"><p>{p}</p><p>Short.</p></article>', [p.strip(), "Short."]),
        (f'<article><p>{p}</p><div title="the hidden truth"><p>Inner.</p></div><div data-id="sidebar"><p>More.</p></div></article>', [p.strip(), "Inner.", "More."]),
        (f"<article><p title=it's>Hello there.</p><p>{p}</p></article>", ["Hello there.", p.strip()]),
        (f'<form id="aspnetForm"><div class="menu"><a href=x>a</a></div><article><p>{p}</p></article></form>', [p.strip()]),
        (f'<form action="/p"><h1>Title</h1><div><p>{p}</p><p>{p}</p></div></form>', ["Title", p.strip(), p.strip()]),
        (f'<article class="teaser">{p}</article><article><p>{p}</p><p style="display: none">{p}</p><p hidden>{p}</p></article>', [p.strip()]),
        (f'<article><p data-x="a>b" class=\'x\'>{p}</p><p class="unfinished>{p}', [p.strip()]),
    ]
    for page, want in cases:
        assert html_op.main_text(page).split("\n") == want, page


def test_the_cut_decides():
    """Edges change labels: a doubtful block between content follows it, and fewer made pages are labelled wrongly than without edges."""
    rng = random.Random(5)
    alone = together = 0
    for _ in range(120):
        page, truth = html_op.training_page(rng)
        blocks = html_op.blocks_of(page)
        scores = html_op.evidence(blocks)
        assert len(blocks) == len(truth)
        alone += sum((s > 0) != t for s, t in zip(scores, truth, strict=True))
        together += sum(k != t for k, t in zip(html_op.minimum_cut(scores, html_op.smoothness(blocks)), truth, strict=True))
    assert together < alone < 40


def test_html_deep_and_long_pages():
    began = time.perf_counter()
    html_op.main_text("<div>" * 20_000 + "x" + "</span></p></td>" * 20_000 + "</div>" * 20_000)
    text = html_op.main_text("<article>" + "<p>Some words here.</p>" * 30_000 + "</article>" + '<div class="ad">Buy</div>' * 5000)
    assert text == "\n".join(["Some words here."] * 30_000) and time.perf_counter() - began < 30


def test_html_of_other_templates():
    p = "Some words make a sentence here, and then it goes on for a while to be long enough. "
    cases = [
        (f'<div id="header">My Site</div><div class="menu"><a href=x>a</a></div><div class="post"><h2>Title</h2><div>{p}</div></div><div class="comment-list"><p>{p}</p></div><div id="footer">(c) me</div>', ["Title", p.strip()]),
        (f'<div class="site-header"><h1>Site</h1></div><main><h1>Title</h1><p>{p}</p><figure><img><figcaption>Cap.</figcaption></figure><pre>a  b</pre></main><div role="complementary">{p}</div>', ["Title", p.strip(), "Cap.", "a b"]),
        (f"<body><p>{p}</p><p>Short one.</p></body>", [p.strip(), "Short one."]),
        (f'<div class="alert alert-info">{p}</div><article><p>{p}</p><div class="newsletter-signup">{p}</div><aside>{p}</aside><p>End.</p></article><section id="comments"><article class="comment"><p>{p}</p></article></section>', [p.strip(), "End."]),
    ]
    for page, want in cases:
        assert html_op.main_text(page).split("\n") == want
