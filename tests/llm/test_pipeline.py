"""The pipeline over a small folder, against what each stage should keep."""

import random

import corpus_pipeline
from chunkcatalog.llm import queries
from test_operators import WORD, language_rows, some_texts, water_fill


def folder(spark, tmp_path):
    rng = random.Random(3)
    clean = [(i, t, lang, f"s{i % 4}") for i, t, lang in language_rows(240, 7)]
    item = " ".join(some_texts(1, 55, 30, 30))
    rows = list(clean)
    rows += [(1000 + i, clean[i][1], clean[i][2], "s0") for i in range(20)]  # copies
    rows += [(1100, "12 34 !!", "en", "s1"), (1101, None, "en", "s1"), (1102, "", "en", "s1")]
    rows += [(1200 + i, f"{clean[40 + i][1]} {item} the end {i}", "en", "s2") for i in range(5)]  # contaminated
    rows += [(1300 + i, f"{' '.join(rng.sample(clean[60 + i][1].split(), k=len(clean[60 + i][1].split())))} mail ann{i}@corp.example.org now", "en", "s3") for i in range(5)]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows


def shingles(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated doc_ids with equal and other texts, repeated rows, an empty table and extra columns: no clean text is lost, none multiplied."""
    texts = some_texts(12, 31, 25, 40)
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (8, texts[4]), (8, texts[4]), (9, texts[4]), (None, texts[4]), (10, texts[5]), (None, texts[6])]
    table = spark.createDataFrame([(i, t, "en", "s", len(t), "x", k % 2) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row string, size int")
    spark.createDataFrame([(1, texts[11]), (1, texts[6]), (None, texts[5])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    single = corpus_pipeline.near_dedup(spark, table, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in single.collect()) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (10, texts[5]), (0, texts[6])])
    pure = corpus_pipeline.decontaminate(spark, table, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in pure.collect()) == sorted((i or 0, t) for i, t in rows if t not in (texts[5], texts[6]))
    assert sorted(r.text for r in corpus_pipeline.sanitise(spark, table, str(tmp_path)).collect()) == sorted(t for _, t in rows)
    mixed = corpus_pipeline.mix_sources(spark, table, str(tmp_path)).collect()
    assert len(mixed) == len(rows) and sum(r.taken for r in mixed) == int(1.5 * sum(len(WORD.findall(t)) for _, t in rows))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    rows = folder(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = [(i, t, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t)]
    sets = {i: shingles(t) for i, t, _ in kept}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    single = [(i, t, s) for i, t, s in kept if find(i) == i]
    pure = [(i, t, s) for i, t, s in single if not 1200 <= i < 1205]
    want = [{i for i, *_ in kept}, {i for i, *_ in single}, {i for i, *_ in pure}, {i for i, *_ in pure}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == columns
            assert {r.doc_id for r in docs.collect()} == want[k]
    got = {r.doc_id: r for r in docs.collect()}
    before = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out3")).collect()}
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in before.values())
    assert all(before[i].text == t for i, t, _ in pure if i < 1000)
    names = sorted({r.source for r in before.values()})
    sizes = [sum(len(WORD.findall(r.text)) for r in before.values() if r.source == n) for n in names]
    target = water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for i, n in enumerate(names):
        assert sum(r.taken for r in got.values() if r.source == n) == int(target[i] + 1e-9)
    assert all(0 < r.taken <= 2 * r["size"] for r in got.values())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got.values())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
