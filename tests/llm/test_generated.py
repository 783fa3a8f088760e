"""Properties of the operators' Python parts over generated inputs."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkcatalog.llm import html, katz, langid, simhash

markup = st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "<br>", "<b>", "</b>", "<li>", "<", ">", "&amp;", "&#x", "<!--", "-->", "<script>", "</script>", "word", " ", "\n", "é", '<a href="x>">', "</a>", "<p", "'", '"']), max_size=40)


@settings(max_examples=200, deadline=None)
@given(markup)
def test_any_markup_gives_clean_text(parts):
    text = html.main_text("".join(parts))
    assert all(line and line == " ".join(line.split()) for line in text.split("\n")) or text == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBZ é\n\t\x0b\x1f\xa0", max_size=30)), max_size=8))
def test_tokens_are_those_of_the_pattern(texts):
    hashes, counts = katz.Tokenizer()(pa.array(texts, pa.string()))
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    want = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t or "")), None] for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for x in want for w in x]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_windows_hold_the_whole_text(data):
    w = langid.to_windows(data)
    assert w.shape[1] == langid.WINDOW and w.tobytes()[: len(data)] == data and not any(w.tobytes()[len(data) :])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**10), min_size=1, max_size=60, unique=True), st.integers(0, 3))
def test_forests_connect_what_is_near(values, radius):
    fps = np.array(values, dtype=np.int64)
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    edges = simhash._forest(fps, radius)
    assert len(edges) == len(values) - len({find(v) for v in values})
    assert all((a ^ b).bit_count() <= radius for a, b in edges)
