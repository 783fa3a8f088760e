"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text (what stands between two block-level tags). A linear classifier gives each block the log-odds of
being content; its two costs become the capacities to the two terminals. Blocks next to each other, and blocks near each other in the
DOM, are tied by smoothness edges, the stronger the closer they are. The minimum cut, found by max-flow (shortest augmenting paths), is the
labelling of least total cost. The content blocks are the text.

The classifier is a logistic regression over the evidence of ``features``: what the innermost telling element around a block says (by its tag,
role, class or id), links, length, punctuation, the block's own tag, whether the page has an article container elsewhere. It is fitted here, by
Newton's method, on pages made by ``training_page`` from rules that vary layout, names and lengths, and whose truth is known. Text that is no text for
readers (scripts, styles, comments, titles, form fields, hidden elements) makes no block.

Pages are handled one by one; nothing is shuffled, and a page's graph has a few edges for each block.

Cases: null and empty html give empty text; html cut off anywhere is read as far as it goes (an unfinished tag at the end is
dropped, unclosed elements end with the page); character references are decoded after parsing, so they make no tags; text without any
tag is one block; a form that holds half of a page's text or more says nothing; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements by the role they play for text.
_RAW = frozenset("script style textarea title noscript template iframe svg select math object canvas audio video xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# A name, and a value in quotes (unfinished ones reach to the end) or up to white space; quotes inside an unquoted value belong to it.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)|(?=>)))?|[\s/]+|=""")

_GOOD_TAGS = frozenset("article main".split())
_BAD_TAGS = frozenset("nav footer aside form menu dialog button fieldset search".split())
# Names of parts of a page, as a whole class or id, or as its first or last word.
_GOOD_NAMES = frozenset("article articlebody body content entry hentry main post story text".split())
_BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs captcha comment comments commentlist cookie cookies copyright disqus footer masthead menu modal nav navbar navigation"
    " newsletter overlay pagination pager paywall popup promo promoted promotion recommended related replies reply share sharing sidebar signup sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
# Names that are as well topics: they count as a whole class or id alone.
_TOPICAL = frozenset("adv alert complementary consent contentinfo cta dialog disclaimer donate gdpr legal login notice notices respond search skip social tags warning".split())
_TAXONOMY = ("category-", "tag-", "format-", "type-", "status-", "author-", "lang-", "topic-")
_HEADERS = frozenset("header heading hero masthead".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

ADJACENT = 0.6
NEAR_IN_DOM = 1.2


def _named(value: str) -> int:
    """What the classes or ids of a value say: -1, 1, 2 (header) or 0; names of parts that are no content win."""
    found = 0
    for token in value.lower().split():
        if token.startswith(_TAXONOMY):
            continue
        words = [w for w in re.split(r"[-_:]+", token) if w]
        ends = {words[0], words[-1]} if words else set()
        if token in _TOPICAL or ends & _BAD_NAMES:
            return -1
        if ends & _GOOD_NAMES:
            found = 1
        elif ends & _HEADERS and not found:
            found = 2
    return found


class _Node:
    __slots__ = ("tag", "parent", "depth", "own", "says", "hidden")

    def __init__(self, tag: str, parent: _Node | None, attributes: dict[str, str]):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        style = attributes.get("style", "").lower()
        self.hidden = (parent is not None and parent.hidden) or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style))
        self.own = self.says = 0  # ``says`` is settled by ``_settle``
        if tag not in ("body", "html"):
            said = [_named(attributes[k]) for k in ("class", "id", "role") if k in attributes]
            if tag in _GOOD_TAGS:
                exact = any(set(attributes.get(k, "").lower().split()) & (_BAD_NAMES | _TOPICAL) for k in ("class", "id", "role"))
                self.own = -1 if exact else 1
            elif tag in _BAD_TAGS or -1 in said:
                self.own = -1
            elif 1 in said:
                self.own = 1
            elif tag == "header" or 2 in said:
                self.own = 2


def _settle(nodes: list[_Node], found: list[tuple[str, _Node, int]]) -> None:
    """What is said around each element, innermost first. A page's header is no content; one inside an article belongs to it."""
    total, inside = 0, Counter()
    forms = {n for n in nodes if n.tag == "form"}
    for text, node, _ in found:
        total += len(text)
        while forms and node is not None:
            if node in forms:
                inside[node] += len(text)
            node = node.parent
    for n in nodes:
        around = n.parent.says if n.parent else 0
        own = 0 if n in forms and 2 * inside[n] >= total else n.own
        n.says = (around if around > 0 else -1) if own == 2 else own or around


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` to the tag's end, and the place behind it (the page's end if the tag is unfinished)."""
    found: dict[str, str] = {}
    while at < len(page) and page[at] != ">":
        m = _ATTRIBUTE.match(page, at)
        if not m or m.end() == at:
            at += 1
            continue
        if m[1]:
            found.setdefault(m[1].lower(), entities.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
        at = m.end()
    return found, at + 1


def blocks_of(page: str) -> list[tuple[str, _Node, int]]:
    """``(text, element, characters in links)`` in page order."""
    found: list[tuple[str, _Node, int]] = []
    root = node = _Node("", None, {})
    nodes = [root]
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    linked = links = 0
    at, size, lower = 0, len(page), None

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text and not node.hidden:
                found.append((text, node, linked))
            held.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        held.append(text)
        linked += len(text.strip()) if links else 0

    def leave() -> None:
        nonlocal node
        open_tags[node.tag] -= 1
        node = node.parent

    def skip_to(mark: str) -> int:
        end = page.find(mark, at)
        return end + len(mark) if end >= 0 else size

    while at < size:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        at = start
        if page.startswith("<!--", at):
            at = min(skip_to("-->"), size)
            continue
        closing = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                at = skip_to(">")
            elif at + 1 == size:
                break
            else:
                say("<")
                at += 1
            continue
        tag = m[0].lower()
        attributes, at = _attributes(page, m.end())
        if at > size:
            break
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag == "br":
            held.append(" ")
        if tag in _RAW and not closing and page[at - 2] != "/":
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else size
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in _BLOCK and "-" not in tag:
            continue
        flush()
        if not closing:
            if node.tag == "p" or (node.tag == tag and tag in ("li", "td", "th", "tr", "dd", "dt", "option")):
                leave()
                if node.tag == tag and tag in ("li", "dd", "dt"):
                    leave()
            node = _Node(tag, node, attributes)
            nodes.append(node)
            open_tags[tag] += 1
        elif open_tags[tag]:
            while node.tag != tag:
                leave()
            leave()
    flush()
    _settle(nodes, found)
    return found


def features(blocks: list[tuple[str, _Node, int]]) -> np.ndarray:
    """The evidence of each block, a row each."""
    marked = any(node.says > 0 for _, node, _ in blocks)
    rows = []
    for text, node, linked in blocks:
        share = min(1.0, linked / len(text))
        good, bad = node.says > 0, node.says < 0
        free = not good and not bad
        ends = text[-1] in ".!?…\"'»”"
        rows.append((1.0, good, bad, free and marked, min(len(text), 400) / 400, share, share * good, ends, ends * free, node.tag in ("", "p", "blockquote", "pre"), node.tag in _HEADINGS, node.tag in ("li", "td", "th"), text[0] == "©", len(blocks) == 1))
    return np.array(rows, np.float64).reshape(len(rows), 14)


def training_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page made from rules, and for each of its blocks whether it is content. Layouts have an article container or not; names, lengths and extras vary."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(1, 9)))
    words = lambda least, most: " ".join(word() for _ in range(rng.randint(least, most)))
    sentence = lambda least, most: words(least, most).capitalize() + rng.choice(".....!?")
    link = lambda text: f'<a href="/{word()}">{text}</a>'
    parts: list[str] = []
    truth: list[bool] = []

    def put(tag: str, text: str, content: bool) -> None:
        parts.append(f"<{tag}>{text}</{tag.split()[0]}>")
        truth.append(content)

    def listing(content: bool = False) -> None:
        parts.append("<ul>")
        for _ in range(rng.randint(2, 7)):
            put("li", link(words(1, 3)) if not content else sentence(2, 14), content)
        parts.append("</ul>")

    def boilerplate(name: str) -> None:
        told = rng.random() < 0.7  # some parts carry no name that tells, and tell themselves by links or by their length
        tag = rng.choice([f'div class="{name}"', f'section id="{rng.choice(["site", "page", "left"])}-{name}"', rng.choice(["aside", "nav", "footer"])]) if told else "div"
        parts.append(f"<{tag}>")
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.4:
                listing()
            elif kind < 0.6:
                put(rng.choice(["p", "div"]), "© " + words(1, 9), False)
            elif kind < 0.8 or not told:
                put(rng.choice(["p", "div", "h3"]) if told else "div", link(words(1, 6)) if rng.random() < 0.8 else words(1, 3), False)
            else:
                put(rng.choice(["p", "div"]), rng.choice([sentence(3, 18), words(2, 9)]), False)
        parts.append(f"</{tag.split()[0]}>")

    if rng.random() < 0.08:  # nothing but text
        if rng.random() < 0.5:
            return rng.choice([words, sentence])(1, 60), [True]
        for _ in range(rng.randint(1, 6)):
            put(rng.choice(["p", "div"]), rng.choice([words, sentence])(1, 40), True)
        return "".join(parts), truth
    names = sorted(_BAD_NAMES)
    if rng.random() < 0.8:
        put("header", words(1, 5), False)
    for _ in range(rng.randint(1, 3)):
        boilerplate(rng.choice(names))
    container = rng.choice(["article", "main", 'div class="entry-content"', 'div id="main"', "div", "div", "section"])
    parts.append(f"<{container}>")
    if rng.random() < 0.9:
        put(rng.choice(["h1", "h2"]), words(2, 9), True)
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.06:
            boilerplate(rng.choice(names))
        elif kind < 0.14:
            listing(content=True)
        elif kind < 0.24:
            put(rng.choice(["h2", "h3"]), words(1, 6), True)
        else:
            text = rng.choice([sentence, sentence, sentence, words])(1, rng.choice([6, 30, 90]))
            put(rng.choice(["p", "p", "p", "blockquote", "div"]), text + (" " + link(words(1, 4)) + " " + sentence(1, 9) if rng.random() < 0.2 else ""), True)
    parts.append(f"</{container.split()[0]}>")
    for _ in range(rng.randint(1, 3)):
        boilerplate(rng.choice(names))
    if rng.random() < 0.7:
        put("footer", "© " + words(1, 6), False)
    return "".join(parts), truth


@functools.cache
def fitted(pages: int = 300, seed: int = 11, penalty: float = 1.0) -> np.ndarray:
    """Weights of the classifier: logistic regression by Newton's method on ``pages`` made pages; the same everywhere."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        page, truth = training_page(rng)
        x.append(features(blocks_of(page)))
        y += truth
    x, y = np.concatenate(x), np.array(y, np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def evidence(blocks: list[tuple[str, _Node, int]]) -> list[float]:
    """Log-odds that each block is content."""
    return (features(blocks) @ fitted()).tolist() if blocks else []


def _distance(a: _Node, b: _Node, most: int = 4) -> int:
    """Steps between two elements by way of their nearest common ancestor, or ``most``."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps if a is b else most


def smoothness(blocks: list[tuple[str, _Node, int]]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between blocks and the last earlier one under the same grandparent."""
    edges = []
    last: dict[int, int] = {}
    for i, (_, node, _) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT + NEAR_IN_DOM / (1 + _distance(blocks[i - 1][1], node))))
        above = id(node.parent or node)
        j = last.get(above, i - 1)
        if j < i - 1:
            edges.append((j, i, NEAR_IN_DOM / 3))
        last[above] = i
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side (content): max-flow along shortest augmenting paths."""
    n = len(scores)
    source, sink = n, n + 1
    flow: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, s in enumerate(scores):
        if s > 0:
            flow[source][i], flow[i][source] = s, 0.0
        else:
            flow[i][sink], flow[sink][i] = -s, 0.0
    for a, b, w in edges:
        flow[a][b] = flow[a].get(b, 0.0) + w
        flow[b][a] = flow[b].get(a, 0.0) + w
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for y, c in flow[x].items():
                if c > 1e-9 and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if sink not in level:
            return [i in level for i in range(n)]
        rest = {x: iter(list(flow[x])) for x in level}
        path = [source]
        while path:
            x = path[-1]
            if x == sink:
                most = min(flow[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = 0
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    flow[a][b] -= most
                    flow[b][a] += most
                    if flow[a][b] <= 1e-9:
                        cut = k
                del path[cut + 1 :]
                continue
            for y in rest[x]:
                if flow[x][y] > 1e-9 and level.get(y) == level[x] + 1:
                    path.append(y)
                    break
            else:
                path.pop()
                if path:
                    level.pop(x)
        # every shortest path is saturated now


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    content = minimum_cut(evidence(blocks), smoothness(blocks))
    return "\n".join(text for (text, _, _), keep in zip(blocks, content, strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row of ``pages(page_id, url, html)``."""
    return pages.select(pages.page_id.cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
