"""Language identification by a small byte convolutional network.

Text is cut into windows of ``WINDOW`` bytes, the last one padded with zeros. Each byte is embedded, filters of widths
2, 3 and 4 slide over the window, each filter's maximum over the window is taken (max pooling), and a softmax layer
gives the probabilities of the languages. The document's probabilities are the mean over all its windows. The network is trained in
numpy, by Adam, on windows of a bounded, stratified sample of labelled rows (``max_rows``).

For prediction each filter is split into two tables over byte pairs, so that a position's response is the sum of two
looked-up rows; windows go through in small batches that stay in cache, whatever the length of a text. Rows never move.

Cases: null text, and text without a letter, is ``und`` with score 0; empty text too; without labelled rows everything
is ``und``; with one learned language everything else has score 1; rows are predicted one by one, so repeated rows agree;
extra columns are ignored; a training row needs a non-null text and lang.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = {2: 8, 3: 12, 4: 12}
EMBED = 8
TAPS = max(WIDTHS)
_BATCH = 48
_LETTER = regex.compile(r"\p{L}")


def _mask() -> np.ndarray:
    columns = [np.repeat(np.arange(TAPS) < width, EMBED) for width, n in WIDTHS.items() for _ in range(n)]
    return np.array(columns, dtype=np.float32).T


def train(windows: np.ndarray, labels: np.ndarray, classes: int, epochs: int = 6, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit the network to ``windows`` (n, WINDOW) of bytes."""
    rng = np.random.default_rng(seed)
    mask = _mask()
    filters = mask.shape[1]
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "conv": (rng.normal(0, 0.3, mask.shape).astype(np.float32)) * mask,
        "bias": np.zeros(filters, np.float32),
        "out": rng.normal(0, 0.2, (filters, classes)).astype(np.float32),
        "out_bias": np.zeros(classes, np.float32),
    }
    p["embed"][0] = 0
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    step, size = 0, 64
    positions = WINDOW - TAPS + 1
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), size):
            pick = order[k : k + size]
            x = windows[pick]
            taps = np.lib.stride_tricks.sliding_window_view(x, TAPS, axis=1)  # (n, positions, TAPS)
            patches = p["embed"][taps].reshape(len(pick), positions, TAPS * EMBED)
            response = patches.reshape(-1, TAPS * EMBED) @ p["conv"]
            response = response.reshape(len(pick), positions, filters)
            at = response.argmax(axis=1)
            pooled = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + p["bias"]
            active = np.maximum(pooled, 0)
            logits = active @ p["out"] + p["out_bias"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            d = prob
            d[np.arange(len(pick)), labels[pick]] -= 1
            d /= len(pick)
            g = {"out": active.T @ d, "out_bias": d.sum(axis=0)}
            back = (d @ p["out"].T) * (pooled > 0)
            g["bias"] = back.sum(axis=0)
            chosen = np.take_along_axis(patches, np.repeat(at[:, :, None], TAPS * EMBED, axis=2), axis=1)  # (n, filters, TAPS*EMBED)
            g["conv"] = np.einsum("nfk,nf->kf", chosen, back) * mask
            spread = (back[:, :, None] * p["conv"].T[None]).reshape(-1, EMBED)
            bytes_at = np.take_along_axis(taps, np.repeat(at[:, :, None], TAPS, axis=2), axis=1).reshape(-1)
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], bytes_at, spread)
            g["embed"][0] = 0
            step += 1
            for name, grad in g.items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad * grad
                p[name] -= (0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def pair_tables(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Responses of all filters to each byte pair in the first and in the last two taps."""
    part = [p["embed"] @ p["conv"][k * EMBED : (k + 1) * EMBED] for k in range(TAPS)]
    return tuple((part[k][:, None, :] + part[k + 1][None, :, :]).reshape(65536, -1) for k in (0, 2))


def window_probabilities(windows: np.ndarray, p: dict[str, np.ndarray], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.empty((len(windows), p["out"].shape[1]), np.float32)
    for k in range(0, len(windows), _BATCH):
        x = windows[k : k + _BATCH].astype(np.int32)
        pairs = (x[:, :-1] << 8) | x[:, 1:]
        response = tables[0].take(pairs[:, :-2], axis=0)
        response += tables[1].take(pairs[:, 2:], axis=0)
        active = np.maximum(response.max(axis=1) + p["bias"], 0)
        logits = active @ p["out"] + p["out_bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[k : k + _BATCH] = prob / prob.sum(axis=1, keepdims=True)
    return out


def to_windows(text: bytes) -> np.ndarray:
    """All windows of a text, the last one padded."""
    n = max(1, -(-len(text) // WINDOW))
    held = np.zeros(n * WINDOW, np.uint8)
    held[: len(text)] = np.frombuffer(text, np.uint8)
    return held.reshape(n, WINDOW)


def text_windows(text: str, per_text: int) -> list[np.ndarray]:
    return list(to_windows(text.encode())[:per_text])


def fit(labelled: DataFrame, max_rows: int = 4000, windows_per_row: int = 3, max_langs: int = 256) -> dict | None:
    """Train on about ``max_rows`` rows of ``labelled(doc_id, text, lang)``, drawn by a hash of doc_id and length, an equal share for each
    of the ``max_langs`` most frequent languages, so that rare ones are learned too.

    Of each row's text only ``windows_per_row`` pieces of a window's length, evenly spaced, are gathered, so what comes to the
    driver is bounded by ``2 * max_rows * windows_per_row * WINDOW`` characters whatever the lengths of the texts.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    pieces = [F.substr("text", F.floor(F.length("text") * k / windows_per_row).cast("int") + 1, F.lit(WINDOW)) for k in range(windows_per_row)]
    order = F.xxhash64("doc_id", F.length("text"))
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not langs:
        return None
    each = 1.2 * max_rows / len(langs)
    below = F.create_map(*(F.lit(x) for r in langs for x in (r["lang"], int(min(1.0, each / r["count"]) * 1_000_003))))
    few = rows.where(F.pmod(order, F.lit(1_000_003)) <= F.coalesce(F.try_element_at(below, F.col("lang")), F.lit(-1)))
    sample = few.select(order.alias("h"), "lang", F.array(*pieces).alias("pieces")).orderBy("h", "lang", "pieces").limit(2 * max_rows).collect()
    if not sample:
        return None
    names = sorted({r.lang for r in sample})
    x, y = [], []
    for r in sample:
        for piece in dict.fromkeys(q for q in r.pieces if _LETTER.search(q)):
            x.append(to_windows(piece.encode()[:WINDOW])[0])
            y.append(names.index(r.lang))
    if not x:
        return None
    return {"names": names, "net": train(np.array(x), np.array(y), len(names))}


def _predictor(model: dict | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pair_tables(model["net"]) if model else None
        for batch in batches:
            langs, scores = [], []
            for cell in batch.column(0):
                text = cell.as_py()
                if model is None or text is None or not _LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                prob = window_probabilities(to_windows(text.encode()), model["net"], tables).astype(np.float64).mean(axis=0)
                best = int(prob.argmax())
                langs.append(model["names"][best])
                scores.append(float(min(1.0, prob[best])))
            columns = [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of those names in ``docs`` are replaced."""
    rest = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    packed = rest.select(F.col(text).alias("__text"), "*")
    return packed.mapInArrow(_predictor(model), f"{fields}, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """Rows that training leaves aside: crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def reject(docs: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """The rows whose language is recognised: neither ``und`` nor scored below ``least``."""
    model = fit(docs.where(~held_out("doc_id")), **options)
    return predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
