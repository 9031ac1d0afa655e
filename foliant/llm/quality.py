"""Quality by a generalised additive model with pairwise interactions.

Trees of up to three leaves over binned features are boosted in turn, one feature
after the other, so that each feature gets a lookup table; the pairs that explain
most of what is left get two-dimensional tables in the same way. A score is the
sum of the cells that a document falls in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .labelled import held_out, training_labels

FEATURES = (
    "log_words", "log_chars", "word_length", "symbols", "exclaims", "upper", "digits", "stops", "pipes", "non_ascii",
    "line_length", "repeated_lines", "distinct_words", "commonest_word", "short_words", "compressed", "neighbours_equal", "line_ends",
)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` for each text; null counts as empty."""
    out = np.zeros((len(texts), len(FEATURES)))
    squeeze = zstandard.ZstdCompressor(level=1)
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        n = len(data)
        words = data.split()
        k = len(words)
        if not k:
            continue
        c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        solid = max(1, n - int(c[9:14].sum() + c[32]))
        lines = [x for x in data.split(b"\n") if x.strip()]
        counts = Counter(words)
        out[i] = (
            np.log1p(k), np.log1p(n), solid / k, c[list(b"#*$%&|<>")].sum() / solid, c[33] / solid, c[65:91].sum() / solid, c[48:58].sum() / solid,
            (c[46] + c[44]) / k, c[124] / k, c[128:].sum() / solid, k / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / k,
            max(counts.values()) / k, sum(len(w) <= 3 for w in words) / k, len(squeeze.compress(data)) / n, sum(map(bytes.__eq__, words[1:], words)) / k,
            sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
        )
    return out


@dataclass
class Gam:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, j], side="right")]
        wide = [np.searchsorted(cut, x[:, j], side="right") for j, cut in enumerate(self.coarse)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[wide[a], wide[b]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def tree_1d(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Values by bin of the best tree of at most ``leaves`` leaves over ordered bins."""
    parts = [(0, len(grad))]
    gain_of = lambda g, h: g * g / (h + ridge)
    while len(parts) < leaves:
        best = (1e-6, None, None)
        for p, (s, e) in enumerate(parts):
            g, h = np.cumsum(grad[s:e]), np.cumsum(hess[s:e])
            if e - s < 2:
                continue
            gains = gain_of(g[:-1], h[:-1]) + gain_of(g[-1] - g[:-1], h[-1] - h[:-1]) - gain_of(g[-1], h[-1])
            gains[(h[:-1] < 2) | (h[-1] - h[:-1] < 2)] = 0
            at = int(np.argmax(gains))
            if gains[at] > best[0]:
                best = (gains[at], p, s + at + 1)
        if best[1] is None:
            break
        s, e = parts.pop(best[1])
        parts += [(s, best[2]), (best[2], e)]
    out = np.zeros(len(grad))
    for s, e in parts:
        out[s:e] = grad[s:e].sum() / (hess[s:e].sum() + ridge)
    return out


def tree_2d(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four by one line on each axis."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    rows, cols, tg, th = g[:-1, -1:], g[-1:, :-1], g[-1, -1], h[-1, -1]
    if not g[:-1, :-1].size:
        return 0.0, np.zeros_like(grad)
    gs = [g[:-1, :-1], rows - g[:-1, :-1], cols - g[:-1, :-1], tg - rows - cols + g[:-1, :-1]]
    hr, hc = h[:-1, -1:], h[-1:, :-1]
    hs = [h[:-1, :-1], hr - h[:-1, :-1], hc - h[:-1, :-1], th - hr - hc + h[:-1, :-1]]
    gain = sum(a * a / (np.maximum(b, 0) + ridge) for a, b in zip(gs, hs, strict=True)) - tg * tg / (th + ridge)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(grad)
    values = [a[r, c] / (max(b[r, c], 0) + ridge) for a, b in zip(gs, hs, strict=True)]
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = values
    return float(gain[r, c]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, coarse_bins: int = 8, n_pairs: int = 10, pair_rounds: int = 60) -> Gam:
    prior = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    width = x.shape[1]
    if len(y) < 2:
        empty = [np.zeros(0)] * width
        return Gam(base, empty, [np.zeros(1)] * width, empty, [], [])
    cuts, coarse = [edges(x[:, j], bins) for j in range(width)], [edges(x[:, j], coarse_bins) for j in range(width)]
    at = [np.searchsorted(cuts[j], x[:, j], side="right") for j in range(width)]
    wide = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(width)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            step = rate * tree_1d(np.bincount(at[j], g, len(tables[j])), np.bincount(at[j], h, len(tables[j])))
            tables[j] += step
            z += step[at[j]]
    grids = {(a, b): (len(coarse[a]) + 1, len(coarse[b]) + 1) for a, b in combinations(range(width), 2)}
    cell = {p: wide[p[0]] * grids[p][1] + wide[p[1]] for p in grids}
    grid = lambda p, v: np.bincount(cell[p], v, grids[p][0] * grids[p][1]).reshape(grids[p])
    g, h = slopes()
    pairs = sorted(grids, key=lambda p: (-tree_2d(grid(p, g), grid(p, h))[0], p))[:n_pairs]
    pair_tables = [np.zeros(grids[p]) for p in pairs]
    for _ in range(pair_rounds):
        for p, table in zip(pairs, pair_tables, strict=True):
            g, h = slopes()
            step = rate * tree_2d(grid(p, g), grid(p, h), ridge=3.0)[1]
            table += step
            z += step.ravel()[cell[p]]
    return Gam(base, cuts, tables, coarse, pairs, pair_tables)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 10_000) -> Gam:
    """Learn from at most ``limit`` labelled documents of each class. Features are
    computed where the texts are; only their numbers come to the driver."""
    known = training_labels(labels, "quality", limit, id_col)
    rows = pick(docs, [id_col, text_col]).withColumnRenamed(text_col, "_text").join(F.broadcast(known), id_col).select("_text", "y")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = features(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.float64())), b.column(1)], names=["f", "y"])

    seen = rows.mapInArrow(measured, "f array<double>, y int").orderBy("y", "f").collect()
    return fit(np.array([r.f for r in seen]).reshape(-1, len(FEATURES)), np.array([r.y for r in seen], float))


def score(docs: DataFrame, model: Gam, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` for every row and its whole text. Null, empty
    and wordless texts have all features zero and are scored as such; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(features(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    slim = pick(docs, [id_col, text_col])
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    return score(docs, train(docs, labels), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
