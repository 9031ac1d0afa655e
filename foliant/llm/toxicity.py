"""Toxicity by compression distance.

Zstandard dictionaries are trained on ordinary and on toxic text. Toxic text is
ordinary text for the most part, so its dictionary goes on from the ordinary one:
the windows that toxic documents have far more often than others follow, the
strongest last, where Zstandard reaches them most cheaply. What the toxic
dictionary saves on a window beyond the ordinary one is the window's gain; a window
that both explain alike has none. Windows are single words, and the overlapping
stretches of ``AROUND`` words to both sides of the words that gain most.

Zstandard leaves out matches of a few bytes, so characters are first spread to three
bytes each, which makes a matched character worth about three bytes. It compresses at
a level with an optimal parse: at greedy levels the choice of matches, and not the
text, decides small differences of length.

Thresholds are calibrated: every labelled row is measured with dictionaries that were
trained without it (``FOLDS`` parts in turn). The gains that few ordinary words reach
are the weak and the strong threshold, and a logistic fit turns a document's gains
into a score. The final dictionaries are trained on all of these rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick
from .labelled import held_out, training_labels

#: Three fixed bytes for each byte.
SPREAD = [hashlib.sha256(bytes([b])).digest()[:3] for b in range(256)]
WORD = re.compile(r"[^\W_]+")
#: Words of a training line, and of a stretch to each side of a word.
LINE, AROUND = 16, 3
#: The first level with an optimal parse for inputs of this size.
LEVEL = 16
FOLDS = 3
#: The gain of a word, in bytes, from which the stretch around it is measured: a match less.
MATCH = 3
#: Gains are counted up to this many bytes; what is more counts as that.
MOST = 24
#: Shares of ordinary words that reach the weak and the strong threshold at most.
WEAK_SHARE, STRONG_SHARE = 1 / 200, 1 / 20_000
#: A window goes to the toxic dictionary if as many documents have it, if it is as many times as frequent there, and if the log-likelihood ratio of that is as large.
LEAST_DOCS, LEAST_RATIO, LEAST_G2 = 3, 4.0, 8.0
#: Words whose gain a worker keeps; the cache is emptied beyond it.
CACHE = 400_000


def normal_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def spread(words: list[str]) -> bytes:
    return b"".join(map(SPREAD.__getitem__, f" {' '.join(words)} ".encode("utf-8", "surrogatepass")))


def compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False).compress


def train_ordinary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or the raw end of the lines where they are too few to train one."""
    lines = [spread(words[k : k + LINE]) for words in map(normal_words, texts) for k in range(0, len(words), LINE)]
    try:
        return zstandard.train_dictionary(size, lines, k=48, d=8).as_bytes()
    except (zstandard.ZstdError, MemoryError, ValueError):
        return b"".join(lines)[-size:] or b" "


def strength(toxic: int, ordinary: int, n_toxic: int, n_ordinary: int) -> float:
    """Log-likelihood ratio of a word that so many of the documents of each class have; 0 if it is too rare or not telling."""
    if toxic < LEAST_DOCS or not n_ordinary or toxic / n_toxic < LEAST_RATIO * (ordinary + 0.5) / n_ordinary:
        return 0.0
    p = (toxic + ordinary) / (n_toxic + n_ordinary)
    g2 = 2 * (toxic * math.log(toxic / (n_toxic * p)) + (ordinary * math.log(ordinary / (n_ordinary * p)) if ordinary else 0.0))
    return g2 if g2 >= LEAST_G2 else 0.0


@dataclass
class Dictionaries:
    ordinary: bytes
    toxic: bytes
    gains: dict[str, int] = field(default_factory=dict, repr=False)

    def gain(self, words: list[str]) -> int:
        window = spread(words)
        return max(0, len(self.plain(window)) - len(self.rude(window)))

    def measure(self, texts: list[str | None]) -> np.ndarray:
        """For each text the number of its words, how many have each gain from 1 to
        ``MOST``, the five largest gains of words and the three largest of stretches."""
        if not hasattr(self, "plain"):
            self.plain, self.rude = compressor(self.ordinary), compressor(self.toxic)
        out, known = np.zeros((len(texts), 1 + MOST + 8)), self.gains
        for i, text in enumerate(texts):
            words = normal_words(text)
            if len(known) > CACHE:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.gain([w])
            gains = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            at = np.nonzero(gains)[0]
            out[i, 0] = len(words)
            out[i, 1 : 1 + MOST] = np.bincount(np.minimum(gains[at], MOST), minlength=MOST + 1)[1:]
            top = np.sort(gains[at])[::-1][:5]
            out[i, 1 + MOST : 1 + MOST + len(top)] = top
            if len(top) and top[0] >= MATCH:
                at = at[gains[at] >= MATCH]
                stretches = {tuple(words[max(0, k - AROUND) : k + AROUND + 1]) for k in at[np.argsort(-gains[at], kind="stable")][:4].tolist()}
                top = sorted((self.gain(list(s)) for s in stretches), reverse=True)[:3]
                out[i, 6 + MOST : 6 + MOST + len(top)] = top
        return out

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "gains": {}}


@dataclass
class Model:
    dictionaries: Dictionaries
    weak: int = 3
    strong: int = 6
    mean: np.ndarray = field(default_factory=lambda: np.zeros(8))
    scale: np.ndarray = field(default_factory=lambda: np.ones(8))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(9))

    def features(self, measured: np.ndarray) -> np.ndarray:
        n, counts = measured[:, 0], measured[:, 1 : 1 + MOST]
        words, stretches = measured[:, 1 + MOST : 6 + MOST], measured[:, 6 + MOST :]
        weak, strong = counts[:, self.weak - 1 :].sum(1), counts[:, self.strong - 1 :].sum(1)
        return np.c_[words[:, 0], words[:, 1], words.mean(1), np.log1p(weak), np.log1p(strong), 30 * weak / np.maximum(n, 1), stretches[:, 0], stretches.mean(1)]

    def scores(self, measured: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(measured)), (self.features(measured) - self.mean) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def calibrate(self, measured: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        plain = measured[y == 0]
        reach = plain[:, 1 : 1 + MOST].sum(0)[::-1].cumsum()[::-1] / max(1, plain[:, 0].sum())
        least = lambda share: 1 + int(np.argmax(reach <= share)) if (reach <= share).any() else MOST
        self.weak, self.strong = least(WEAK_SHARE), least(STRONG_SHARE)
        features = self.features(measured)
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-9
        z = np.c_[np.ones(len(features)), (features - self.mean) / self.scale]
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            w -= np.linalg.solve(h, z.T @ (p - y) + ridge * w)
        self.weights = w


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 6_000, ordinary_rows: int = 1_500, ordinary_size: int = 150_000, toxic_size: int = 60_000,
) -> Model:
    """Learn from at most ``limit`` labelled documents of each class, whole texts; of
    the ordinary ones the ``ordinary_rows`` that hash lowest train the ordinary
    dictionary, all count words. Sizes are those of the dictionaries in bytes. Without
    usable labels of both classes every score is 0.5."""
    known = training_labels(labels, "toxic", limit, id_col).withColumn("fold", F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(FOLDS)).cast("int"))
    rows = materialize(pick(docs, [id_col, text_col]).withColumnRenamed(text_col, "_text").join(F.broadcast(known), id_col).select("_text", "y", "fold"), "toxicity-rows")
    numbers = {(r.y, r.fold): r.n for r in rows.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    lines = [(r._text or "", r.fold) for r in rows.where("y = 0").orderBy(F.xxhash64("_text"), "_text", "fold").limit(ordinary_rows).collect()]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, *own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = sorted(set(normal_words(text)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([x] * len(found), pa.int32()) for x in own)], names=["word", "y", "fold"])

    columns = [(y, k) for y in (0, 1) for k in range(FOLDS)]
    sums = [F.count(F.when((F.col("y") == y) & (F.col("fold") == k), 1)).alias(f"n{y}{k}") for y, k in columns]
    counted = rows.mapInArrow(words, "word string, y int, fold int").groupBy("word").agg(*sums)
    toxic = sum(F.col(f"n1{k}") for k in range(FOLDS))
    ordinary = sum(F.col(f"n0{k}") for k in range(FOLDS))
    size = {y: max(1, sum(numbers.get((y, k), 0) for k in range(FOLDS))) for y in (0, 1)}
    # Half the ratio that the final selection asks for, as a part of the rows may show a larger one; a window takes six bytes at least.
    telling = counted.where((toxic >= LEAST_DOCS) & (toxic / size[1] >= LEAST_RATIO / 2 * ordinary / size[0]))
    found = telling.orderBy((toxic - ordinary * (size[1] / size[0])).desc(), "word").limit(toxic_size // 6).collect()

    def dictionaries(without: int | None) -> Dictionaries:
        folds = [k for k in range(FOLDS) if k != without]
        n = [sum(numbers.get((y, k), 0) for k in folds) for y in (0, 1)]
        strengths = sorted((strength(sum(r[f"n1{k}"] for k in folds), sum(r[f"n0{k}"] for k in folds), n[1], n[0]), r.word) for r in found) if n[1] else []
        base = train_ordinary([t for t, k in lines if k != without], ordinary_size)
        windows = b"".join(spread([w]) for s, w in strengths if s)
        return Dictionaries(base, base + windows[-toxic_size:])

    parts = [dictionaries(k) for k in range(FOLDS)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(2).to_numpy()
            out = np.zeros((b.num_rows, 1 + MOST + 8))
            for k in range(FOLDS):
                at = np.nonzero(fold == k)[0]
                out[at] = parts[k].measure(b.column(0).take(pa.array(at)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.list_(pa.float64())), b.column(1)], names=["f", "y"])

    seen = rows.mapInArrow(measured, "f array<double>, y int").collect()
    model = Model(dictionaries(None))
    if len({r.y for r in seen}) == 2:
        seen.sort(key=lambda r: (r.y, r.f))
        model.calibrate(np.array([r.f for r in seen]), np.array([r.y for r in seen], float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) for every row of
    ``docs`` and its whole text: behind the id, or with ``keep`` behind all columns
    (replacing columns of these names). Null, empty and wordless texts have no
    gains and get the score of that. Very long texts are measured word by word like
    others; of their stretches those around the four strongest words. Repeated rows
    stay, with equal scores. An empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(model.dictionaries.measure(b.column(text_col).to_pylist()))
            own = [n for n in b.schema.names if n in names]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in own), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*own, "score", "predicted"])

    names = [c for c in docs.columns if c not in ("score", "predicted")] if keep else [id_col]
    slim = pick(docs, list(dict.fromkeys([*names, text_col])))
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in names)
    return slim.mapInArrow(run, f"{schema}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    return score(docs, train(docs, labels), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
