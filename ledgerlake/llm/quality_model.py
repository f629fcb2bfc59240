"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into bins. Rounds of boosting visit the features in turn, each time fitting
a shallow tree of one feature to the gradient and adding it to that feature's lookup table; then the pairs of
features that explain most of what is left get tables of their own in the same way. A score is the logistic
function of the sum of a document's table entries.

The model is fitted on the driver, on a sample of the labelled rows: those whose hashed id is below a threshold
set so that about TRAIN_ROWS are taken (all of them, if there are fewer). Only their features are gathered.

A null text counts as empty and is scored like any other. A row is labelled by each non-null label of its id
(the greatest, if several). Without labels of both kinds the score is their share, or 0.5 if there are none.
Rows that repeat an id are scored alike if their texts are. An empty table gives an empty result. Columns of
the input named like the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plus, read
from .quality_rules import Text

TRAIN_ROWS, BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 20_000, 32, 120, 0.1, 8, 8, 40
HELD_OUT = 1

FEATURES = (
    "log_words", "word_length", "symbols", "bars", "upper", "distinct_words", "stutter", "repeat_words", "dup_lines",
    "top_word", "line_length", "digits", "stops", "commas", "exclamations", "non_ascii", "lone_marks", "title_words",
)
DIGITS, LETTERS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def features(text: str) -> list[float]:
    t = Text(text)
    n, size, words = max(1, t.n_words), max(1, len(t.raw)), t.words
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    have = lambda chars: size - len(t.raw.translate(None, chars)) if t.raw else 0
    return [
        math.log1p(t.n_words), t.word_chars / n, t.n_symbols / n, t.raw.count(b"|") / n, t.upper_share, len(counts) / n, t.n_stutter / n,
        t.n_repeat_words / n, t.dup_line_bytes / size, max(counts.values(), default=0) / n, math.log1p(size / max(1, len(t.lines))),
        have(DIGITS) / size, t.raw.count(b".") / n, t.raw.count(b",") / n, t.raw.count(b"!") / n, (size - len(t.text)) / size if t.text else 0.0,
        sum(c for w, c in counts.items() if len(w) == 1 and w not in b"aeiouyAEIOUY") / n, sum(c for w, c in counts.items() if w[:1].isupper()) / n,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def split(g: np.ndarray, h: np.ndarray, least: float = 5.0) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of a row of sums of gradients and Hessians; 0 if none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > least / 10) & (hr > least / 10), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 0)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 1e-9 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values by bin of a tree of at most `leaves` leaves, grown at the best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*split(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, k, a, b = max(found)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best cut along one axis followed by one cut of each side along the other."""
    best = (0.0, np.zeros(g.shape))
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, a.shape[0]):
            gain, out = 0.0, np.zeros(a.shape)
            for rows in (slice(0, k), slice(k, None)):
                sg, sh = a[rows].sum(0), b[rows].sum(0)
                at = split(sg, sh)[1]
                for cols in (slice(0, at), slice(at, None)):
                    top, low = sg[cols].sum(), sh[cols].sum() + 1
                    out[rows, cols] = top / low
                    gain += top**2 / low
            if gain > best[0]:
                best = (gain, out if axis == 0 else out.T)
    return best


@dataclass
class Model:
    """Lookup tables; cuts and coarse are the bins' upper bounds by feature."""

    start: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k])]
        fine = {k: np.searchsorted(self.coarse[k], x[:, k]) for pair in self.pairs for k in pair}
        for (i, j), table in self.pairs.items():
            total += table[fine[i], fine[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
        return Model(math.log(share / (1 - share)))
    quantiles = lambda column, n: np.unique(np.quantile(column, np.arange(1, n) / n))
    share = float(y.mean())
    model = Model(math.log(share / (1 - share)), [quantiles(c, BINS) for c in x.T], [], [quantiles(c, PAIR_BINS) for c in x.T])
    bins = [np.searchsorted(c, col) for c, col in zip(model.cuts, x.T, strict=True)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            step = RATE * tree(np.bincount(b, g, len(model.tables[k])), np.bincount(b, h, len(model.tables[k])))
            model.tables[k] += step
            total += step[b]
    coarse = [np.searchsorted(c, col) for c, col in zip(model.coarse, x.T, strict=True)]
    sizes = [len(c) + 1 for c in model.coarse]

    def sums(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * sizes[j] + coarse[j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    gains = {(i, j): pair_tree(sums(i, j, g), sums(i, j, h))[0] for i, j in combinations(range(len(sizes)), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for i, j in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = slopes()
            step = RATE * pair_tree(sums(i, j, g), sums(i, j, h))[1]
            model.pairs[i, j] += step
            total += step[coarse[i], coarse[j]]
    return model


def remainder(key):
    return F.crc32(key.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """The model fitted on about `rows` labelled rows that are not held out."""
    usable = labels.where(F.col(label).isNotNull() & (remainder(F.col(key)) != HELD_OUT)).groupBy(key).agg(F.max(label).cast("double").alias("_y"))
    n = usable.count()
    chosen = usable if n <= rows else usable.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    held = docs.select(key, text).join(F.broadcast(chosen), key).select(key, text, "_y")  # at most about `rows` pairs of numbers

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(matrix(b.column(1).to_pylist())), pa.list_(pa.float64()))], names=[key, "y", "x"])

    found = held.mapInArrow(measured, plus(held.select(key).schema, y="double", x="array<double>")).collect()
    found.sort(key=lambda r: (r[0], r["x"]))
    return fit(np.array([r["x"] for r in found], np.float64).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found], np.float64))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    held = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    place = held.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(matrix(b.column(place).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return held.mapInArrow(scored, plus(held.schema, score="double", predicted="int"))


def op9_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")
