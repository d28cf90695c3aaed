"""Quality rules: gradient-boosted trees over document statistics.

fit_quality_model() trains on a bounded, documented sample of labelled rows; the trees are flattened into numpy arrays
of nodes, so that scoring a batch is a handful of gathers per level.  Chosen features have monotonic constraints: more
symbols, repeated lines or repeated words never raise a document's score.

Defined cases: a null or empty text has no words, so it fails the base rule; repeated rows get equal verdicts; an empty
table gives no rows; without labels of both classes there are no trees and the base rule alone decides.  Labels with a
null doc_id or quality are ignored.  Only the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import as_bytes

#: At most so many labelled documents train the trees, drawn by the hash of their id.
TRAINING_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio",
    "point_ratio", "shout_ratio", "pipe_ratio", "high_ratio", "distinct_ratio", "adjacent_ratio", "longest_word",
    "mean_line", "byte_entropy",
)
#: -1: the score may only fall as the feature grows.
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "pipe_ratio": -1, "adjacent_ratio": -1}

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_BREAKS = np.array([9, 10, 11, 12, 13, 32])
_POINTS = np.frombuffer(b".,;:!?'\"()-", np.uint8)


def repeated_words(ids: np.ndarray) -> int:
    """Words in some window of three that the text has at least twice."""
    if len(ids) < 4:
        return 0
    width = int(ids.max()) + 1
    pairs = ids[:-1] * width + ids[1:]
    if width > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * width + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows) + 2, bool)
    hit = np.concatenate([order[1:][same], order[:-1][same]])
    for shift in range(3):
        twice[hit + shift] = True
    return int(twice.sum())


def text_statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five base counts and the features of one text."""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(counts[128:192].sum())
    chars = points - int(counts[_BREAKS].sum())
    symbols = int(counts[_SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    duplicates = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeats = repeated_words(ids)
    base = [n, chars, symbols, duplicates, repeats]
    some, share = max(n, 1), counts[counts > 0] / max(len(text), 1)
    features = [
        math.log1p(n), chars / some, symbols / max(chars, 1), duplicates / max(len(lines), 1), repeats / some,
        counts[65:91].sum() / max(chars, 1), counts[48:58].sum() / max(chars, 1), counts[_POINTS].sum() / max(chars, 1),
        counts[33] / max(chars, 1), counts[124] / max(chars, 1), counts[128:].sum() / max(len(text), 1), len(known) / some,
        float((ids[1:] == ids[:-1]).sum()) / some, float(max(map(len, words), default=0)), chars / max(len(lines), 1),
        float(-(share * np.log2(share)).sum()),
    ]
    return base, features


@dataclass
class Trees:
    """All trees, flattened: node i of every tree has a feature (or -1), a threshold, two children and a value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.base + self.value[at].sum(axis=1)
            low = x[rows, np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> Trees | None:
    """Histogram boosting of logistic loss.  monotone: -1, 0 or 1 for each feature.

    A split that breaks a constraint is not taken; below one that is taken, both sides stay on their side of its
    midpoint, so that the whole tree keeps the constraint.  None if y has one class only.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    mean = float(y.mean())
    start = math.log(mean / (1 - mean))
    margin = np.full(len(y), start)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + ridge), low), high)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = float(g[rows].sum()), float(h[rows].sum())
        nodes.append([-1, 0.0, -1, -1, leaf(total_g, total_h, low, high) * rate])
        best = (1e-6, -1, -1, 0.0)
        if level < depth:
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                gl = np.cumsum(np.bincount(binned[f, rows], g[rows], len(edges) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[f, rows], h[rows], len(edges) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                left, right = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * left + (hl + ridge) * left**2 / 2 + gr * right + (hr + ridge) * right**2 / 2)
                value = leaf(total_g, total_h, low, high)
                gain += total_g * value + (total_h + ridge) * value**2 / 2
                gain[(hl < least) | (hr < least) | (monotone[f] * (right - left) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(left[k] + right[k]) / 2)
        gain, f, k, middle = best
        if f >= 0:
            below = binned[f, rows] <= k
            bounds = {-1: ((middle, high), (low, middle)), 0: ((low, high), (low, high)), 1: ((low, middle), (middle, high))}[int(monotone[f])]
            nodes[me][:2] = [f, float(cuts[f][k])]
            nodes[me][2] = grow(rows[below], g, h, level + 1, *bounds[0])
            nodes[me][3] = grow(rows[~below], g, h, level + 1, *bounds[1])
        return me

    def shrunk(tree: int) -> np.ndarray:
        at = np.full(len(y), tree)
        table = np.array(nodes)
        for _ in range(depth):
            f = table[at, 0].astype(int)
            at = np.where(f < 0, at, np.where(x[np.arange(len(y)), np.maximum(f, 0)] <= table[at, 1], table[at, 2], table[at, 3]).astype(int))
        return table[at, 4]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
        margin += shrunk(roots[-1])
    flat = np.array(nodes)
    return Trees(np.array(roots), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], start)


def fit_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Trees | None:
    """Trees fitted on at most `rows` labelled documents, chosen by the hash of their id.  None without both classes."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    n = known.count()
    share = 1.0 if n <= rows else 0.95 * rows / n  # then the limit hardly ever takes effect
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = known.withColumn("draw", draw).where(F.col("draw") < int(share * (1 << 30))).orderBy("draw", "id", "y").limit(rows)
    width = len(FEATURES)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_statistics(t)[1] for t in as_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], ["draw", "key", "y", "x"])

    # The chosen ids are at most `rows`, so their broadcast has a fixed bound.
    got = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id")
        .select("draw", F.xxhash64("text").alias("key"), "y", "text")
        .mapInArrow(featured, "draw long, key long, y int, x array<double>")
        .orderBy("draw", "key", "y")  # where ids repeat there may be more rows; those of the least draws stay
        .limit(2 * rows)
        .collect()
    )
    if not got:
        return None
    x = np.array([r.x for r in got])
    order = np.lexsort(x.T)  # the order in which rows arrive doesn't matter
    y = np.array([r.y for r in got], float)
    return boost(x.reshape(-1, width)[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def verdicts(texts: list[bytes], trees: Trees | None, keep_at: float = KEEP_AT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, whether the base rule fails, score, kept."""
    found = [text_statistics(t) for t in texts]
    base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
    failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
    x = np.array([f for _, f in found], float).reshape(-1, len(FEATURES))
    score = trees.score(x) if trees else np.where(failed, 0.0, 1.0)
    return base, failed, score, ~failed & (score >= keep_at)


def quality_scores(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The id, base counts, base_failed, kept and quality_score of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, failed, score, kept = verdicts(as_bytes(batch.column(1)), trees, keep_at)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(kept), pa.array(score)], [id_col, *BASE, "base_failed", "kept", "quality_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {', '.join(f'{k} long' for k in BASE)}, base_failed boolean, kept boolean, quality_score double"
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(scored, schema)


def quality_kept(trees: Trees | None, text: Column, keep_at: float = KEEP_AT) -> Column:
    """A predicate on a text column: true for what the rules keep."""
    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(verdicts([b"" if t is None else t.encode() for t in texts], trees, keep_at)[3])

    return kept(text.cast("string"))
