"""Quality rules: text statistics and gradient-boosted trees over them.

The trees are trained in numpy on a bounded sample of labelled rows, flattened into node
arrays and applied to whole batches at once.  Chosen features are monotonic: more symbols,
repeated words or duplicate lines can never raise the predicted quality.

Words are runs without space, tab, newline, vertical tab, form feed or carriage return.

Defined results: a null or empty text has no words, so it fails the base rules.  With no
labelled rows, or one class only, there is no model and the base rules decide alone.
Extra columns are ignored; repeated rows are judged each; of several labels of one id the
smallest counts, null labels and null ids are not learnt from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle, small_batches

SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "upper_share", "long_share")
#: -1: the prediction may only fall as the feature grows.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANK = " \t\n\v\f\r"


def repeated_words(words: list, window: int = WINDOW) -> tuple[int, int]:
    """Words inside windows that occur twice or more, and the number of distinct words."""
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    n = len(ids) - window + 1
    if n < 2 or len(seen) == len(ids):
        return 0, len(seen)
    if len(seen) < 4096 and window <= 5:
        code = ids[:n].copy()
        for k in range(1, window):
            code = (code << 12) | ids[k : n + k]
    else:
        code = ids
        for _ in range(window - 1):  # each round's codes are dense again, so they never overflow
            code = np.unique(code[:-1] * len(seen) + ids[len(ids) - len(code) + 1 :], return_inverse=True)[1]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0, len(seen)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.minimum(np.searchsorted(twice, code), len(twice) - 1)
    starts = np.flatnonzero(twice[at] == code)
    depth = np.zeros(len(ids) + 1, np.int64)
    depth[starts] += 1
    depth[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(depth[:-1]))), len(seen)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``FEATURES`` of a whole text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in _BLANK)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    dup_lines = len(lines) - len(set(lines))
    repeats, distinct = repeated_words(words)
    chars, some = max(word_chars, 1), max(n, 1)
    digits = sum(text.count(c) for c in "0123456789")
    capitals = sum(text.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    long_words = sum(map((25).__lt__, map(len, words)))
    features = [np.log1p(n), word_chars / some, symbols / chars, dup_lines / max(len(lines), 1), repeats / some, distinct / some, digits / chars, capitals / chars, long_words / some]
    return [n, word_chars, symbols, dup_lines, repeats], features


def with_statistics(docs: DataFrame, model: Trees | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the counts, the features, ``base_failed``, ``quality_score`` and ``kept`` of every row of ``docs(doc_id, text)``."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, texts = (batch.column(k).slice(at, 1000).to_pylist() for k in (0, 1))
                counts, features, failed, score = judge(texts, model)
                yield {"doc_id": ids, **dict(zip(COUNTS, counts.T)), **dict(zip(FEATURES, features.T)), "base_failed": failed, "quality_score": score, "kept": ~failed & (score >= threshold)}

    schema = ", ".join(["doc_id bigint", *(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in FEATURES), "base_failed boolean, quality_score double, kept boolean"])
    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, schema)


def judge(texts: list[str | None], model: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, features, base failures and scores of some texts; without a model every score is 1."""
    found = [statistics(t) for t in texts]
    counts = np.array([x[0] for x in found], dtype=np.int64).reshape(-1, len(COUNTS))
    features = np.array([x[1] for x in found], dtype=float).reshape(-1, len(FEATURES))
    failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
    return counts, features, failed, np.ones(len(texts)) if model is None else model.probability(features)


def verdict(text: Column, model: Trees | None, threshold: float = 0.5) -> Column:
    """Whether a text is kept."""

    small_batches()
    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 1000):
            _, _, failed, score = judge(texts.iloc[at : at + 1000].tolist(), model)
            out.append(~failed & (score >= threshold))
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return kept(text)


class Trees:
    """Boosted trees for a binary target as flat node arrays, one row a tree."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0, ridge: float = 1.0, monotone: dict[int, int] | None = None):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.monotone = monotone or {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)], axis=1)
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((self.rounds, nodes), -1, np.int32)
        self.cut = np.zeros((self.rounds, nodes))
        self.value = np.zeros((self.rounds, nodes))
        raw = np.full(n, self.start)
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
            at = np.zeros(n, np.int64)
            self.value[t, 0] = g.sum() / (h.sum() + self.ridge)
            for node in range(2**self.depth - 1):
                own = np.flatnonzero(at == node)
                split = self._split(binned[own], g[own], h[own], low[node], high[node]) if len(own) > 1 else None
                if split is None:
                    continue
                k, bin_, left, right = split
                self.feature[t, node], self.cut[t, node] = k, self.cuts[k][bin_]
                a, b = 2 * node + 1, 2 * node + 2
                self.value[t, a], self.value[t, b] = left, right
                low[a], high[a], low[b], high[b] = low[node], high[node], low[node], high[node]
                middle = (left + right) / 2
                if self.monotone.get(k, 0) > 0:
                    high[a], low[b] = middle, middle
                elif self.monotone.get(k, 0) < 0:
                    low[a], high[b] = middle, middle
                at[own] = np.where(binned[own, k] <= bin_, a, b)
            raw += self.rate * self.value[t, at]
        return self

    def _split(self, binned, g, h, low, high):
        best, found = 1e-9, None
        total_g, total_h = g.sum(), h.sum()
        whole = np.clip(total_g / (total_h + self.ridge), low, high)
        gain_of = lambda gs, hs, v: gs * v - 0.5 * (hs + self.ridge) * v * v
        for k in range(binned.shape[1]):
            size = len(self.cuts[k])
            if not size:
                continue
            gs = np.cumsum(np.bincount(binned[:, k], g, size + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[:, k], h, size + 1))[:-1]
            left = np.clip(gs / (hs + self.ridge), low, high)
            right = np.clip((total_g - gs) / (total_h - hs + self.ridge), low, high)
            gain = gain_of(gs, hs, left) + gain_of(total_g - gs, total_h - hs, right) - gain_of(total_g, total_h, whole)
            bad = (hs < self.least) | (total_h - hs < self.least)
            if way := self.monotone.get(k, 0):
                bad |= (right - left) * way < 0
            gain[bad] = -np.inf
            if gain.max(initial=-np.inf) > best:
                bin_ = int(gain.argmax())
                best, found = float(gain[bin_]), (k, bin_, float(left[bin_]), float(right[bin_]))
        return found

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All rows through all trees, a level at a time."""
        raw = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = feature[at]
                at = np.where(k < 0, at, 2 * at + 1 + (x[rows, np.maximum(k, 0)] > cut[at]))
            raw += self.rate * value[at]
        return 1 / (1 + np.exp(-raw))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees | None:
    """Fit on at most ``sample`` labelled documents, those with the smallest hashed ids.

    ``labels`` holds ``doc_id`` and ``quality`` (0 or 1).  Only the sample's ids are broadcast
    and only its features reach the driver.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(known, "doc_id")
    chosen = settle(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    stats = with_statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    one = stats.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"))
    data = one.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "x.*").toPandas().sort_values("doc_id")
    if data["quality"].nunique() < 2:
        return None
    y = (data["quality"].to_numpy() > 0).astype(float)
    return Trees(monotone={FEATURES.index(k): v for k, v in MONOTONE.items()}).fit(data[list(FEATURES)].to_numpy(float), y)
