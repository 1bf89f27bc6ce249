"""Quality rules: exact document statistics and gradient-boosted trees over them.

The trees are grown here by histograms of quantile bins with a logistic loss. On chosen features the
score may only fall as the feature rises: a split against that is not taken, and the two sides'
values are kept on their sides of the split's middle. Grown trees are flattened into numpy node arrays and
a block of documents walks a tree level by level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature names, and whether the score must fall (-1) as they rise or may go either way (0).
FEATURES = {
    "words_log": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "exclaim_per_word": -1, "bar_per_word": -1, "distinct_share": 0, "words_per_line": 0, "stop_per_word": 0, "comma_per_word": 0, "other_punct_per_word": 0, "non_ascii_share": 0,
}
_SPREAD = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(64)]


def repeat_words(words: list[str], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur at two or more places of the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view("u8")
    key = np.zeros(n, "u8")
    for j in range(width):
        key += one[j : j + n] * _SPREAD[j]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[at] > 1)
    if not len(maybe):
        return 0
    windows = {i: " ".join(words[i : i + width]) for i in maybe.tolist()}  # words hold no spaces
    seen = Counter(windows.values())
    edge = np.zeros(len(words) + 1, "i8")
    starts = np.array([i for i, w in windows.items() if seen[w] > 1], "i8")
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def document_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The five exact statistics, and the features of the trees."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols = len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS))
    dup, rep = len(lines) - len(set(lines)), repeat_words(words)
    by = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1"), minlength=256).tolist()
    upper, lower, m = sum(by[65:91]), sum(by[97:123]), max(n, 1)
    other = sum(by[i] for i in range(33, 127) if not chr(i).isalnum()) - symbols - by[33] - by[46] - by[44]
    row = [
        np.log1p(n), chars / m, symbols / m, dup / max(len(lines), 1), rep / m, upper / max(upper + lower, 1), sum(by[48:58]) / max(chars, 1),
        by[33] / m, by[124] / m, len(set(words)) / m, n / max(len(lines), 1), by[46] / m, by[44] / m, other / m, sum(by[128:]) / max(sum(by), 1),
    ]
    return [n, chars, symbols, dup, rep], row


@dataclass
class Forest:
    """Node arrays: a node's feature (-1: leaf), threshold, children and value; roots of the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (self.feature[at] >= 0).any():
                f = self.feature[at]
                step = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f >= 0, step, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Boosted trees for labels 0 and 1; ``signs`` has the monotonic constraint of each feature."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        total = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)

            def leaf(rows: np.ndarray, low: float, high: float) -> float:
                return float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))

            def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
                me = len(nodes)
                nodes.append([-1, 0.0, -1, -1, rate * leaf(rows, low, high)])
                best = (1e-6, None)
                for f in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
                    c, m = code[rows, f], len(edges[f]) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(c, w, m)) for w in (g[rows], h[rows], None))
                    for b in range(m - 1):
                        if ns[b] < least or ns[-1] - ns[b] < least:
                            continue
                        a = np.clip(gs[b] / (hs[b] + ridge), low, high)
                        z = np.clip((gs[-1] - gs[b]) / (hs[-1] - hs[b] + ridge), low, high)
                        if signs[f] * (z - a) < 0:
                            continue
                        gain = gs[b] ** 2 / (hs[b] + ridge) + (gs[-1] - gs[b]) ** 2 / (hs[-1] - hs[b] + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                        if gain > best[0]:
                            best = (gain, (f, b, a, z))
                if best[1]:
                    f, b, a, z = best[1]
                    mid, inside = (a + z) / 2, code[rows, f] <= b
                    under = (mid, high) if signs[f] < 0 else (low, mid) if signs[f] > 0 else (low, high)
                    over = (low, mid) if signs[f] < 0 else (mid, high) if signs[f] > 0 else (low, high)
                    nodes[me][:2] = f, edges[f][b]
                    nodes[me][2] = build(rows[inside], level + 1, *under)
                    nodes[me][3] = build(rows[~inside], level + 1, *over)
                else:
                    total[rows] += nodes[me][4]
                return me

            roots.append(build(np.arange(len(y)), 0, -np.inf, np.inf))
    table = np.array(nodes, "f8").reshape(-1, 5)
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, int), base)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [document_stats(t.as_py())[1] for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "row"])


def fit_rules(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = 4000, where: Column | None = None) -> Forest:
    """Grow the trees on at most ``per_class`` labelled documents of each class (by a hash of doc_id).

    An id with several texts counts once, with the smallest of them; an id with both labels as one row of each; equal rows of
    statistics once. Very long texts are read whole; null ids and other labels don't count. Without labels of both classes, the
    forest is empty and gives the share of label 1 to every document.
    """
    sample, _ = labelled_sample(labels, column, per_class, where)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one_each = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = one_each.mapInArrow(_stats, "doc_id long, label int, row array<double>").collect()  # at most 2 * per_class rows
    found = sorted({(r["doc_id"], r["label"], tuple(r["row"])) for r in found})
    x = np.array([r[2] for r in found], "f8").reshape(-1, len(FEATURES))
    return grow(x, np.array([r[1] for r in found], "f8"), list(FEATURES.values()))


def apply_rules(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """Statistics and verdicts: doc_id, the five STATS, base_failed, quality (probability of label 1), kept.

    A null or empty text has no words and fails the base rules; a very long one is read whole, in the memory of its own words. A
    probability of just ``threshold`` is kept. Repeated rows and null ids each keep their row; other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            stats, x = zip(*(document_stats(t.as_py()) for t in b.column(1)))
            n, p = np.array(stats, "i8"), held.value.probability(np.array(x))
            failed = (n[:, 0] < 20) | (100 * n[:, 4] > 30 * n[:, 0])
            columns = [b.column(0), *(pa.array(c) for c in n.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *STATS, "base_failed", "quality", "kept"])

    return rows.mapInArrow(judge, f"doc_id long, {', '.join(f'{s} long' for s in STATS)}, base_failed boolean, quality double, kept boolean")
