"""Quality scores by nearest-neighbour voting in a latent semantic space.

A document's vector: counts of its hashed byte 3-grams and of words that repeat the word before, damped by
a logarithm, weighted by inverse document frequency, turned by the leading right singular vectors of a bounded sample of labelled
documents and brought to length one. Each task holds the labelled vectors (a broadcast of at most
``2 * per_class`` rows), multiplies its documents with them block by block, and lets the ``k``
nearest vote, by a power of the cosine and by how many rows of its class a neighbour stands for. Of neighbours with
equal cosines (to six digits) those of the smallest doc_id count. How much repeated words and the cosine weigh is
chosen among ``CHOICES`` by folds of the rows learned from alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .common import labelled_sample, passing_schema

WIDTH = 4096
#: Weight of repeated words beside one 3-gram, and power of the cosine; the first of the best on the inner folds is taken.
CHOICES = ((0.0, 5), (0.0, 20), (4.0, 5), (4.0, 20))
FOLDS = 3
RANK = 64
NEIGHBOURS = 25
BLOCK = 512
#: Bytes hashed at a time, so that a very long text needs no more memory than its own.
STRIDE = 1 << 20


@dataclass
class KnnModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    power: int


def counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte 3-grams of a whole text, and of words equal to the word before them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw, words = np.frombuffer(data, "u1"), data.split()
    total = np.zeros(WIDTH + 1, "f4")
    total[WIDTH] = sum(map(eq, words, words[1:]))
    for at in range(0, max(0, len(raw) - 2), STRIDE):
        b = raw[at : at + STRIDE + 2].astype("u4")
        code = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
        total[:WIDTH] += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=WIDTH)
    return total


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def project(x: np.ndarray, model: KnnModel) -> np.ndarray:
    return _unit(_unit(np.log1p(x) * model.idf) @ model.basis)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """For each row, the columns of the ``k`` largest values, of equal ones the first."""
    least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above, equal = cosine > least, cosine == least
    chosen = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True))
    return np.nonzero(chosen)[1].reshape(len(cosine), k)


def vote(x: np.ndarray, model: KnnModel) -> np.ndarray:
    """Scores of counted documents: exact cosines with every labelled vector, then the nearest vote."""
    if not len(model.labels):
        return np.full(len(x), model.prior)
    cosine = np.round(project(x, model) @ model.vectors.T, 6)
    near = nearest(cosine, min(NEIGHBOURS, len(model.labels)))
    w = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype("f8") ** model.power * model.weights[near]
    total = w.sum(1)
    return np.where((total > 0) & (x.sum(1) > 0), (w * model.labels[near]).sum(1) / np.maximum(total, 1e-300), model.prior)


def build(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], repeats: float, power: int) -> KnnModel:
    """A model of counted, labelled documents; ``sizes`` has the number of rows that each class stands for."""
    all_rows = sum(sizes.values())
    prior = sizes.get(1, 0) / all_rows if all_rows else 0.5
    x = np.log1p(x)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype("f4") + 1
    idf[WIDTH] *= repeats
    x = _unit(x * idf)
    rank = min(RANK, *x.shape)
    basis = np.zeros((WIDTH + 1, 0), "f4")
    if rank:
        q = np.random.default_rng(7).standard_normal((WIDTH + 1, min(rank + 16, *x.shape))).astype("f4")
        for _ in range(4):  # subspace iteration for the leading right singular vectors
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
        basis = (q @ turn.T)[:, :rank].astype("f4")
    weights = np.array([sizes.get(int(c), 0) / max(1, (y == c).sum()) for c in y])
    return KnnModel(idf, basis, _unit(x @ basis), y, weights, prior, power)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs of both classes that are in the right order, equal scores as half; 0.5 without both."""
    one, zero = np.sort(score[y == 1]), np.sort(score[y == 0])
    if not len(one) or not len(zero):
        return 0.5
    return float((np.searchsorted(zero, one, "left") + np.searchsorted(zero, one, "right")).sum() / (2 * len(one) * len(zero)))


def choose(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], threshold: float = 0.3) -> tuple[float, int]:
    """The first of ``CHOICES`` that is the best over the folds, to three digits: by the mean of AUC and of both
    classes' shares that fall on their side of the threshold."""
    if len(set(y)) < 2 or len(y) < 10 * FOLDS:
        return CHOICES[-1]
    fold, found = np.arange(len(y)) % FOLDS, dict.fromkeys(CHOICES, 0.0)
    for f in range(FOLDS):
        models: dict[float, KnnModel] = {}
        for repeats, power in CHOICES:
            if repeats not in models:
                models[repeats] = build(x[fold != f], y[fold != f], sizes, repeats, power)
            score, truth = vote(x[fold == f], replace(models[repeats], power=power)), y[fold == f]
            sides = [((score >= threshold) == c)[truth == c].mean() for c in (0, 1) if (truth == c).any()]
            found[repeats, power] += (auc(score, truth) + sum(sides) / len(sides)) / (2 * FOLDS)
    best = max(round(v, 3) for v in found.values())
    return next(c for c, v in found.items() if round(v, 3) == best)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [zlib.compress(counts(t.as_py()).astype("<f4").tobytes(), 1) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "label", "counts"])


def fit_knn(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = 2000, where: Column | None = None) -> KnnModel:
    """Fit on at most ``per_class`` labelled documents of each class (by a hash of doc_id).

    ``where`` limits the labels that may be learned from. Labelled ids without a document are passed
    over, of several texts of one id the smallest counts; without any labels the model gives 0.5 to everything. Columns other than doc_id, text and
    the label are never looked at.
    """
    sample, sizes = labelled_sample(labels, column, per_class, where)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one_each = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = one_each.mapInArrow(_counted, "doc_id long, label int, counts binary").collect()  # at most 2 * per_class rows
    found = sorted({(r["doc_id"], r["label"], bytes(r["counts"])) for r in found})
    y = np.array([r[1] for r in found], "f8")
    x = np.array([np.frombuffer(zlib.decompress(r[2]), "<f4") for r in found]).reshape(-1, WIDTH + 1)
    return build(x, y, sizes, *choose(x, y, sizes))


def score_documents(docs: DataFrame, model: KnnModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold).

    Only the text is looked at, a very long one whole; a null or empty one gets the share of label 1. Other columns
    and null ids pass through; columns already named score or predicted are replaced. Repeated rows each get their
    score; an empty table gives no rows. A score equal to the threshold is predicted as 1.
    """
    rows, schema = passing_schema(docs, ("score", DoubleType()), ("predicted", IntegerType()))
    at = [c.lower() for c in rows.columns].index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                b = batch.slice(i, BLOCK)
                s = np.clip(vote(np.array([counts(t.as_py()) for t in b.column(at)]), held.value), 0, 1)
                columns = [*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype("i4"))]
                yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "score", "predicted"])

    return rows.mapInArrow(score, schema)
