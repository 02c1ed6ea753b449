"""Quality: votes of the nearest labelled documents in a latent semantic space."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, remainder, ship
from .samples import labelled

#: The bound of the sample: so many labelled documents of each class.
MOST = 1500
#: Buckets of words and of shapes; then places for what is counted of a text as a whole.
WORDS, SHAPES, WHOLE = 2048, 512, 48
DIMENSIONS, NEIGHBOURS, BLOCK = 40, 15, 1024
#: Tokens that a worker remembers.
KEPT = 150_000
_SHAPES = [(re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1")]


def _shape(token: str) -> str:
    for pattern, by in _SHAPES:
        token = pattern.sub(by, token)
    return token[:8]


@dataclass
class Terms:
    """Counts of a text's words, shapes of words and traits as a whole, by bucket."""

    known: dict[str, int] = field(default_factory=dict)
    buckets: list[tuple[int, int]] = field(default_factory=list)

    def _of(self, tokens: list[str]) -> list[int]:
        get, out = self.known.get, []
        for t in tokens:
            i = get(t)
            if i is None:
                i = self.known[t] = len(self.buckets)
                self.buckets.append((zlib.crc32(t.lower().encode("utf-8", "replace")) % WORDS, WORDS + zlib.crc32(_shape(t).encode("utf-8", "replace")) % SHAPES))
            out.append(i)
        return out

    def rows(self, texts: Sequence[str]) -> np.ndarray:
        """log(1 + count) of each bucket, and 3 for each trait."""
        if len(self.known) > KEPT:
            self.known.clear()
            self.buckets.clear()
        out = np.zeros((len(texts), WORDS + SHAPES + WHOLE), np.float32)
        ids = [np.array(self._of(t.split()), np.int64) for t in texts]
        buckets = np.array(self.buckets or [(0, WORDS)], np.int64)
        for row, i in zip(out, ids, strict=True):
            if n := len(i):
                counts = np.bincount(buckets[i].ravel(), minlength=WORDS + SHAPES)
                row[: WORDS + SHAPES] = np.log1p(counts)
                kinds = len(np.unique(i))
                repeats = float((i[1:] == i[:-1]).mean()) if n > 1 else 0.0
                traits = (min(15, int(np.log2(n))), 16 + min(7, int(8 * kinds / n)), 24 + min(7, int(8 * repeats)))
                row[[WORDS + SHAPES + t for t in traits]] = 3.0
        return out


@dataclass
class Model:
    """Weights of buckets, their directions, and the labelled documents' unit vectors."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float = 0.0
    terms: Terms = field(default_factory=Terms)

    def project(self, rows: np.ndarray) -> np.ndarray:
        found = (rows * self.weights) @ self.directions
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """The neighbours' labels, weighted by the fourth power of their cosine.

        Products with all labelled vectors are exact, a block of texts at a time.
        """
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(texts), BLOCK):
            cosines = self.project(self.terms.rows(texts[lo : lo + BLOCK])) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosines, near, 1), 1e-6, 1).astype(float) ** 4
            out[lo : lo + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            out[lo : lo + BLOCK][[not t.split() for t in texts[lo : lo + BLOCK]]] = self.share
        return out


def train(texts: Sequence[str], labels: Sequence[int], seed: int = 3) -> Model:
    """Latent directions of the texts' weighted counts, by subspace iteration."""
    terms = Terms()
    rows = np.concatenate([terms.rows(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)])
    weights = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = rows * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(DIMENSIONS, *x.shape))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    model = Model(weights, q.astype(np.float32), np.zeros((0, q.shape[1]), np.float32), np.asarray(labels, float))
    model.vectors = model.project(rows)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST, fold: tuple[int, int] = (5, 0)) -> Model | None:
    """A model from at most ``most`` labelled documents of each class, outside the fold.

    Both classes have the same say, however rare one is. Without any there is
    no model.
    """
    sample, counts = labelled(docs, labels, label, most, fold)
    sample = [(t, int(y)) for t, y in sample if y in (0, 1)]
    if not sample:
        return None
    model = train([t for t, _ in sample], [y for _, y in sample])
    model.share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    return model


def _scoring(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                found = model.scores([t or "" for t in some.column(2).to_pylist()])
                yield pa.record_batch([some.column(0), some.column(1), pa.array(found, pa.float64())], names=["doc_id", "rest", "score"])
        model.terms.known.clear()
        model.terms.buckets.clear()
        give_back()

    return score


def scored(docs: DataFrame, model: Model | None, fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    The model is broadcast: at most 2 * MOST vectors and the directions. Cases:
    null, empty and blank texts have no terms and so no neighbours: their score
    is the share of label 1 among all labels; with no model every score is 0; repeated rows and null ids
    are like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id"), remainder("doc_id", fold[0]).alias("rest"), "text")
    if model is None:
        rows = rows.select("doc_id", "rest", F.lit(0.0).alias("score"))
    else:
        model.terms = Terms()
        rows = rows.mapInArrow(_scoring(spark.sparkContext.broadcast(model)), f"doc_id {dict(docs.dtypes)['doc_id']}, rest bigint, score double")
    return rows.select("doc_id", (F.col("rest") == fold[1]).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
