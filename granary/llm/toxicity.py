"""Toxicity: two Kneser-Ney models, one of toxic and one of ordinary documents.

They model the characters of words, so that the inflections of an expression
share its counts. A word adds the same wherever it stands, and workers remember
what it adds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, remainder, ship
from .samples import labelled
from .shingles import mixed

_WORD = re.compile(r"[^\W_]+")
#: The bound of the sample: so many labelled documents of each class.
MOST = 2500
#: The longest n-gram, and the discounts that are tried.
ORDER = 6
DISCOUNTS = (0.75, 2.0, 5.0, 12.0)
#: What a word begins and ends with.
BEGIN, END = "\x02", "\x03"
#: Words that a worker remembers during a task, and characters that are looked up at once.
KEPT, CHARACTERS = 100_000, 100_000
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed_points(points: np.ndarray) -> np.ndarray:
    return mixed(points.astype(np.uint64) + np.uint64(1))


def _codes(text: str) -> np.ndarray:
    return _mixed_points(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))


def _longer(hashes: np.ndarray, codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of n-grams of ``order`` characters, from those of what is before the last one."""
    return mixed(hashes * _M + codes + np.uint64(order))


@dataclass
class Table:
    """Numbers by the hash of an n-gram: 12 bytes each."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, found: Sequence[tuple[np.ndarray, np.ndarray]]) -> Table:
        keys = np.concatenate([k for k, _ in found])
        order = np.argsort(keys)
        return cls(keys[order], np.concatenate([v for _, v in found])[order].astype(np.float32))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers, 0 where there is none, and where there is one."""
        if not len(self.keys):
            return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        there = self.keys[at] == hashes
        return np.where(there, self.values[at], 0.0), there


@dataclass
class Model:
    """What each character of a word adds to log p(toxic) - log p(ordinary).

    ``grams`` has the n-grams that either class has seen: the ratio of their
    last character's probabilities after the others. For any other n-gram both
    models back off: ``contexts`` has the ratio of the backoff weights, if it is
    not 0, and the n-gram without its first character decides.
    """

    grams: Table
    contexts: Table
    scale: tuple[float, ...] = (1.0, 0.0, 0.0)
    seen: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        return float(self.words([word])[0])

    def words(self, words: Sequence[str]) -> np.ndarray:
        """Each word's sum, all words at once."""
        total, lo = np.zeros(len(words)), 0
        while lo < len(words):
            hi, size = lo, 0
            while hi < len(words) and size < CHARACTERS:
                size += len(words[hi]) + 2
                hi += 1
            total[lo:hi] = self._words(words[lo:hi])
            lo = hi
        return total

    def _words(self, words: Sequence[str]) -> np.ndarray:
        codes = _codes("".join(BEGIN + w + END for w in words))
        long = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        of = np.repeat(np.arange(len(words)), long)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(long) - long, long)
        ending = [np.zeros(len(codes) + 1, np.uint64)]  # ending[k][i + 1]: of the k characters up to the i-th
        for k in range(1, ORDER + 1):
            ending.append(np.r_[np.uint64(0), _longer(ending[-1][:-1], codes, k)])
        at, total = np.flatnonzero(place > 0), np.zeros(len(words))
        for k in range(ORDER, 0, -1):
            mine = place[at] + 1 >= k
            now = at[mine]
            adds, there = self.grams.find(ending[k][now + 1])
            back, _ = self.contexts.find(ending[k - 1][now])
            total += np.bincount(of[now], np.where(there, adds, back), len(words))
            at = np.concatenate([at[~mine], now[~there]])
        return total

    def ratios(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum of log ratios, and its number of words."""
        sums, lengths = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lo in range(0, len(texts), 64):
            found = [_WORD.findall(t.lower()) for t in texts[lo : lo + 64]]
            fresh = set().union(*found).difference(self.seen)
            if len(self.seen) + len(fresh) > KEPT:
                self.seen.clear()
                fresh = set().union(*found)
            some = sorted(fresh)
            self.seen.update(zip(some, self.words(some).tolist(), strict=True))
            for i, words in enumerate(found, lo):
                sums[i], lengths[i] = sum(map(self.seen.__getitem__, words)), len(words)
        return sums, lengths

    @staticmethod
    def features(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 1)
        return np.stack([ratio / n, ratio / np.sqrt(n)], axis=1)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        a, b, c = self.scale
        x = self.features(*self.ratios(texts)) @ np.array([a, b]) + c
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def counted(texts: Sequence[str]) -> Counter:
    """How often a class has each word."""
    words: Counter = Counter()
    for t in texts:
        words.update(_WORD.findall(t.lower()))
    return words


class Grams:
    """The n-grams of two classes' words, as hashes: places of all distinct words, and each class's counts at them.

    Of ORDER-grams it is counted how often they occur, of shorter ones after how
    many characters; what a word begins with has nothing before it, so there
    occurrences count.
    """

    def __init__(self, *classes: Counter):
        words = sorted(set().union(*classes))
        self.points = np.frombuffer("".join(BEGIN + w + END for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        long = np.fromiter((len(w) + 2 for w in words), np.int32, len(words))
        place = np.arange(len(self.points), dtype=np.int32) - np.repeat(np.cumsum(long, dtype=np.int32) - long, long)
        self.classes: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for words_of in classes:
            often = np.repeat(np.fromiter((words_of.get(w, 0) for w in words), np.float32, len(words)), long)
            found, above = {}, np.empty(0, np.int64)
            for k in range(ORDER, 0, -1):
                at = np.flatnonzero((often > 0) & ((place >= k - 1) if k == ORDER else (place == k - 1)) & (place > 0))
                found[k] = self._distinct(np.concatenate([at, above]), np.concatenate([often[at], np.ones(len(above), np.float32)]), k)
                above = found[k][0]
            self.classes.append(found)

    def _hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """Of the k characters up to these places."""
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = _longer(h, _mixed_points(self.points[at - (k - 1) + j]), j + 1)
        return h

    def _distinct(self, at: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each n-gram of k characters that ends at these places, and its sum; some places at a time."""
        places, sums = [np.empty(0, np.int64)], [np.empty(0)]
        for lo in range(0, len(at), CHARACTERS):
            some = at[lo : lo + CHARACTERS]
            _, first, which = np.unique(self._hashes(some, k), return_index=True, return_inverse=True)
            places.append(some[first])
            sums.append(np.bincount(which, n[lo : lo + CHARACTERS], len(first)))
        at, n = np.concatenate(places), np.concatenate(sums)
        _, first, which = np.unique(self._hashes(at, k), return_index=True, return_inverse=True)
        return at[first], np.bincount(which, n, len(first))

    def model(self, discount: float) -> Model:
        """Interpolated Kneser-Ney of characters within words, for each class, over shared backoff counts.

        The lowest order is one for both classes, from the sum of their counts. Any
        order above takes its class's counts, less the discount, and backs off with
        what was taken off; counts up to the discount back off entirely, so that an
        expression that is rare in a class is as likely in both.
        """
        at = np.concatenate([c[1][0] for c in self.classes])
        keys, which = np.unique(self._hashes(at, 1), return_inverse=True)
        singles = np.bincount(which, np.concatenate([c[1][1] for c in self.classes]), len(keys))
        odds = np.repeat(((singles + 1) / (singles.sum() + len(singles) + 1))[:, None], 2, axis=1)
        grams, contexts = [(keys, np.zeros(len(keys)))], []
        for k in range(2, ORDER + 1):
            at = np.concatenate([c[k][0] for c in self.classes])
            own, first = np.unique(self._hashes(at, k), return_index=True)
            at = at[first]
            before, below = self._hashes(at - 1, k - 1), odds[np.searchsorted(keys, self._hashes(at, k - 1))]
            heads, head = np.unique(before, return_inverse=True)
            back = np.ones((len(heads), 2))
            for side, c in enumerate(self.classes):
                mine, n = c[k]
                count = np.zeros(len(own))
                count[np.searchsorted(own, self._hashes(mine, k))] = n
                total = np.bincount(head, count, len(heads))
                there = total > 0
                back[there, side] = np.bincount(head, np.minimum(count, discount), len(heads))[there] / total[there]
                seen = there[head]
                below[seen, side] = np.maximum(count - discount, 0)[seen] / total[head][seen] + (back[head, side] * below[:, side])[seen]
            grams.append((own, np.log(below[:, 0]) - np.log(below[:, 1])))
            ratio = np.log(back[:, 0]) - np.log(back[:, 1])
            contexts.append((heads[ratio != 0], ratio[ratio != 0]))
            keys, odds = own, below
        return Model(Table.of(grams), Table.of(contexts))


def train(toxic: Counter, ordinary: Counter, discount: float = 0.75) -> Model:
    """The model of two classes' words."""
    return Grams(toxic, ordinary).model(discount)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression, by Newton's method with a small penalty."""
    spread = x.std(axis=0) + 1e-9
    z = np.concatenate([x / spread, np.ones((len(x), 1))], axis=1)
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(b)), z.T @ (weight * (y - p)) - 0.01 * b)
        b += np.clip(step, -5, 5)
    return (*(b[:-1] / spread), b[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST, fold: tuple[int, int] = (5, 0)) -> Model | None:
    """A model from at most ``most`` labelled documents of each class, outside the fold.

    Every fifth of the sample chooses the discount and sets the scale: there the
    ratio, divided by the number of words and by its root, becomes a probability
    under the classes' shares among all labels. Without documents of both
    classes there is no model.
    """
    sample, counts = labelled(docs, labels, label, most, fold)
    sides = [[t for t, y in sample if y == c] for c in (1, 0)]
    if not sides[0] or not sides[1]:
        return None
    held = [[t for i, t in enumerate(s) if i % 5 == 0] for s in sides]
    y = np.array([1.0] * len(held[0]) + [0.0] * len(held[1]))
    weight = np.where(y == 1, counts[1] / len(held[0]), counts[0] / len(held[1]))
    found = []
    grams = Grams(*(counted([t for i, t in enumerate(s) if i % 5 or len(s) < 5]) for s in sides))
    for discount in DISCOUNTS:
        model = grams.model(discount)
        x = model.features(*model.ratios(held[0] + held[1]))
        model.scale = _logistic(x, y, weight / weight.mean())
        p = np.clip(1 / (1 + np.exp(-(x @ np.array(model.scale[:2]) + model.scale[2]))), 1e-9, 1 - 1e-9)
        model.seen.clear()
        found.append((float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()), discount, model))
    best = min(found, key=lambda f: f[:2])[2]
    del grams, found, sample, sides, held
    give_back()
    return best


def _scoring(model, carried: int):
    def score(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                found = model.value.scores([t or "" for t in some.column(some.num_columns - 1).to_pylist()])
                yield pa.record_batch([*some.columns[:carried], pa.array(found, pa.float64())], names=[*some.schema.names[:carried], "score"])
        model.value.seen.clear()
        give_back()

    return score


def scored(docs: DataFrame, model: Model | None, fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Only the text is scored. Cases: null and empty texts have no words and get
    the score of no evidence; with no model every score is 0; repeated rows and
    null ids are scored like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id"), remainder("doc_id", fold[0]).alias("rest"), "text")
    if model is None:
        rows = rows.select("doc_id", "rest", F.lit(0.0).alias("score"))
    else:
        shape = f"doc_id {dict(docs.dtypes)['doc_id']}, rest bigint, score double"
        rows = rows.mapInArrow(_scoring(spark.sparkContext.broadcast(model), 2), shape)
    return rows.select("doc_id", (F.col("rest") == fold[1]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, in all their columns."""
    if model is None:
        return docs
    spark = docs.sparkSession
    ship(spark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    model_in = spark.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                scores = model_in.value.scores([t or "" for t in some.column(at).to_pylist()])
                yield some.filter(pa.array(scores < threshold))
        model_in.value.seen.clear()
        give_back()

    return docs.select(*columns).mapInArrow(keep, docs.schema)
