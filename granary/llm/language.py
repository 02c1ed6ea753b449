"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, remainder, ship, stored
from .samples import smallest

_WORD = re.compile(r"[^\W\d_]+")
#: The bounds of the sample and of the tables: documents, words and n-grams of each language.
MOST, MOST_WORDS, MOST_GRAMS = 1000, 30_000, 30_000
LONGEST = 5
UNKNOWN = "und"
#: Words that a worker remembers.
KEPT = 100_000


def _grams(word: str, n: int) -> list[str]:
    framed = f" {word} "
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def _table(counts: list[dict[str, float]], most: int, least: float) -> tuple[dict[str, int], np.ndarray]:
    """Rows of log frequencies by language for the keys that a language has often enough."""
    keys: set[str] = set()
    for c in counts:
        keys.update(k for k, _ in sorted(((k, n) for k, n in c.items() if n >= least), key=lambda x: (-x[1], x[0]))[:most])
    order = sorted(keys)
    totals = [sum(c.values()) for c in counts]
    logs = np.array([[math.log((c.get(k, 0) + 0.1) / (t + 0.1 * (len(order) + 1))) for c, t in zip(counts, totals, strict=True)] for k in order], np.float32).reshape(len(order), len(counts))
    return {k: i for i, k in enumerate(order)}, logs


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: list[tuple[dict[str, int], np.ndarray]]
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def vector(self, word: str) -> np.ndarray:
        """The word's log frequencies, or the mean of its longest known n-grams'."""
        if (i := self.words.get(word)) is not None:
            return self.word_logs[i]
        for n in range(LONGEST, 0, -1):
            known, logs = self.grams[n - 1]
            if found := [known[g] for g in _grams(word, n) if g in known]:
                return logs[found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def predict(self, text: str) -> tuple[str, float]:
        found = _WORD.findall(text.lower())
        if not self.languages or not (any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w)):
            return UNKNOWN, 0.0
        if len(self.seen) > KEPT:
            self.seen.clear()
        seen, total = self.seen, np.zeros(len(self.languages))
        rows = []
        for w in found:
            v = seen.get(w)
            if v is None:
                v = seen[w] = self.vector(w)
            rows.append(v)
            if len(rows) == 4096:
                total += np.sum(rows, axis=0)
                rows = []
        total += np.sum(rows, axis=0) if rows else 0
        best = int(total.argmax())
        # Words are far from independent: their evidence counts with its root.
        odds = np.exp((total - total[best]) / math.sqrt(len(found)))
        return self.languages[best], float(1 / odds.sum())


def fit(docs: DataFrame, most: int = MOST, fold: tuple[int, int] = (4, 2)) -> Model:
    """A model from at most ``most`` documents of each language, outside the fold.

    They are those with the smallest hashes of their ids. Their words are
    counted in Spark; the driver gets each language's MOST_WORDS commonest words
    and takes the n-grams from these, so what it holds grows with the number of
    languages alone.
    """
    rows = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (remainder("doc_id", fold[0]) != fold[1]))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    picked = stored(smallest(rows, "lang", sizes, most).select("doc_id", F.col("lang").alias("learned")).distinct(), "languages")
    words = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id").where(F.col("lang") == F.col("learned"))
    words = words.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").count()
    top = Window.partitionBy("lang").orderBy(F.col("count").desc(), "word")
    found = counted.withColumn("__n", F.row_number().over(top)).where(F.col("__n") <= MOST_WORDS).select("lang", "word", "count").collect()
    languages = sorted({r["lang"] for r in picked.select(F.col("learned").alias("lang")).distinct().collect()})
    counts: list[dict[str, float]] = [{} for _ in languages]
    for r in found:
        counts[languages.index(r["lang"])][r["word"]] = r["count"]
    grams = []
    for n in range(1, LONGEST + 1):
        by: list[dict[str, float]] = [{} for _ in languages]
        for own, c in zip(by, counts, strict=True):
            for w, k in c.items():
                for g in _grams(w, n):
                    own[g] = own.get(g, 0) + k
        grams.append(_table(by, MOST_GRAMS, 2))
    return Model(languages, *_table(counts, MOST_WORDS, 2), grams)


def _predicting(shared):
    def predict(batches):
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                found = [(UNKNOWN, 0.0) if t is None else model.predict(t) for t in some.column(2).to_pylist()]
                yield pa.record_batch([some.column(0), some.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "rest", "lang_pred", "score"])
        model.seen.clear()
        give_back()

    return predict


def predicted(docs: DataFrame, model: Model, fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    Only the text is read. Cases: null texts, texts without a letter and any
    text where nothing was learned are ``und`` with score 0; with equal
    evidence the first language by code point wins; repeated rows and null ids
    are like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id"), remainder("doc_id", fold[0]).alias("rest"), "text")
    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, rest bigint, lang_pred string, score double"
    return rows.mapInArrow(_predicting(spark.sparkContext.broadcast(model)), shape).select("doc_id", (F.col("rest") == fold[1]).alias("held_out"), "lang_pred", "score")


def accuracy(model: Model, texts: Sequence[str], langs: Sequence[str]) -> float:
    return sum(model.predict(t)[0] == x for t, x in zip(texts, langs, strict=True)) / max(1, len(texts))
