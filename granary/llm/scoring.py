"""Language-model scores from a hierarchical Pitman-Yor model.

A context is the word before; its restaurant serves the words that follow it,
at any size of the input. A restaurant that would outgrow a task is dealt out,
by the words that it serves, among several buckets; its customers and tables
are added up over all of them, so its numbers are those of a whole one. For a
new table a context's restaurant sends a customer to the corpus's, the parent that
all contexts share; below that lies one base: equal shares for all words of the
training documents and one more for any other word.

Seating is sampled by blocked Gibbs: the customers of a dish rise together and
are seated anew under the parent's probabilities as they now are. At first each
dish has one table in each context. A sweep seats all contexts and then the
corpus; the predictive probabilities of all sweeps are averaged. Chances come
from the hashes of context and word and from the sweep, so a word's seating is
the same wherever and whenever it is worked out, and no seating is stored: each
pass over the contexts repeats it from the parents' probabilities of the sweeps
before.

How it is spread: documents are tokenised once, in stretches. Each stretch
sends its distinct pairs (context, word), by the hash of the context, to
buckets, and its words to others, and gets numbers back in the order sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, release, remainder, ship, stored
from .shingles import flat, mixed, word_hashes

#: What ends each document, and what comes before its first word; no word has this hash.
END = np.uint64(1)
#: Tokens of a stretch and for each bucket of contexts; words sent for each bucket of words; texts that are read at once.
STRETCH, BUCKET, WORDS, MOST_ROOTS, TEXTS = 1_200_000, 1_200_000, 2_000_000, 2048, 256
#: A context with more than this part of a bucket's tokens is dealt out. The tables of such contexts are sent to this bucket.
SHARE, WHOLE = 0.25, -1
#: Strengths of the contexts' restaurants and of the corpus's, and the sweeps that are averaged.
STRENGTH, ROOT_STRENGTH, SWEEPS = 2.0, 1.0, 2
_M = np.uint64(0x9E3779B97F4A7C15)


def _uniform(seeds: np.ndarray, k: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seed and k alone."""
    x = seeds + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def seated(customers: np.ndarray, pull: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables after so many customers of a dish sat down, each array item a dish.

    With n customers at t tables the next one opens a table with probability
    pull / (pull + n - discount * t); ``pull`` is the restaurant's weight of a new
    table times the parent's probability of the dish. Up to 16 customers are
    seated one by one; beyond, an eighth more at a time, who share one chance:
    how many of them open a table is drawn from the normal distribution nearest
    to theirs, or by one draw where it is rarely any. So the rounds grow with the
    logarithm of the customers.
    """
    tables = (customers > 0).astype(float)
    for n in range(1, 16):
        at = np.flatnonzero(customers > n)
        if not len(at):
            return tables
        tables[at] += _uniform(seeds[at], n) * (pull[at] + n - discount * tables[at]) < pull[at]
    at = np.flatnonzero(customers > 16)
    sat, k = np.full(len(at), 16.0), 16
    while len(at):
        block = np.minimum(np.ceil(sat / 8), customers[at] - sat)
        chance = pull[at] / (pull[at] + sat + block / 2 - discount * tables[at])
        mean = block * chance
        u = _uniform(seeds[at], k)
        normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(seeds[at], k + 1))
        opened = np.where(mean < 0.5, u < mean, np.clip(np.floor(mean + np.sqrt(mean * (1 - chance)) * normal + 0.5), 0, block))
        tables[at] += opened
        sat, k = sat + block, k + 2
        on = sat < customers[at]
        at, sat = at[on], sat[on]
    return tables


# ---- the model of one bucket ----


@dataclass
class Root:
    """What all buckets have of the corpus's restaurant after a sweep."""

    words: int
    customers: float
    tables: float
    discount: float

    def probabilities(self, stay: np.ndarray) -> np.ndarray:
        """Of words, from their customers less the discounted tables; 0 stands for any word that is not known."""
        return (stay + (ROOT_STRENGTH + self.discount * self.tables) / (self.words + 1)) / (ROOT_STRENGTH + self.customers)


def _none() -> np.ndarray:
    return np.empty(0, np.int64)


@dataclass
class Split:
    """Contexts that are dealt out, by their words in order: parts, customers and, after each sweep, tables of them as wholes."""

    words: np.ndarray
    parts: np.ndarray
    customers: np.ndarray
    tables: list[np.ndarray] = field(default_factory=list)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all parts, in order, and the context of each by number."""
        of = np.repeat(np.arange(len(self.words)), self.parts)
        hashes = _head(self.words[of], np.arange(len(of)) - (np.cumsum(self.parts) - self.parts)[of])
        order = np.argsort(hashes)
        return hashes[order], of[order]


def _head(words: np.ndarray, part: np.ndarray) -> np.ndarray:
    return mixed(words + part.astype(np.uint64) * _M)


def _found(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of those values that are among the sorted ones, and where they are there."""
    at = np.searchsorted(sorted_, values)
    here = np.flatnonzero(np.append(sorted_, sorted_[-1:])[at] == values) if len(sorted_) else _none()
    return here, at[here]


@dataclass
class Contexts:
    """A bucket's pairs in order of context and word: hashes, each pair's context and word by number, and its count.

    Of contexts that are parts: their numbers, that of the whole, its customers and its tables after each sweep.
    """

    contexts: np.ndarray
    words: np.ndarray
    context: np.ndarray
    word: np.ndarray
    count: np.ndarray
    part: np.ndarray = field(default_factory=_none)
    whole: np.ndarray = field(default_factory=_none)
    customers: np.ndarray = field(default_factory=_none)
    tables: list[np.ndarray] = field(default_factory=list)

    def _of(self, tables: np.ndarray, sweep: int) -> np.ndarray:
        """Tables by context; a part has its own ones alone as long as the whole's are not known."""
        of = np.bincount(self.context, tables, len(self.contexts))
        if sweep < len(self.tables):
            of[self.part] = self.tables[sweep]
        return of

    def sweeps(self, parents: list[np.ndarray], discount: float, strength: float = STRENGTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each sweep's tables by pair and by context; ``parents`` has the words' probabilities before each but the first."""
        tables = (self.count > 0).astype(float)
        of = self._of(tables, 0)
        yield tables, of
        seeds = mixed(self.contexts[self.context] * _M ^ self.words[self.word])
        for j, p in enumerate(parents, 1):
            pull = (strength + discount * of[self.context]) * p[self.word]
            tables = seated(self.count, pull, discount, seeds + np.uint64((j * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
            of = self._of(tables, j)
            yield tables, of

    def predictive(self, parents: list[np.ndarray], discount: float, strength: float = STRENGTH) -> np.ndarray:
        """Each pair's probability of the word after the context, averaged over the sweeps after the first."""
        customers = np.bincount(self.context, self.count, len(self.contexts))
        customers[self.part] = self.customers
        total = np.zeros(len(self.count))
        for j, (tables, of) in enumerate(self.sweeps(parents[:-1], discount, strength)):
            if j:
                back = (strength + discount * of[self.context]) * parents[j][self.word]
                total += (self.count - discount * tables + back) / (strength + customers[self.context])
        return total / (len(parents) - 1)


def discount_of(ones: float, twos: float) -> float:
    return min(0.9, max(0.1, ones / max(1.0, ones + 2 * twos)))


# ---- packed numbers ----


def _pack(x: np.ndarray, width: int = 4) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _unpack(data: bytes, width: int = 4) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").reshape(-1).astype(np.int64)


#: Bytes of what is counted over all documents.
WIDE = 8


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hashes' buckets; they ascend with the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slices(places: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    at = np.searchsorted(places, np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, slice(int(at[k]), int(at[k + 1]))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: their numbers and bytes take far more room than the rows."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    held: list[dict] = []
    for row in _records(batches):
        row = {k: v.as_py() for k, v in row.items()}
        if held and held[0][key] != row[key]:
            yield held[0][key], held
            held = []
        held.append(row)
    if held:
        yield held[0][key], held


# ---- stretches ----

_STRETCH = "stretch long, tokens long, learnt long, docs array<{0}>, held array<boolean>, lengths array<int>, ids binary, words binary, counts binary"


def _stretching(kind: pa.DataType):
    def stretch(batches: Iterator[pa.RecordBatch]):
        made, part, size = 0, TaskContext.get().partitionId(), 0
        docs, held, tokens, lengths = [], [], [], []

        def told():
            long = np.concatenate(lengths)
            words, ids, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            rank = np.argsort(-often, kind="stable")
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            ids, words = place[ids], words[rank]
            out = np.concatenate(held)
            counts = np.bincount(ids[~np.repeat(out, long)], minlength=len(words))
            row = {"stretch": [part << 24 | made], "tokens": [len(ids)], "learnt": [int(counts.sum())]}
            row = {k: pa.array(v, pa.int64()) for k, v in row.items()}
            row |= {"docs": pa.array([[x for d in docs for x in d.to_pylist()]], pa.list_(kind)), "held": pa.array([out], pa.list_(pa.bool_())), "lengths": pa.array([long.astype(np.int32)], pa.list_(pa.int32()))}
            return pa.record_batch(row | {"ids": pa.array([_pack(ids)], pa.binary()), "words": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([_pack(counts)], pa.binary())})

        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                some = batch.slice(lo, TEXTS)
                h, at = word_hashes(*flat(some.column(1)))
                tokens.append(np.insert(h, at[1:], END))
                lengths.append(np.diff(at) + 1)
                docs.append(some.column(0))
                held.append(some.column(2).to_numpy(zero_copy_only=False))
                size += len(tokens[-1])
                if size >= STRETCH:
                    yield told()
                    made, size = made + 1, 0
                    docs, held, tokens, lengths = [], [], [], []
        if size:
            yield told()
        give_back()

    return stretch


def _words(row: dict) -> np.ndarray:
    return np.frombuffer(row["words"].as_py(), np.uint64)


@dataclass
class Pairs:
    """A stretch's distinct pairs in order of bucket, context and word, by hashes; ``which`` has each token's."""

    bucket: np.ndarray
    context: np.ndarray
    words: np.ndarray
    word: np.ndarray
    which: np.ndarray


def pairs_of(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray, split: Split, buckets: int) -> Pairs:
    """The pairs of a context that is dealt out are so by the word after."""
    end = np.flatnonzero(words == END)[0]
    before = np.r_[end, ids[:-1]]  # documents end with the end
    parts = np.ones(len(words), np.int64)
    here, at = _found(split.words, words)
    parts[here] = split.parts[at]
    code = before + len(words) * ((mixed(words) >> np.uint64(20)).astype(np.int64)[ids] % parts[before])
    codes, context = np.unique(code, return_inverse=True)
    kind, word = codes // len(words), words[codes % len(words)]
    hashes = _head(word, kind)
    order = np.argsort(hashes, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    hashes = hashes[order]
    up = np.argsort(words)
    rank = np.empty_like(up)
    rank[up] = np.arange(len(up))
    pairs, which = np.unique(place[context] << 32 | rank[ids], return_inverse=True)
    return Pairs(_part(hashes, buckets)[pairs >> 32], hashes[pairs >> 32], words[up], pairs & 0xFFFFFFFF, which)


# ---- words: their counts, and the corpus's restaurant ----


def _word_cells(parts: int):
    def cells(batches: Iterator[pa.RecordBatch]):
        for row in _records(batches):
            words, counts = _words(row), _unpack(row["counts"].as_py())
            order = np.argsort(words)
            yield _sent(row["stretch"].as_py(), words[order], counts[order], parts)

    return cells


def _sent(sender: int, words: np.ndarray, numbers: np.ndarray, parts: int) -> pa.RecordBatch:
    found = [(k, words[s].tobytes(), _pack(numbers[s], WIDE)) for k, s in _slices(_part(words, parts), parts)]
    return pa.record_batch({"bucket": pa.array([f[0] for f in found], pa.int64()), "sender": pa.array([sender] * len(found), pa.int64()), "words": pa.array([f[1] for f in found], pa.binary()), "numbers": pa.array([f[2] for f in found], pa.binary())})


_SENT = "bucket long, sender long, words binary, numbers binary"
#: Answers have a sender; a bucket's own row has none, but its totals, and words that are frequent with their counts; WHOLE has contexts with their tables.
_SUMMED = "bucket long, sender long, values binary, totals array<double>, often array<bigint>, counts array<bigint>"


def _summing(answer: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[float]]], most: float = np.inf):
    """Adds up each word's numbers; each sender gets the answers for its words, as single-precision numbers or as counts."""

    def told(bucket: int, sender: int | None, values=None, totals=None, often=None, counts=None):
        return pa.record_batch(
            {"bucket": pa.array([bucket], pa.int64()), "sender": pa.array([sender], pa.int64()), "values": pa.array([values], pa.binary()), "totals": pa.array([totals], pa.list_(pa.float64())), "often": pa.array([often], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64()))}
        )

    def add(batches: Iterator[pa.RecordBatch]):
        for bucket, rows in _groups(batches, "bucket"):
            each = [np.frombuffer(r["words"], np.uint64) for r in rows]
            words, which = np.unique(np.concatenate(each), return_inverse=True)
            sums = np.bincount(which, np.concatenate([_unpack(r["numbers"], WIDE) for r in rows]), len(words))
            if bucket == WHOLE:
                yield told(bucket, None, None, None, words.view(np.int64), sums.astype(np.int64))
                continue
            values, totals = answer(words, sums)
            lo = 0
            for r, own in zip(rows, each, strict=True):
                some = values[which[lo : lo + len(own)]]
                yield told(bucket, r["sender"], some.tobytes() if some.dtype.kind == "f" else _pack(some, WIDE))
                lo += len(own)
            hot = np.flatnonzero(sums > most)
            yield told(bucket, None, None, totals, words[hot].view(np.int64), sums[hot].astype(np.int64))
        give_back()

    return add


def _by(rows: DataFrame, key: str, parts: int, *order: str) -> DataFrame:
    return rows.repartition(parts, key).sortWithinPartitions(key, *order)


def _counting(words: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list[float]]:
    return sums.astype(np.int64), [float(sums.sum()), float((sums > 0).sum()), float((sums == 1).sum()), float((sums == 2).sum())]


def _seating(root: Root, sweep: int):
    def seat(words: np.ndarray, customers: np.ndarray) -> tuple[np.ndarray, list[float]]:
        pull = np.full(len(words), (ROOT_STRENGTH + root.discount * root.tables) / (root.words + 1))
        tables = seated(customers, pull, root.discount, mixed(words + np.uint64((sweep + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)))
        return (customers - root.discount * tables).astype("<f4"), [float(customers.sum()), float(tables.sum())]

    return seat


# ---- contexts ----

_CELL = "bucket long, sender long, contexts binary, sizes binary, words binary, ids binary, counts binary"
_BUCKET = "bucket long, contexts binary, sizes binary, words binary, ids binary, counts binary, senders array<bigint>, lengths array<int>, places binary, ones long, twos long"


def _context_cells(shared, buckets: int):
    def cells(batches: Iterator[pa.RecordBatch]):
        for row in _records(batches):
            words, ids = _words(row), _unpack(row["ids"].as_py())
            lengths = row["lengths"].values.to_numpy(zero_copy_only=False)
            found = pairs_of(ids, lengths, words, shared.value, buckets)
            learnt = ~np.repeat(row["held"].values.to_numpy(zero_copy_only=False), lengths)
            counts = np.bincount(found.which[learnt], minlength=len(found.word))
            for k, s in _slices(found.bucket, buckets):
                context = found.context[s]
                first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                own, at = np.unique(found.word[s], return_inverse=True)
                values = {"contexts": context[first].tobytes(), "sizes": _pack(np.diff(np.r_[first, len(context)])), "words": found.words[own].tobytes(), "ids": _pack(at), "counts": _pack(counts[s])}
                yield pa.record_batch({"bucket": pa.array([k], pa.int64()), "sender": pa.array([row["stretch"].as_py()], pa.int64()), **{c: pa.array([v], pa.binary()) for c, v in values.items()}})

    return cells


def _gathering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's cells as one table of pairs, and where each cell's pairs are in it."""
    for bucket, rows in _groups(batches, "bucket"):
        words, word = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]), return_inverse=True)
        heads, head = np.unique(np.concatenate([np.frombuffer(r["contexts"], np.uint64) for r in rows]), return_inverse=True)
        context, at, lo, hi = [], [], 0, 0
        for r in rows:
            sizes, ids = _unpack(r["sizes"]), _unpack(r["ids"])
            context.append(np.repeat(head[lo : lo + len(sizes)], sizes))
            at.append(word[hi : hi + len(r["words"]) // 8][ids])
            lo, hi = lo + len(sizes), hi + len(r["words"]) // 8
        lengths = np.array([len(x) for x in at])
        pairs, which = np.unique(np.concatenate(context) << 32 | np.concatenate(at), return_inverse=True)
        counts = np.bincount(which, np.concatenate([_unpack(r["counts"]) for r in rows]), len(pairs)).astype(np.int64)
        # Cells have their pairs in the bucket's order, so that places ascend in each.
        steps = np.diff(which, prepend=0)
        firsts = np.cumsum(lengths) - lengths
        steps[firsts] = which[firsts]
        values = {"contexts": heads.tobytes(), "sizes": _pack(np.bincount(pairs >> 32, minlength=len(heads))), "words": words.tobytes(), "ids": _pack(pairs & 0xFFFFFFFF), "counts": _pack(counts, WIDE), "places": _pack(steps)}
        row = {"bucket": pa.array([bucket], pa.int64()), **{c: pa.array([v], pa.binary()) for c, v in values.items()}}
        row |= {"senders": pa.array([[r["sender"] for r in rows]], pa.list_(pa.int64())), "lengths": pa.array([lengths.astype(np.int32)], pa.list_(pa.int32()))}
        row |= {"ones": pa.array([int((counts == 1).sum())], pa.int64()), "twos": pa.array([int((counts == 2).sum())], pa.int64())}
        yield pa.record_batch(row).select([c.split()[0] for c in _BUCKET.split(", ")])
    give_back()


def _contexts(row: dict, split: Split) -> Contexts:
    heads = np.frombuffer(row["contexts"].as_py(), np.uint64).copy()
    sizes = _unpack(row["sizes"].as_py())
    hashes, of = split.heads()
    part, at = _found(hashes, heads)
    whole = of[at]
    heads[part] = mixed(split.words[whole])
    pairs = np.repeat(np.arange(len(heads)), sizes), _unpack(row["ids"].as_py()), _unpack(row["counts"].as_py(), WIDE).astype(float)
    return Contexts(heads, _words(row), *pairs, part, whole, split.customers[whole], [t[whole] for t in split.tables])


def _parents(row: dict, roots: list[Root]) -> list[np.ndarray]:
    """The words' probabilities after each sweep; answers are in the order of the words, a sweep after the other."""
    found = sorted(row["answers"].as_py(), key=lambda a: (a["sweep"], a["bucket"])) if roots else []
    return [root.probabilities(np.frombuffer(b"".join(a["values"] for a in found if a["sweep"] == j), "<f4").astype(float)) for j, root in enumerate(roots)]


def _sweeping(shared, parts: int):
    """Sends each word's tables in the bucket's contexts, after as many sweeps as there are probabilities."""

    def sweep(batches: Iterator[pa.RecordBatch]):
        roots, discount, split = shared.value
        for row in _records(batches):
            model, bucket = _contexts(row, split), row["bucket"].as_py()
            *_, (tables, of) = model.sweeps(_parents(row, roots), discount)
            yield _sent(bucket, model.words, np.bincount(model.word, tables, len(model.words)), parts)
            if len(model.part):
                own = {"words": split.words[model.whole].tobytes(), "numbers": _pack(of[model.part], WIDE)}
                yield pa.record_batch({"bucket": pa.array([WHOLE], pa.int64()), "sender": pa.array([bucket], pa.int64()), **{c: pa.array([v], pa.binary()) for c, v in own.items()}})
        give_back()

    return sweep


def _predicting(shared):
    """For each stretch the log10 probabilities of the pairs that it sent."""

    def predict(batches: Iterator[pa.RecordBatch]):
        roots, discount, split = shared.value
        for row in _records(batches):
            logs = np.log10(_contexts(row, split).predictive(_parents(row, roots), discount)).astype("<f4")
            steps, lo = _unpack(row["places"].as_py()), 0
            for sender, long in zip(row["senders"].as_py(), row["lengths"].as_py(), strict=True):
                yield pa.record_batch({"stretch": pa.array([sender], pa.int64()), "bucket": pa.array([row["bucket"].as_py()], pa.int64()), "values": pa.array([logs[np.cumsum(steps[lo : lo + long])].tobytes()], pa.binary())})
                lo += long
        give_back()

    return predict


# ---- scores ----


def _joined(answers: pa.Scalar, read: Callable[[bytes], np.ndarray]) -> np.ndarray:
    return np.concatenate([read(a["values"]) for a in sorted(answers.as_py(), key=lambda a: a["bucket"])])


def _scoring(shared, buckets: int, tokens: int, distinct: int):
    def score(batches: Iterator[pa.RecordBatch]):
        for row in _records(batches):
            words, ids = _words(row), _unpack(row["ids"].as_py())
            lengths = row["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64)
            count = np.empty(len(words))
            count[np.argsort(words)] = _joined(row["known"], lambda v: _unpack(v, WIDE))
            logs = _joined(row["logs"], lambda v: np.frombuffer(v, "<f4")).astype(float)[pairs_of(ids, lengths, words, shared.value, buckets).which]
            base = np.log10((count + 0.1) / (tokens + 0.1 * (distinct + 1)))
            firsts = np.cumsum(lengths) - lengths
            by = lambda x: pa.array(np.add.reduceat(x, firsts))
            yield pa.record_batch({"doc_id": row["docs"].values, "held_out": row["held"].values, "n_tokens": pa.array(lengths), "n_known": by((count > 0).astype(np.int64)[ids]), "train_tokens": pa.array(np.full(len(lengths), tokens, np.int64)), "base_score": by(base[ids]), "score": by(logs)})
        give_back()

    return score


def scored(docs: DataFrame, fold: tuple[int, int] = (10, 0), sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Cases: null, empty and blank texts are one end; rows with a null doc_id
    belong to the fold of empty text; repeated rows are documents of their own;
    without any document to learn from, base_score is 0 and any word is the one
    beyond the training words; an empty table gives an empty result. Only doc_id,
    of any type, and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", (remainder("doc_id", fold[0]) == fold[1]).alias("held"))
    arrow = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    parts = stored(rows.mapInArrow(_stretching(arrow), _STRETCH.format(kind)), "stretches")
    tally = parts.agg(F.sum("tokens").alias("tokens"), F.sum("learnt").alias("learnt"), F.sum(F.octet_length("words")).alias("words")).first()
    every, learnt = tally["tokens"] or 0, tally["learnt"] or 0
    buckets = max(1, -(-every // BUCKET))
    roots = min(MOST_ROOTS, max(1, -(-(tally["words"] or 0) // (8 * WORDS))))

    most = max(1.0, SHARE * every / buckets)
    known = stored(_by(parts.select("stretch", "words", "counts").mapInArrow(_word_cells(roots), _SENT), "bucket", roots, "sender").mapInArrow(_summing(_counting, most), _SUMMED), "known")
    own = known.where("sender IS NULL")
    tokens, distinct, ones, twos = (float(x or 0) for x in own.select([F.sum(F.col("totals")[i]) for i in range(4)]).first())
    # No more than 1 / SHARE words for each bucket are so frequent.
    hot = own.select(F.explode(F.arrays_zip("often", "counts")).alias("w")).select("w.*").collect()
    hot = sorted((r["often"] & 0xFFFFFFFFFFFFFFFF, r["counts"]) for r in hot)
    # Each time that a word to learn from occurs, one token follows it, an end the first word of another document.
    customers = np.array([n for _, n in hot], float)
    split = Split(np.array([w for w, _ in hot], np.uint64), np.ceil(customers / most).astype(np.int64), customers)
    dealt = spark.sparkContext.broadcast(split)

    cells = parts.select("stretch", "held", "lengths", "ids", "words").mapInArrow(_context_cells(dealt, buckets), _CELL)
    contexts = stored(_by(cells, "bucket", buckets, "sender").mapInArrow(_gathering, _BUCKET), "contexts")
    few = contexts.agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    discount = discount_of(few["ones"] or 0, few["twos"] or 0)
    state: list[Root] = []
    answers: list[DataFrame] = []
    kept = [contexts]

    def with_answers(columns: list[str]) -> DataFrame:
        if not answers:
            return contexts.select(*columns)
        both = answers[0]
        for a in answers[1:]:
            both = both.union(a)
        both = both.groupBy(F.col("sender").alias("bucket")).agg(F.collect_list(F.struct("sweep", F.col("bucket").alias("bucket"), "values")).alias("answers"))
        return contexts.select(*columns).join(both, "bucket")

    pairs = ["bucket", "contexts", "sizes", "words", "ids", "counts"]
    for j in range(sweeps + 1):
        before = Root(int(distinct), 0.0, state[-1].tables if state else distinct, discount_of(ones, twos))
        sent = with_answers(pairs).mapInArrow(_sweeping(spark.sparkContext.broadcast((list(state), discount, split)), roots), _SENT)
        found = stored(_by(sent, "bucket", roots, "sender").mapInArrow(_summing(_seating(before, j)), _SUMMED), f"sweep-{j}")
        told = found.where("sender IS NULL").select("totals", "often", "counts").collect()
        customers, tables = (float(sum(r["totals"][i] for r in told if r["totals"] is not None)) for i in range(2))
        wholes = {w & 0xFFFFFFFFFFFFFFFF: n for r in told if r["totals"] is None for w, n in zip(r["often"], r["counts"], strict=True)}
        split = replace(split, tables=[*split.tables, np.array([wholes[w] for w in split.words.tolist()], float)])
        state.append(Root(before.words, customers, tables, before.discount))
        kept.append(found)
        answers.append(found.where("sender IS NOT NULL").select("sender", "bucket", F.lit(j).alias("sweep"), "values"))

    last = spark.sparkContext.broadcast((list(state), discount, split))
    logs = stored(with_answers([*pairs, "senders", "lengths", "places"]).mapInArrow(_predicting(last), "stretch long, bucket long, values binary"), "logs")
    release(*kept)
    numbers = known.where("sender IS NOT NULL").select(F.col("sender").alias("stretch"), F.lit("known").alias("what"), "bucket", "values").union(logs.select("stretch", F.lit("logs").alias("what"), "bucket", "values"))
    one = F.struct("bucket", "values")
    numbers = numbers.groupBy("stretch").agg(*[F.collect_list(F.when(F.col("what") == w, one)).alias(w) for w in ("known", "logs")])
    found = parts.select("stretch", "docs", "held", "lengths", "ids", "words").join(numbers, "stretch")
    return found.mapInArrow(_scoring(dealt, buckets, int(tokens), int(distinct)), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame, held_out: bool = True, column: str = "score") -> float:
    """10 to the mean negative log10 probability of a token."""
    r = scores.where(F.col("held_out") == held_out).agg(F.sum(column).alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-r["s"] / r["n"])
