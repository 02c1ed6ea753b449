"""An exact join of documents whose sets of word n-grams are alike.

Sets are compared by the Jaccard measure. The steps:

1. Tokens that many documents hold, the frequent class, are put last in one
   order of all tokens; within a class the order is by hash. Which tokens these
   are is an estimate from the commonest of each stretch of rows; it decides
   what the join costs and never what it finds.
2. Documents with equal sets become one. Sets that link share a token among
   the first ``n - least overlap + 1`` of each, the prefix. If the first token
   that they share is a rare one it is in both prefixes, and rare tokens of
   prefixes are indexed singly, with their places: what can follow a shared
   token bounds the overlap, and of the smaller set's a shorter prefix is enough.
3. If not, all that they share is frequent. Then at least the least overlap of
   either set is frequent, and only such sets extend their prefix: by the first
   ``2 * most difference + 2`` frequent tokens, of which pairs of neighbours are
   indexed. Two such lists have a pair in common: they share more tokens than
   they have others, so somewhere no other token stands between two shared.
4. A key's documents are first compared with one of them, and with another
   while that finds many links. What links becomes a component. Only documents of one key that are still in different components
   are then compared with each other, in blocks.
5. A bitmap of each set gives an upper bound of an overlap; what stays is
   verified with the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, keys, release, ship, stored
from .components import components
from .shingles import mixed, sets

#: Tokens in a stretch, documents of it from which a token may be frequent, and of all.
STRETCH, OFTEN_HERE, OFTEN = 2_000_000, 4, 32
#: Documents of a key that are compared with each other in one group.
BLOCK = 1000
#: So many documents of a key, one after the other, are compared with all others at first.
TURNS = 2
#: A document with more open keys than these brings no list of them: it may be told of under several.
MOST_LISTED = 512
#: Texts that are shingled at once.
TEXTS = 256
#: Bits for each member of a filter, and the bits of the largest: 64 MB. A full filter costs time, never results.
FILTER_BITS, MOST_FILTER = 16, 29
_M1 = np.uint64(0x9E3779B97F4A7C15)


# ---- bitmaps of sets ----


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """For each value of the tokens' leading hash bits, two to four values a token, whether an odd number have it."""
    bits = max(6, math.ceil(math.log2(2 * max(1, len(tokens)))))
    return np.packbits(np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1)


def folded(rows: np.ndarray) -> np.ndarray:
    """Rows of bitmaps as ones of half the bits."""
    bits = np.unpackbits(rows, axis=-1)
    return np.packbits(bits[..., ::2] ^ bits[..., 1::2], axis=-1)


def most_shared(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """An upper bound of the overlap: where bitmaps differ there is a token that only one set has."""
    while len(a) > len(b):
        a = folded(a)
    while len(b) > len(a):
        b = folded(b)
    return (n_a + n_b - int(np.bitwise_count(a ^ b).sum())) // 2


# ---- filters of hashes, which all tasks get ----


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """Bits at the leading bits of the hashes, a column of longs; the driver gets no more than these bits."""
    n = hashes.count()
    bits = min(MOST_FILTER, max(12, math.ceil(math.log2(FILTER_BITS * max(1, n)))))
    place = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits)
    rows = hashes.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hashes.columns[0]}, {64 - bits}) & 63 as int))").alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - 6 - int(math.log2(len(bits))))
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


# ---- keys of sets ----


def _lists(found: list[np.ndarray], kind=np.int64) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*found, np.empty(0, kind)]).view(kind)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            yield batch.slice(lo, TEXTS)


def _frequent(n: int):
    def count(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def told():
            tokens = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            counts = np.diff(np.r_[first, len(tokens)])
            often = counts >= OFTEN_HERE
            return pa.record_batch({"token": pa.array(tokens[first[often]].view(np.int64)), "n": pa.array(counts[often].astype(np.int64))})

        for batch in _texts(batches):
            for tokens in sets(batch.column(0), n):
                held.append(tokens)
                size += len(tokens)
                if size >= STRETCH:
                    yield told()
                    held, size = [], 0
        if size:
            yield told()
        held.clear()
        give_back()

    return count


def _prepared(n: int, percent: int, shared):
    def prepare(batches: Iterator[pa.RecordBatch]):
        for batch in _texts(batches):
            rows = [_keys(tokens, percent, shared.value) for tokens in sets(batch.column(2), n)]
            yield pa.record_batch({"doc_id": batch.column(0), "text_key": batch.column(1), "n": pa.array([r[0] for r in rows], pa.int64()), "same": pa.array([r[1] for r in rows], pa.binary()), "singles": _lists([r[2] for r in rows]), "pairs": _lists([r[3] for r in rows]), "bits": pa.array([r[4] for r in rows], pa.binary())})
        give_back()

    return prepare


def _keys(tokens: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[int, bytes, np.ndarray, np.ndarray, bytes]:
    """The set's size, its fingerprint, its keys of single tokens in order and of pairs, and its bitmap."""
    size = len(tokens)
    same = xxhash.xxh3_128_digest(tokens.tobytes())
    least = -(-size * percent // 100)
    none = np.empty(0, np.int64)
    # A different set of any size can link only if one token less still does.
    if (size - 1) * 100 < percent * size and size * 100 < percent * (size + 1):
        return size, same, none, none, b""
    often = in_filter(frequent, tokens)
    singles = tokens[~often][: size - least + 1]
    pairs = none
    if int(often.sum()) >= least:
        first = tokens[often][: 2 * (size * (100 - percent) // percent + 1) + 2]
        pairs = np.unique(mixed(first[:-1] * _M1 + first[1:])).view(np.int64)
    return size, same, singles.view(np.int64), pairs, bitmap(tokens).tobytes()


def _indexed(percent: int, shared):
    """(key, node, n, place, leads) of the keys in the filter: place is -1 for pairs, and the smaller of two sets has to lead."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n, nodes = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for name in ("singles", "pairs"):
                lists = batch.column(name)
                ends = lists.offsets.to_numpy().astype(np.int64)
                found = lists.values.to_numpy(zero_copy_only=False)[: ends[-1]].astype(np.int64)[ends[0] :]
                of = np.repeat(np.arange(len(n)), np.diff(ends))
                place = np.arange(len(found)) - (ends[:-1] - ends[0])[of]
                keep = np.flatnonzero(in_filter(shared.value, found.view(np.uint64)))
                of, place = of[keep], place[keep]
                # The smaller of two sets shares 2 * percent / (100 + percent) of its tokens at least.
                leads = place <= n[of] - -(-n[of] * 2 * percent // (100 + percent)) if name == "singles" else np.ones(len(of), bool)
                at = place if name == "singles" else np.full(len(of), -1)
                for lo in range(0, len(of), 50_000):
                    s = slice(lo, lo + 50_000)
                    yield pa.record_batch({"key": pa.array(found[keep[s]]), "node": pa.array(nodes[of[s]]), "n": pa.array(n[of[s]].astype(np.int32)), "place": pa.array(at[s].astype(np.int32)), "leads": pa.array(leads[s])})
        give_back()

    return rows


# ---- comparisons ----


def _fits(percent: int, n_a: str, place_a: str, n_b: str, place_b: str) -> Column:
    """Whether two sets can link whose first shared token is at these places."""
    shared = f"if({place_a} < 0, least({n_a}, {n_b}), 1 + least({n_a} - {place_a} - 1, {n_b} - {place_b} - 1))"
    return F.expr(f"100L * {shared} >= {percent} * ({n_a} + {n_b} - {shared})")


def _possible(percent: int):
    """Keeps pairs (a, b, n_a, bits_a, n_b, bits_b) whose bitmaps leave a link possible."""

    def keep(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns[2:]]
            ok = [100 * (o := most_shared(np.frombuffer(x, np.uint8), m, np.frombuffer(y, np.uint8), k)) >= percent * (m + k - o) for m, x, k, y in zip(*c, strict=True)]
            flags = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(flags), batch.column(1).filter(flags)], names=["a", "b"])
        give_back()

    return keep


class _Bitmaps:
    """The bitmaps of many sets, compared many at a time."""

    def __init__(self, column: pa.Array):
        self.data, at = flat_binary(column)
        self.start, self.long = at[:-1], np.diff(at)

    def differences(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At how many bits sets i and j differ, at the shorter bitmap's length; the longer one has twice its bits at most."""
        out = np.empty(len(i), np.int64)
        short = np.minimum(self.long[i], self.long[j])
        for size in np.unique(short).tolist():
            all_of, step = np.flatnonzero(short == size), max(1, (1 << 22) // size)
            for lo in range(0, len(all_of), step):
                some = all_of[lo : lo + step]
                a, b = self._rows(i[some], size), self._rows(j[some], size)
                out[some] = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1)
        return out

    def _rows(self, i: np.ndarray, size: int) -> np.ndarray:
        rows = np.empty((len(i), size), np.uint8)
        even = self.long[i] == size
        rows[even] = self.data[self.start[i[even], None] + np.arange(size)]
        if not even.all():
            rows[~even] = folded(self.data[self.start[i[~even], None] + np.arange(2 * size)])
        return rows


class _Before:
    """Which rows' documents share a key that comes before the rows' own, by rank: single tokens first, in order, then pairs.

    The first key that two documents share tells of them, where places bound the
    overlap: what they share is not before it.
    """

    def __init__(self, lists: pa.Array, own: np.ndarray):
        rank, row = _ranks(lists)
        less = rank < own[row]
        self.key, row = mixed(rank[less].astype(np.uint64)), row[less]
        self.first = np.searchsorted(row, np.arange(len(own) + 1))
        self.all = np.sort(self._of(self.key, row))

    @staticmethod
    def _of(key: np.ndarray, row: np.ndarray) -> np.ndarray:
        return mixed(key ^ (row.astype(np.uint64) * _M1))

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        long = self.first[i + 1] - self.first[i]
        step = max(1, (1 << 20) // max(1, int(long.max(initial=0))))
        for lo in range(0, len(i) if len(self.all) else 0, step):
            a, b, n = i[lo : lo + step], j[lo : lo + step], long[lo : lo + step]
            pair = np.repeat(np.arange(len(a)), n)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.first[a][pair]
            code = self._of(self.key[place], b[pair])
            hit = self.all[np.minimum(np.searchsorted(self.all, code), len(self.all) - 1)] == code
            out[lo : lo + step] = np.bincount(pair[hit], minlength=len(a)) > 0
        return out


def _steps(lists: list[np.ndarray]) -> pa.Array:
    """Ranks in order, each as the step from the one before, seven bits to a byte, of which all but a step's last are marked."""
    long = np.array([len(x) for x in lists])
    values = np.concatenate([*(np.diff(x, prepend=0) for x in lists), np.empty(0, np.int64)])
    size = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 9))
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = (values[some] >> (7 * k)) & 127 | np.where(size[some] > k + 1, 128, 0)
    ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(long)]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _ranks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``_steps`` made, and the row of each."""
    data, at = flat_binary(column)
    data, at = data[at[0] : at[-1]], at - at[0]
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.r_[0, last[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    sums = np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first))
    until = np.searchsorted(last, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(until))
    return sums - np.r_[0, sums][until[:-1]][row], row


def _brought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each row of a node brings, once a key: its bitmap at half the bits, which tells nearly as much, and its ranks as steps."""
    for batch in batches:
        bits = [folded(np.frombuffer(x, np.uint8)).tobytes() if len(x) > 8 else x for x in batch.column(1).to_pylist()]
        ends = batch.column(2).offsets.to_numpy()
        ranks = batch.column(2).values.to_numpy(zero_copy_only=False)
        lists = [np.sort(ranks[lo:hi]) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.record_batch({"node": batch.column(0), "bits": pa.array(bits, pa.binary()), "mine": _steps(lists)})


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def _within(percent: int):
    """Pairs of a key's documents in different components, from rows sorted by (key, one, two, n)."""

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        c = {name: rows.column(name).to_numpy(zero_copy_only=False) for name in ("key", "one", "two", "block", "component", "node", "place", "leads", "rank")}
        n = rows.column("n").to_numpy().astype(np.int64)
        maps, before = _Bitmaps(rows.column("bits")), _Before(rows.column("mine"), c["rank"])
        new = np.r_[True, (c["key"][1:] != c["key"][:-1]) | (c["one"][1:] != c["one"][:-1]) | (c["two"][1:] != c["two"][:-1])]
        heads = np.flatnonzero(new)
        end = np.r_[heads[1:], len(n)][np.cumsum(new) - 1]
        i, d, found = np.flatnonzero(c["leads"]), 0, []
        while len(i):
            d += 1
            i = i[i + d < end[i]]
            i = i[100 * n[i] >= percent * n[i + d]]
            j = i + d
            open_ = (c["component"][i] != c["component"][j]) & ((c["one"][i] == c["two"][i]) | (c["block"][i] != c["block"][j]))
            a, b = i[open_], j[open_]
            shared = np.where(c["place"][a] < 0, n[a], np.minimum(n[a] - c["place"][a], n[b] - c["place"][b]))
            fits = 100 * shared >= percent * (n[a] + n[b] - shared)
            a, b = a[fits], b[fits]
            shared = (n[a] + n[b] - maps.differences(a, b)) // 2
            fits = 100 * shared >= percent * (n[a] + n[b] - shared)
            a, b = a[fits], b[fits]
            fits = ~before.shared(a, b)
            found.append(np.stack([c["node"][a[fits]], c["node"][b[fits]]], axis=1))
        pairs = np.concatenate([*found, np.empty((0, 2), np.int64)])
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.record_batch({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})

    def pairs(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(name).to_numpy() for name in ("key", "one", "two")]
            same = np.logical_and.reduce([x == x[-1] for x in c])
            cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if held and [h[-1] for h in (held[-1].column(name).to_pylist()[-1:] for name in ("key", "one", "two"))] != [x[0] for x in c]:
                yield compare(_joined(held))
                held = []
            if cut:
                yield compare(_joined([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield compare(_joined(held))
        held.clear()
        give_back()

    return pairs


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _sets(n: int):
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in _texts(batches):
            found = list(sets(batch.column(0), n))
            yield pa.record_batch({"same": pa.array([xxhash.xxh3_128_digest(t.tobytes()) for t in found], pa.binary()), "tokens": pa.array([t.tobytes() for t in found], pa.binary())})
        give_back()

    return rows


def _linked(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                o = int((both[1:] == both[:-1]).sum())
                ok.append(100 * o >= percent * (len(both) - o))
            flags = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(flags), batch.column(1).filter(flags)], names=["a", "b"])
        give_back()

    return keep


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose whole sets link; sets are made of these documents only."""
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node"), "wanted")
    ids = keys(wanted.select(F.col("rep").alias("__rep"), F.col("text_key").alias("__key")), "ids")
    few = docs.join(ids, (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")
    made = few.select("text").mapInArrow(_sets(n), "same binary, tokens binary")
    made = stored(made.join(wanted.select("node", "same"), "same").groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")
    one, two = (made.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    links = stored(pairs.join(two, "b").join(one, "a").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_linked(percent), "a long, b long"), "links")
    release(pairs, wanted, made)
    return links


def _components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n, same) of all rows; (same, rep, low, low_key) of all sets: a set's row, and its component's."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    counted = texts.select("text").mapInArrow(_frequent(n), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    counted = stored(counted.select("token"), "frequent")
    often = spark.sparkContext.broadcast(hash_filter(counted))
    kind = dict(docs.dtypes)["doc_id"]
    made = stored(texts.mapInArrow(_prepared(n, percent, often), f"doc_id {kind}, text_key long, n long, same binary, singles array<long>, pairs array<long>, bits binary").withColumn("row", F.monotonically_increasing_id()), "prefixes")
    rows = stored(made.select("doc_id", "text_key", "n", "same"), "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row")).alias("m")
    reps = stored(made.where("n > 0").groupBy("same").agg(least, F.count(F.lit(1)).alias("rows")).select("same", F.col("m.row").alias("node"), F.col("m.doc_id").alias("rep"), "m.text_key", "rows"), "reps")
    # Copies are fewer than sets, and their keys and bitmaps stay where they are.
    twice = made.where("length(bits) > 0").select("same", "row").join(reps.where("rows > 1").select("same", "node"), "same")
    copies = keys(twice.where("row <> node").select("row"), "copies")
    single = stored(made.where("length(bits) > 0").join(copies, "row", "left_anti").select(F.col("row").alias("node"), "n", "singles", "pairs", "bits"), "sets")
    release(made, counted)

    several = single.select(F.explode(F.concat("singles", "pairs")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = stored(several.select("key"), "several")
    twice = spark.sparkContext.broadcast(hash_filter(several))
    index = single.select("node", "n", "singles", "pairs").mapInArrow(_indexed(percent, twice), "key long, node long, n int, place int, leads boolean")
    index = stored(index.join(several, "key"), "index")

    maps = single.select("node", "n", "bits")
    map_a, map_b = (maps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    placed, links, total = index.withColumn("component", F.col("node")), None, 0
    for turn in range(TURNS):
        first = placed.groupBy("key").agg(F.min_by(F.struct("node", "n", "place", "component"), F.xxhash64("node", F.lit(turn))).alias("f"))
        stars = placed.join(first, "key").where("component <> f.component").where(_fits(percent, "n", "place", "f.n", "f.place"))
        stars = stars.select(F.least("f.node", "node").alias("a"), F.greatest("f.node", "node").alias("b")).distinct()
        stars = stars.join(map_b, "b").join(map_a, "a").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(_possible(percent), "a long, b long")
        new = _verified(texts, reps, stars, n, percent)
        links, fresh = new if links is None else links.union(new), new.count()
        total += fresh
        groups = components(links)
        placed = index.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if 50 * fresh <= total:
            break

    still = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"), F.bool_or("leads").alias("led"), F.min("place").alias("place")).where("low <> high AND led AND rows > 2")
    # Tokens are in order of their hashes as unsigned numbers.
    order = still.select("key", "rows", (F.col("place") < 0).alias("pair")).orderBy("pair", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    still = stored(order.select("key", "rows", F.monotonically_increasing_id().alias("rank")), "still")
    before = stored(placed.join(still, "key"), "open")
    mine = before.groupBy("node").agg(F.collect_list("rank").alias("mine"))
    mine = mine.select("node", F.when(F.size("mine") <= MOST_LISTED, F.col("mine")).otherwise(F.array().cast("array<bigint>")).alias("mine"))
    about = maps.select("node", "bits").join(mine, "node").mapInArrow(_brought, "node long, bits binary, mine binary")
    between = before.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    between = between.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    between = between.select("key", "node", "n", "place", "leads", "component", "rank", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")).join(about, "node")
    between = between.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "n").mapInArrow(_within(percent), "a long, b long")
    links = links.union(_verified(texts, reps, between.distinct(), n, percent))

    groups = components(links)
    release(index, single, still, before, several)
    lowest = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "text_key")).alias("m")
    low = groups.join(reps, "node").groupBy("component").agg(lowest).select("component", F.col("m.rep").alias("low"), F.col("m.text_key").alias("low_key"))
    linked = groups.join(low, "component").select("node", "low", "low_key", F.lit(True).alias("linked"))
    every = reps.join(linked, "node", "left")
    whole = every.select("same", F.when(F.col("linked"), F.col("low")).otherwise(F.col("rep")).alias("low"), F.when(F.col("linked"), F.col("low_key")).otherwise(F.col("text_key")).alias("low_key"))
    return rows, whole


def joined(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Documents link if 100 * overlap >= ``percent`` * union of their sets; a
    component is known by its smallest doc_id.

    Cases: null and empty texts, and those of white space, have no set, link with
    nothing and are components of their own. A text of fewer than n words is one
    n-gram. Each row is a document of its own: several texts under one doc_id
    have a component each, unless they link. Rows with a null doc_id link like
    others; a component's id is null if none of its rows has one. An empty
    table gives an empty result. Only doc_id, of any type that sorts, and text are read.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100: below, neighbours in the order may share no pair")
    rows, whole = _components(docs, n, percent)
    found = rows.join(whole.withColumnRenamed("same", "its"), F.col("same") == F.col("its"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, in all its columns: that of the smallest doc_id and, among several, the smallest hash of its text.

    A row without a doc_id stays only if no linked row has one. Of rows that
    repeat both doc_id and text one stays. Rows without a set all stay.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100: below, neighbours in the order may share no pair")
    rows, whole = _components(docs, n, percent)
    found = stored(rows.where("n > 0").join(whole, "same").select("doc_id", "text_key", "low", "low_key"), "components")
    release(rows)
    same = F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("text_key") == F.col("low_key"))
    gone = keys(found.where(~same).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct(), "gone")
    key = F.xxhash64("text")
    kept = docs.join(gone, (key == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
    twice = stored(found.where(same).groupBy("doc_id", "text_key").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__twice")), "twice")
    if twice.isEmpty():
        return kept
    of = (key == F.col("__twice")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    some = kept.join(twice, of, "left_semi").groupBy("doc_id", key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
    return kept.join(twice, of, "left_anti").union(some.select(*[F.col(f"__row.`{c}`") for c in docs.columns]))
