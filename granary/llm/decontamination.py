"""Benchmark decontamination: n-gram windows of test items, looked up in documents.

DataFrame functions only: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keys, stored

#: Words: runs of ASCII letters and digits and of whatever lies beyond ASCII. Said as what they hold, which is matched far faster than what they do not.
WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Slots of the hash set for each window, and of the largest set: 64 MB. A fuller one lets more by to be verified.
SLOTS, MOST_SLOTS = 32, 26
#: So many bytes of windows may be broadcast to the check of the hits.
MOST_BROADCAST = 24 << 20


def _words(text: Column) -> Column:
    """Words in any case; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def windows(items: DataFrame, n: int = 10) -> DataFrame:
    """(item_id, n, hash, words) for each window of each item, distinct.

    An item of fewer than ``n`` words, but not none, is one window.
    """
    rows = items.select(F.col("item_id"), F.transform(_words(F.col("text")), ascii_lower).alias("w")).where(F.size("w") > 0)
    long = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - long + 1)
    rows = rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, long))).alias("words"))
    rows = _hashed(rows.withColumn("__low", F.transform("words", F.lower)), set(range(1, n + 1)))
    by = [F.when(F.size("words") == k, F.get(f"__h{k}", F.lit(0))) for k in range(1, n + 1)]
    return rows.select("item_id", F.size("words").alias("n"), F.coalesce(*by).alias("hash"), "words").distinct()


def _hashed(rows: DataFrame, lengths: set[int]) -> DataFrame:
    """Adds, for each length K, ``__hK``: the hashes of all windows of K words of ``__low``.

    Each word is hashed once; a window's hash is made of two shorter ones, of a
    power of two of words and of the rest.
    """
    rows = rows.withColumn("__h1", F.transform("__low", lambda w: F.xxhash64(w)))
    needed = lengths.union(*(_halves(k) for k in lengths))
    for k in sorted(needed - {1}):
        half = max(_halves(k))
        rest = k - half
        both = F.zip_with(f"__h{half}", F.slice(f"__h{rest}", 1 + half, F.greatest(F.size(f"__h{rest}"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        rows = rows.withColumn(f"__h{k}", F.slice(both, F.lit(1), F.greatest(F.size("__low") - (k - 1), F.lit(0))))
    return rows


def _halves(k: int) -> set[int]:
    if k == 1:
        return set()
    half = 1 << (k - 1).bit_length() - 1
    return {half, k - half} | _halves(half) | _halves(k - half)


def hash_set(hashes: DataFrame) -> tuple[bytes, int]:
    """A byte for each slot, 1 at three slots of each hash, and the bits of a slot's number. The driver gets the slots alone."""
    bits = min(MOST_SLOTS, max(12, (SLOTS * max(1, hashes.count()) - 1).bit_length()))
    found = hashes.select(F.explode(F.array(*_slots(F.col("hash"), bits))).alias("slot")).distinct().toPandas()["slot"]
    slots = bytearray(1 << bits)
    for i in found:
        slots[i] = 1
    return bytes(slots), bits


def _slots(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, 64 - bits).cast("int"), h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"), F.shiftrightunsigned(F.xxhash64(h), 64 - bits).cast("int")]


def hits(docs: DataFrame, items: DataFrame, n: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, words_hit, items.

    ``words_hit`` has the positions of the words, from 0, that lie in any
    occurrence of a window, and ``items`` the ids of the items whose windows
    occur. ``carry`` names columns of ``docs`` to be kept beside these.

    The items' windows are one hash set in the plan, which every task gets;
    each document's windows are hashed where the document lies, and only those
    found in the set leave it, with their words, to be compared with the
    windows themselves.
    """
    tests = stored(windows(items, n), "tests")
    distinct = tests.select("n", "hash").distinct()
    lengths = sorted(r["n"] for r in distinct.select("n").distinct().collect())
    data, bits = hash_set(distinct)

    kept = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)]
    names = [f"__c{i}" for i in range(len(carry))]
    read = docs.select(F.col("doc_id"), *kept, F.monotonically_increasing_id().alias("__row"), _words(F.col("text")).alias("__words"))
    read = _hashed(read.withColumn("__low", F.transform("__words", F.lower)), set(lengths))
    slots, one = F.lit(data), F.lit(b"\x01")

    def there(h: Column) -> Column:
        a, b, c = (F.substring(slots, slot + 1, F.lit(1)) == one for slot in _slots(h, bits))
        return a & b & c

    for k in lengths:
        found = F.transform(f"__h{k}", lambda h, i: F.when(there(h), F.struct((i + 1).alias("at"), h.alias("hash"))))
        read = read.withColumn(f"__p{k}", F.array_compact(found))
    shape = "array<struct<n:int,at:int,hash:bigint,words:array<string>>>"

    def place(k: int) -> Column:
        return F.transform(f"__p{k}", lambda p: F.struct(F.lit(k).alias("n"), p["at"].alias("at"), p["hash"].alias("hash"), F.transform(F.slice("__words", p["at"], k), ascii_lower).alias("words")))

    places = F.concat(F.array().cast(shape), *[place(k).cast(shape) for k in lengths])
    scanned = stored(read.select("doc_id", *names, "__row", F.size("__words").cast("long").alias("n_words"), places.alias("places")), "scan")

    size = tests.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 24 * F.size("words"))).first()[0] or 0
    tests = F.broadcast(tests) if size <= MOST_BROADCAST else tests
    single = scanned.where(F.size("places") > 0).select("__row", F.explode("places").alias("p")).select("__row", "p.*")
    same = single.join(tests, ["n", "hash", "words"]).groupBy("__row").agg(F.collect_set(F.struct("at", "n")).alias("where"), F.collect_set("item_id").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("where", lambda p: F.sequence(p["at"] - 1, p["at"] + p["n"] - 2))))
    same = same.select("__row", covered.alias("words_hit"), "items")
    out = scanned.drop("places").join(same, "__row", "left")
    item_type = dict(tests.dtypes)["item_id"]
    return out.select("doc_id", *[F.col(x).alias(c) for x, c in zip(names, carry, strict=True)], "n_words", F.coalesce("words_hit", F.array().cast("array<int>")).alias("words_hit"), F.coalesce("items", F.array().cast(f"array<{item_type}>")).alias("items"))


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row.

    Cases: null and empty texts have no words and no hits, and the SHA-256 of
    empty text. An empty table of items contaminates nothing. Items with a null
    id make hits, but no id to list. Rows that repeat a doc_id are reported each.
    """
    found = hits(docs, items, n)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", F.size("words_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (F.size("words_hit") > 0).alias("contaminated")
    )


def without_documents(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window, in all their columns.

    Each row is judged by its own text, whatever its doc_id; rows of one text
    are judged alike. Which texts go is a table of hits only, by their SHA-256.
    """
    same = F.sha2(F.col("text").cast("binary"), 256)
    found = hits(docs.select("doc_id", "text", same.alias("__same")), items, n, carry=("__same",))
    bad = keys(found.where(F.size("words_hit") > 0).select(F.col("__same").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, same == F.col("__bad"), "left_anti")


def without_spans(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """doc_id and the text without the words in windows and what follows each of them."""
    found = hits(docs, items, n, carry=("text",))
    pieces = F.regexp_extract_all("text", F.lit(f"{WORDS}{BETWEEN}*"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.array_contains("words_hit", i))
    cut = F.concat(F.regexp_extract("text", f"^{BETWEEN}*", 0), F.array_join(kept, ""))
    return found.select("doc_id", F.when(F.size("words_hit") > 0, cut).otherwise(F.col("text")).alias("text"), F.size("words_hit").cast("long").alias("n_cut"))


SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), tests AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM tests) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, i, places.n, item_id FROM places JOIN tests ON places.n = tests.n AND places.words = tests.words
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN listed ON d.doc_id = listed.doc_id
"""
