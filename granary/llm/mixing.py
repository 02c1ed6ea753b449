"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORDS, stored

_IN_PARTITION = (1 << 33) - 1


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Adds ``target`` to rows (source, source_size), one row for each source.

    Sources in code point order, null last, take the weights in turn. They
    share ``share`` times all sizes; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight. The level at
    which that ends is found in one pass over the sources, ordered by the level
    at which each of them is full. These windows see a row for each source,
    never one for each document.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("__full", "__turn")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__turn") % len(weights) + 1).cast("int"))
    level = (F.lit(float(share)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__weight").over(after)
    return (
        sizes.withColumn("__turn", F.row_number().over(turn) - 1)
        .withColumn("__weight", weight)
        .withColumn("__cap", F.col("source_size") * most)
        .withColumn("__full", F.col("__cap") / F.col("__weight"))
        .withColumn("__level", level)
        .withColumn("__ends", F.when(F.col("__level") * F.col("__weight") <= F.col("__cap"), F.struct("__full", "__turn", "__level")))
        .withColumn("__at", F.min("__ends").over(everyone)["__level"])
        .withColumn("target", F.when(F.col("__at").isNull(), F.col("__cap").cast("double")).otherwise(F.least(F.col("__cap").cast("double"), F.col("__at") * F.col("__weight"))))
        .select("source", "source_size", "target")
    )


def offset(source: Column, seed: int) -> Column:
    """The source's one random offset, in [0, 1), the same in every run."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, keep: bool = False) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, size, source_size, target, taken, copies; with ``keep`` also
    all columns of ``docs`` as a struct ``doc``.

    Documents are put in order of (source, size from large to small, doc_id, hash of the text).
    Each document's expected copies are target / source_size; they are summed
    along that order within its source, one random offset is added, and a copy
    is taken for each whole number that the sum crosses. With sizes in order the
    words taken differ from the target by less than the source's largest
    document. The sum at a document is its rank times the expected copies, and
    ranks come from the range partitions of the order: the first rank of each
    partition is added up over (partition, source) counts, so a source with any
    part of all rows is spread over as many tasks as its rows need.

    Cases: a null or blank text has size 0 and a null source is a source of its
    own, the last. Sources of size 0 get target 0 and none of their documents
    are taken. Rows that repeat a doc_id are documents of their own. An empty
    table gives an empty result. Other columns of ``docs`` are never read, except
    for ``keep``.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(SPACED_WORDS)), F.lit(0)).cast("long")
    cols = [F.col("doc_id"), F.col("source"), size.alias("size"), F.xxhash64("text").alias("__tie")]
    if keep:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_first(), F.col("__tie")]
    sized = docs.select(*cols)
    sized = sized if keep else stored(sized, "mix-sizes")
    placed = stored(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "mix-order")
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit(_IN_PARTITION)))

    parts = placed.groupBy("source", "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__rows"), F.sum("size").alias("__size"))
    parts = stored(parts, "mix-parts")
    aims = targets(parts.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, share, most)
    so_far = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__rows").over(so_far), F.lit(0)))
    parts = parts.alias("p").join(aims.alias("a"), F.col("p.source").eqNullSafe(F.col("a.source"))).select("p.source", "__part", (F.col("__before") - F.col("__first")).alias("__shift"), "source_size", "target", offset(F.col("p.source"), seed).alias("__offset"))

    each = F.col("target") / F.col("source_size")
    rank = F.col("__row") + F.col("__shift")
    crossed = F.floor((rank + 1) * each + F.col("__offset")) - F.floor(rank * each + F.col("__offset"))
    copies = F.when(F.col("source_size") == 0, F.lit(0)).when(F.col("target") >= F.col("source_size") * most, F.lit(most)).otherwise(F.least(crossed, F.lit(most))).cast("int")
    found = placed.alias("d").join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.__part") == F.col("p.__part")))
    return found.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *(["doc"] if keep else [])).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *(["doc"] if keep else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, in no order."""
    found = mix(docs, keep=True, **options)
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"), F.when(F.col("copies") > 0, F.lit(1)).otherwise(F.lit(-1))))).where("copies > 0").select("doc.*")


#: One statement for the same result: the rank within the source stands in for
#: the partitions' sums.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) - 1 AS rank FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap FROM sources
), leveled AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS filled,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
      - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed
), aims AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT level FROM leveled WHERE level * weight <= cap ORDER BY filled, turn LIMIT 1)) AS target,
    CAST(('0x' || substr(md5('7|' || coalesce('=' || source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM leveled
), found AS (
  SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 WHEN target >= source_size * 2 THEN 2
      ELSE least(floor((rank + 1) * (target / source_size) + shift) - floor(rank * (target / source_size) + shift), 2) END AS INTEGER) AS copies
  FROM ranked JOIN aims ON ranked.source IS NOT DISTINCT FROM aims.source
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM found
"""
