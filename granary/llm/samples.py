"""Bounded samples of labelled documents, from which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, stored


def smallest(rows: DataFrame, group: str, counts: dict, most: int, seed: int = 0) -> DataFrame:
    """The ``most`` rows of each group with the smallest hashes of doc_id.

    A first cut by the hash's value, from the groups' counts, leaves about twice
    as many, so that few rows are ranked however large a group is.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    cuts = [F.when(F.col(group) == F.lit(g), F.lit(min(1.0, (2 * most + 200) / n))) for g, n in counts.items()]
    cut = F.coalesce(*cuts, F.lit(1.0))
    first = Window.partitionBy(group).orderBy("__h", "doc_id")
    rows = rows.withColumn("__h", h).where((F.col("__h") / F.lit(2.0**64) + 0.5) <= cut)
    return rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most).drop("__n", "__h")


#: Bytes of each label's texts that the driver may hold.
MOST_BYTES = 12 << 20


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, fold: tuple[int, int], seed: int = 0) -> tuple[list[tuple[str, object]], dict[object, int]]:
    """(text, label) of at most ``most`` documents and MOST_BYTES of each label, and all labels' counts.

    ``fold`` is (modulus, remainder) of the doc_ids that are held out. Of a
    label's documents those with the smallest hashes of their ids are taken, so
    the sample is the same in every run. Which they are is found from ids and
    labels alone, by limits within each partition first; only then are the
    texts of these few looked up. A doc_id with several labels counts with the
    largest, null labels and ids do not count, and a doc_id with several texts
    gives them all.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id"), F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder("doc_id", fold[0]) != fold[1]))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    # Up to this limit Spark cuts each partition's rows before they are ranked.
    limit, before = "spark.sql.optimizer.windowGroupLimitThreshold", spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set(limit, str(max(most, int(before))))
    try:
        picked = stored(smallest(rows, "label", counts, most, seed), "sample")
    finally:
        spark.conf.set(limit, before)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = stored(texts.select("label", F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("h"), "doc_id", "text"), "texts")
    by = Window.partitionBy("label").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = texts.withColumn("bytes", F.sum(F.octet_length("text")).over(by)).where(F.col("bytes") <= MOST_BYTES)
    found = sorted(((r["doc_id"], r["text"], r["label"]) for r in few.select("doc_id", "text", "label").collect()), key=lambda r: (r[0], r[1]))
    return [(t, y) for _, t, y in found], counts
