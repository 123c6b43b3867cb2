"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Containment is one-sided: a short item may lie in a document of any length, so a fixed number of minima of the
document says nothing about it. The sketch is therefore kept on the side of the items: the k shingles with the smallest
hashes. Items are partitioned by size; for a partition of items of up to u shingles and a containment t,
k = floor((1 - t) u) + 1, so that a document which holds the share t of an item's shingles holds at least one of its
minima, and an item with q shingles at least k - floor((1 - t) q) of them: the search loses nothing. Documents
are streamed over the index of minima; those that hold enough are verified on all shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, settle, small

#: Item shingles that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Parts of the rows of one document id.
SALTS = 8


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def item_sketches(items: DataFrame, width: int, threshold: float) -> DataFrame:
    """Distinct shingles of each item: item_id, width, shingle, n_item, part, need, in_sketch.

    ``part`` is the partition by size (the power of two that bounds n_item); ``need`` the minima that a document
    must hold. Items with fewer words than ``width`` are one shingle of that many words; items without words drop out.
    Items with the same id are one item with the shingles of both.
    """
    parted = (items.select("item_id", _words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
              .withColumn("width", F.least(F.size("w"), F.lit(width)))
              .withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1)))
              .select("item_id", "width", F.array_join(F.expr("slice(w, i, width)"), " ").alias("shingle")).distinct())
    own = W.partitionBy("item_id")  # as many rows as an item has shingles
    missing = F.lit(1 - threshold + 1e-9)
    return (parted.withColumn("n_item", F.count("*").over(own))
            .withColumn("part", F.ceil(F.log2("n_item")).cast("int"))
            .withColumn("sketch", F.floor(missing * F.pow(F.lit(2), "part")) + 1)
            .withColumn("need", F.least("sketch", "n_item") - F.floor(missing * F.col("n_item")))
            .withColumn("nth", F.row_number().over(own.orderBy(F.xxhash64("shingle"), "shingle")))
            .select("item_id", "width", "shingle", "n_item", "part", "need", (F.col("nth") <= F.col("sketch")).alias("in_sketch")))


def _held(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Distinct (doc_id, width, shingle) of the documents' shingles that stand in ``shingles`` (settled: width, shingle, ...)."""
    widths = [r.width for r in shingles.select("width").distinct().collect()]  # at most as many as a shingle has words
    known = small(shingles.select(F.xxhash64("width", "shingle").alias("h")).distinct(), BROADCAST_ROWS)
    words = docs.select("doc_id", _words(F.coalesce("text", F.lit(""))).alias("w"))
    found = words.where("false").select("doc_id", F.lit(0).alias("width"), F.lit("").alias("shingle"))
    for n in widths:
        # Exploding positions, not shingles, keeps the hashing in generated code; only known shingles become strings.
        shingle = F.concat_ws(" ", *(F.get("w", F.col("i") + k) for k in range(n)))
        places = (words.where(F.size("w") >= n).select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("i"))
                  .withColumn("h", F.xxhash64(F.lit(n), shingle)).join(known, "h", "left_semi")
                  .select("doc_id", F.lit(n).alias("width"), shingle.alias("shingle")))
        found = places if n == widths[0] else found.unionByName(places)
    return found.distinct()


def candidate_pairs(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that hold enough of an item's minima for its size partition.

    ``sketches`` is the settled table of ``item_sketches``; only its rows in a sketch are looked up.
    """
    minima = sketches.where("in_sketch")
    return (_held(docs, minima).join(small(minima, BROADCAST_ROWS), ["width", "shingle"])
            .groupBy("doc_id", "item_id").agg(F.count("*").alias("minima"), F.first("need").alias("need"))
            .where("minima >= need").select("doc_id", "item_id"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each item whose containment in a document is at least ``threshold``.

    Sketches propose pairs; only documents of a proposed pair are read again, and only proposed pairs are compared in full.
    Null and empty texts contain nothing and are contained in nothing. Rows that repeat a document id are one document
    with the shingles of all of them; rows without an id are searched as one more document with a null id. Other columns
    are not read. Empty tables give an empty result.
    """
    sketches = settle(item_sketches(items, width, threshold))
    pairs = settle(candidate_pairs(docs, sketches))
    # Rows of one id may be many: they are told apart by a salt of their text.
    salt = F.pmod(F.xxhash64("text"), F.lit(SALTS))
    wanted = settle(pairs.select(F.col("doc_id").alias("c_id")).distinct()
                    .withColumn("c_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))))
    texts = docs.select("doc_id", "text", salt.alias("salt")).join(
        small(wanted, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("salt") == F.col("c_salt")), "left_semi")
    held = _held(texts, sketches)
    asked = (pairs.select(F.col("doc_id").alias("c_id"), F.col("item_id").alias("c_item"))
             .join(small(sketches, BROADCAST_ROWS), F.col("c_item").eqNullSafe(F.col("item_id")))
             .select("c_id", "item_id", F.col("width").alias("c_width"), F.col("shingle").alias("c_shingle"), "n_item"))
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("width") == F.col("c_width")) & (F.col("shingle") == F.col("c_shingle"))
    return (held.join(asked, same).groupBy("doc_id", "item_id")
            .agg(F.count("*").alias("n_shared"), F.first("n_item").alias("n_item"))
            .withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .where(F.col("n_shared") + 1e-9 >= threshold * F.col("n_item")))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` without those that contain an item, columns as they are. Rows are judged by id, those without one together.

    ``without_leaks`` judges row by row.
    """
    leaks = contained_items(docs, items, width, threshold).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leak_id")), "left_anti")


def without_leaks(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that contain no row of ``items``, columns as they are. Each row is judged by its own text.

    Ids are not read: rows of either table that share an id, or have none, are searched one by one.
    """
    docs_, key = keyed(docs)
    items_, item_key = keyed(items.select("text"))
    leaks = contained_items(docs_.select(F.col(key).alias("doc_id"), "text"), items_.select(F.col(item_key).alias("item_id"), "text"),
                            width, threshold)
    gone = small(settle(leaks.select(F.col("doc_id").alias(key)).distinct()), BROADCAST_ROWS)
    return docs_.join(gone, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
