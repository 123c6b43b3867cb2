"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, keyed, quoted, settle

#: Slices of the seeded order of a source. A slice, not a source, is what one task sorts.
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, total: int, max_epochs: int) -> tuple[int, int]:
    """Level of capped water-filling as (numerator, denominator).

    ``sources`` has weight and source_size. Each round clamps the sources whose share exceeds ``max_epochs``
    times their size and spreads the rest over the others by weight, until no share is above its cap. Only two
    sums come back from a round.
    """
    level = (0, 1)
    while True:
        num, den = level
        capped = F.col("source_size") * max_epochs * den <= F.col("weight") * num
        row = sources.agg(F.sum(F.when(capped, F.col("source_size") * max_epochs)).alias("c"),
                          F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        if not row.w:
            return level
        new = (total - int(row.c or 0), int(row.w))
        if new == level:
            return level
        level = new


def mix_plan(docs: DataFrame, weights: DataFrame, max_epochs: int = 3, seed: int = 7, text: str = "text") -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source and words taken.

    ``weights`` (source, weight): positive whole numbers; a null source is a source of its own, and sources without
    a weight get no share. The targets add up to all sizes. A source is taken whole ``floor(target / size)`` times;
    the rest goes through its documents in an order drawn from md5(seed, doc_id), the last of them in part, so the
    words taken from a source are its rounded target. Equal draws are ordered by id and size. Null texts have size 0
    and give nothing; an empty table gives an empty result. Every row counts by itself, repeated ids too.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return _plan(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.lit(0).cast("long").alias("row"), name.alias("name")),
                 weights, max_epochs, seed).drop("row")


def _plan(rows: DataFrame, weights: DataFrame, max_epochs: int, seed: int) -> DataFrame:
    """The plan for ``rows`` (doc_id, source, size, row, name): drawn by name, equal draws by id, size and row."""
    sized = settle(rows.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), "name"))).drop("name"))
    sources = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size"))
                     .join(weights.select(F.col("source").alias("w_source"), "weight"),
                           F.col("source").eqNullSafe(F.col("w_source")), "left")
                     .select("source", "source_size", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    num, den = water_level(sources.where("weight > 0"), int(total), max_epochs)
    share = F.least(F.col("source_size") * max_epochs * 1.0, F.lit(float(num)) * F.col("weight") / F.lit(float(den)))
    plan = (sources.withColumn("target", share)
            .withColumn("words", F.round("target").cast("long"))
            .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
            .withColumn("rest", F.expr("words - whole * source_size"))
            .select(F.col("source").alias("p_source"), "source_size", F.round("target", 6).alias("target"), "whole", "rest"))
    slices = sized.groupBy("source", F.substring("draw", 1, SLICE_DIGITS).alias("slice")).agg(F.sum("size").alias("n"))
    # A source has at most 16 ** SLICE_DIGITS slices, which bounds this window.
    before = F.sum("n").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    slices = slices.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"),
                           F.coalesce(before, F.lit(0)).alias("slices_before"))
    slices = (slices.join(plan, F.col("s_source").eqNullSafe(F.col("p_source"))).drop("p_source"))
    inside = W.partitionBy("source", "slice").orderBy("draw", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("slice", F.substring("draw", 1, SLICE_DIGITS)).withColumn(
        "before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(slices, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.expr("rest - slices_before - before")))
    return joined.select("row", "doc_id", "source", "size", "source_size", "target",
                         (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def ranked_weights(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights that repeat over the sources in order of their code points, the null source last.

    One row per source: the list of datasets that are mixed, not the documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(cycle)
    return docs.select("source").distinct().select(
        "source", F.element_at(F.array(*map(F.lit, cycle)), nth + 1).cast("long").alias("weight"))


def mixed(docs: DataFrame, weights: DataFrame, max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: each document once per repetition that it gives, with the words of that repetition.

    Columns of the input stay; ``mix_copy`` (from 1) and ``mix_words`` are added (and replaced if present). A
    fractional repetition has fewer words than the document; documents that give nothing are left out. Each row gives what
    the plan takes from it: rows that share an id or have none are told apart by a key, and of a source's words none go to another.
    """
    rows, key = keyed(docs)
    own = F.col("doc_id").cast("string")
    sized = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.col(key).alias("row"),
                        F.coalesce(own, F.concat(F.lit("null:"), F.col(key).cast("string"))).alias("name"))
    plan = _plan(sized, weights, max_epochs, seed).where("taken > 0").select(
        F.col("row"), F.struct("taken", "size", F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))).alias("copies")).alias("given"))
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_words")]
    held = rows.select(F.col(key).alias("row"), F.struct(*map(quoted, kept)).alias("kept")).join(plan, "row")
    each = held.select("kept", "given", F.explode("given.copies").alias("mix_copy"))
    words = F.least("given.size", F.col("given.taken") - (F.col("mix_copy") - 1) * F.col("given.size"))
    return each.select(*[F.col("kept").getField(c).alias(c) for c in kept], "mix_copy", words.alias("mix_words"))
