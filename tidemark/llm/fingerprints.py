"""Document fingerprints: one-permutation MinHash, densified, packed to low-order bits.

Each shingle is hashed once; its top bits choose a bin and the smallest hash of a bin represents it. An empty bin takes
the value of another, found by probing bins in an order that depends on the bin alone until one is filled, which keeps
the chance that two texts agree in the bin equal to their similarity. A taken value is hashed with the number of the bin
that takes it, so that the low bits of its copies agree by chance independently. Four low bits of each bin are kept.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import let

#: 2 ** 7 bins of 4 bits: 16 bins to a 64-bit word.
BIN_BITS, BITS = 7, 4
BINS, PER_WORD = 1 << BIN_BITS, 64 // BITS
#: Probes written out one by one; a text so short that all of them meet empty bins goes on through all bins.
PROBES = 6
#: Ids that one task orders together.
RANGE = 256


def split_words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for an empty text."""
    inner = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def shingle_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash of each run of ``width`` words; of the whole sequence if it is shorter; none without words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width),
                       lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return (F.when(F.size(words) >= width, runs)
            .when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " "))))
            .otherwise(F.expr("cast(array() as array<bigint>)")))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def _densified(minima: Column) -> Column:
    """One value per bin from the sorted minima of the bins that have one."""
    draw = random.Random(20)  # the probing orders are constants of the fingerprint
    probes = [F.array(*(F.lit(draw.randrange(BINS)) for _ in range(BINS))) for _ in range(PROBES)]
    steps = F.array(*(F.lit(draw.randrange(1, BINS, 2)) for _ in range(BINS)))
    numbers = F.sequence(F.lit(0), F.lit(BINS - 1))

    def spread(bins: Column) -> Column:
        own = F.transform(numbers, lambda i: F.get(minima, F.array_position(bins, i).cast("int") - 1))
        return let(own, lambda v: F.transform(numbers, lambda i: F.coalesce(
            F.get(v, i), F.xxhash64(i, F.coalesce(*(F.get(v, F.get(p, i)) for p in probes), F.get(
                F.filter(F.transform(numbers, lambda t: F.get(v, (i + (t + 1) * F.get(steps, i)) % BINS)),
                         lambda x: x.isNotNull()), F.lit(0)))))))

    return let(F.transform(minima, _bin), spread)


def _packed(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), lambda j: F.aggregate(
        F.slice(values, j * PER_WORD + 1, PER_WORD), F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")))))


def packed_fingerprint(text: Column, width: int = 5) -> Column:
    """Fingerprint of a text as 64-bit words of packed bins; null for a text without words (or null)."""
    def of(sorted_hashes: Column) -> Column:
        minima = F.filter(sorted_hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(sorted_hashes, i - 1))))
        return F.when(F.size(sorted_hashes) > 0, let(minima, lambda m: let(_densified(m), _packed)))

    words = split_words(F.coalesce(text, F.lit("")))
    return let(words, lambda w: let(F.sort_array(shingle_hashes(w, width)), of))


def as_hex(packed: Column) -> Column:
    """Packed fingerprint as text; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the texts behind two packed fingerprints, 0 to 1.

    Bins of different texts agree in their kept bits by chance once in 2 ** BITS; the share of equal bins is corrected
    for that. Two texts without words are alike (1), one with and one without are not (0).
    """
    ones = F.lit(int("1" * PER_WORD, 16)).cast("long")
    differing = F.lit(0)
    for j in range(BINS // PER_WORD):
        x = F.get(a, F.lit(j)).bitwiseXOR(F.get(b, F.lit(j)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones)
        differing = differing + F.bit_count(x)
    chance = 1 / (1 << BITS)
    share = F.lit(1.0) - differing / F.lit(float(BINS))
    return (F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0)
            .otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """Add ``fingerprint`` (hex) to every row. Null and empty texts get an empty one. Equal texts get equal ones.

    A column of that name is replaced; rows are independent, so ids may be null or repeat; an empty table stays empty.
    """
    return docs.withColumn("fingerprint", as_hex(packed_fingerprint(F.col(text), width)))


def ranges_with_next(docs: DataFrame, order: str = "doc_id", size: int = RANGE) -> DataFrame:
    """Rows dealt to ranges of ids, each range with a copy of the first row of the next one (the last: of the first).

    Adds ``range_no`` and ``is_copy``. Within a range, ordered by is_copy, id and further columns, each row stands
    before its successor, so a window over the range finds it. Only range numbers travel to find the next range that
    has rows. Rows without an id are left out.
    """
    own = docs.where(F.col(order).isNotNull()).withColumn("range_no", F.floor(F.col(order) / size))
    firsts = own.groupBy("range_no").agg(F.min(order).alias("first_id")).withColumn("block", F.floor(F.col("range_no") / size))
    blocks = firsts.groupBy("block").agg(F.max("range_no").alias("last_range"))
    blocks = blocks.select("block", F.coalesce(F.lag("last_range").over(W.orderBy("block")),
                                               F.max("last_range").over(W.partitionBy())).alias("range_before"))
    before = firsts.withColumn("lag", F.lag("range_no").over(W.partitionBy("block").orderBy("range_no"))).join(blocks, "block")
    ghosts = before.select(F.col("first_id"), F.coalesce("lag", "range_before").alias("to_range"))
    copies = (docs.join(ghosts, F.col(order) == F.col("first_id"))
              .select(*docs.columns, F.col("to_range").alias("range_no"), F.lit(True).alias("is_copy")))
    return own.select(*docs.columns, "range_no", F.lit(False).alias("is_copy")).unionByName(copies)
