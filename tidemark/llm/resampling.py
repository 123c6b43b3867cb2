"""Resampling documents towards a target distribution by importance weights over hashed n-grams.

The features of a text are its runs of words, hashed by CRC-32 into buckets. Each normalised text is scanned once for
running CRCs, from which the CRC of every run follows (module ``crc``). Counts of the buckets over all documents and over
all target texts give each bucket a gain; a document's weight is the mean gain of its features, and seeded Gumbel noise
turns the highest scores into a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, settle, small
from tidemark.llm.crc import RunningCrc

#: Bytes of text that are scanned together; a longer text is scanned alone.
BLOCK = 1 << 19
#: Scores with the same number of documents above are joined by a broadcast up to this many rows.
BROADCAST_ROWS = 100_000


def features(texts: list[bytes], width: int, buckets: int):
    """For the texts of one block: bucket of each feature, its text's number, and each text's number of words."""
    import numpy as np

    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    inside = word[raw]
    edge = np.diff(inside.view(np.int8), prepend=0)
    starts, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = inside.copy()
    keep[after] = True  # one separator after each word
    place = np.cumsum(keep) - 1
    clean = np.where(inside, raw, 32)[keep]
    crc = RunningCrc(clean)
    low, high = place[starts], place[after]
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n_words)
    found, of = [], []
    for n in range(1, width + 1):
        first = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:]) if len(owner) >= n else np.zeros(0, np.int64)
        found.append(crc.of(low[first], high[first + n - 1]) % np.uint32(buckets))
        of.append(owner[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(of), n_words


def _blocks(texts) -> Iterator[list[bytes]]:
    block, size = [], 0
    for t in texts:
        t = t or b""
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield block


def bucket_counts(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts of ``rows``. A task sums its texts first and hands on a row per bucket."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in _blocks(batch.column(0).cast(pa.binary()).to_pylist()):
                total += np.bincount(features(block, width, buckets)[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    return rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, width: int, buckets: int) -> list[int]:
    """Gain of each bucket: floored thousandths of the log ratio of its smoothed shares in target and documents."""
    s, t = ({r.bucket: r.n for r in bucket_counts(x, width, buckets).collect()} for x in (docs, target))
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * n_s / ((s.get(b, 0) + 1) * n_t))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], width: int) -> DataFrame:
    """Per row: doc_id, n_features, n_words and weight, the floored mean gain of its features (0 without any)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        value = np.array(gain, np.int64)
        for batch in batches:
            counts, words, weight = [], [], []
            for block in _blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                found, of, n_words = features(block, width, len(value))
                n = np.bincount(of, minlength=len(block))
                total = np.zeros(len(block), np.int64)
                np.add.at(total, of, value[found])
                counts.append(n)
                words.append(n_words)
                weight.append(total // np.maximum(n, 1))
            put = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), put(counts), put(words), put(weight)],
                                             names=["doc_id", "n_features", "n_words", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_features long, n_words long, weight long")


def noise(name, seed: int):
    """Seeded Gumbel noise in floored thousandths, from the hash of a name."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("long")


def ranked(scored: DataFrame, percent: int, order) -> DataFrame:
    """``scored`` (with score and ``eligible``) and ``rank``: 1, 2, 3 ... for the highest scores, else null.

    Drawn are floor(percent * N / 100) of the N eligible rows, ties of the score by the columns ``order``. A rank is the
    number of rows with a higher score, from counts per score, and the place within the score; so no task orders all.
    """
    n = scored.where("eligible").count()
    drawn = n * percent // 100
    counts = (scored.where("eligible").groupBy("score").agg(F.count("*").alias("n"))
              .withColumn("coarse", F.shiftright("score", 8)))
    coarse = counts.groupBy("coarse").agg(F.sum("n").alias("n_coarse"))
    before = coarse.select("coarse", (F.sum("n_coarse").over(W.orderBy(F.desc("coarse"))) - F.col("n_coarse")).alias("before"))
    same = W.partitionBy("coarse").orderBy(F.desc("score"))
    above = (counts.join(F.broadcast(before), "coarse")
             .select("score", (F.col("before") + F.sum("n").over(same) - F.col("n")).alias("above")).where(F.col("above") < drawn))
    marked = scored.join(small(settle(above), BROADCAST_ROWS), "score", "left")
    open_ = F.col("eligible") & F.col("above").isNotNull()
    place = F.col("above") + F.row_number().over(W.partitionBy("score").orderBy(*order))
    high = marked.where(open_).withColumn("rank", F.when(place <= drawn, place).cast("long"))
    low = marked.where(~open_).withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(low).drop("above")


def importance_scores(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10,
                      least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score and rank (null where it is not drawn), all long but doc_id.

    Words are runs of letters, digits and all other than ASCII characters, A-Z in lower case; features are runs of 1 to
    ``width`` words. A null text has none; its weight is 0. Texts with fewer than ``least_words`` words are never drawn.
    Rows that repeat an id have the same noise and are each drawn by their own score; rows without an id share the noise of
    the name ``null`` and come last in ties. Other columns are not read. An empty table gives an empty result, an empty
    target a gain that only the documents' own frequencies decide.
    """
    gain = gains(docs, target, width, buckets)
    scored = settle(weights(docs, gain, width).withColumn(
        "score", F.col("weight") + noise(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed))
        .withColumn("eligible", F.col("n_words") >= least_words))
    return ranked(scored, percent, [F.asc_nulls_last("doc_id"), "n_features"]).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10,
             least_words: int = 20, seed: int = 2024) -> DataFrame:
    """The drawn rows of ``docs``, columns as they are; rows that share an id or have none are told apart."""
    rows, key = keyed(docs)
    gain = gains(rows, target, width, buckets)
    name = F.coalesce(F.col("doc_id.id").cast("string"), F.lit("null"))
    place = F.struct(F.col("doc_id").alias("id"), F.col(key).alias("key"))
    scored = settle(weights(rows.select(place.alias("doc_id"), "text"), gain, width)
                    .withColumn("score", F.col("weight") + noise(name, seed)).withColumn("eligible", F.col("n_words") >= least_words))
    drawn = ranked(scored, percent, [F.asc_nulls_last("doc_id.id"), "doc_id.key"]).where("rank is not null")
    return rows.join(drawn.select(F.col("doc_id.key").alias(key)), key, "left_semi").select(*(f"`{c}`" for c in docs.columns))
