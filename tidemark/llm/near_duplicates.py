"""Near-duplicate documents by SetSketch registers.

Each register of a sketch is the minimum of exponentially distributed hash values over the set's elements, truncated to
a step of a geometric scale. Registers merge by their larger step and agree with a chance that grows with the
similarity of the sets. Bands of registers propose pairs; the likelihood of the three ways in which registers compare
estimates the similarity; links are confirmed on the full shingle sets.

Sets meet by the buckets of their bands as module ``linking`` describes. Where sets meet, estimates rule out what is far
below the limit, and the other pairs are compared in full there and then, unless they are connected already. So no pair is
listed, and every pair that shares a bucket is connected, compared or estimated to be far below the limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of_texts, keyed, settle
from tidemark.llm.hashing import ShingleSets, mix
from tidemark.llm.linking import link
from tidemark.llm.signature_tree import labelled, set_key, signature_bits, signatures, texts_of

#: Registers; at 42 bands of 6 a pair of similarity 0.8 is missed with a chance of 3e-6, while sets with little in common rarely
#: share a band: registers of unrelated sets agree once in 20.
REGISTERS, BAND = 256, 6
#: Ratio of the geometric scale, and its offset: registers are one byte.
RATIO, OFFSET = 1.1, 32.0
#: An estimate this far below the limit (five standard errors) rules a pair out.
MARGIN = 0.125
#: Elements that a task draws registers for together.
ELEMENTS = 60_000


def sketches(sets):
    """Registers (sets x REGISTERS bytes) of sets of distinct hashes; sets must not be empty.

    Each element is a Poisson process of marks on the registers: the first mark on a register is exponentially
    distributed. Marks are drawn in rising order up to a level at which all registers of the set are very probably hit;
    sets for which they are not go on to a higher level.
    """
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    first = np.full((len(sets), REGISTERS), np.inf)
    todo, level = np.arange(len(sets)), math.log(REGISTERS) + 5
    while len(todo):
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, sizes[todo])
        most = (level / sizes)[owner]
        at = np.zeros(len(element))
        step = 0
        while len(element):
            step += 1
            r = mix(element + np.uint64(step * 0xD1B54A32D192ED03 % 2**64))
            at = at - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / REGISTERS
            keep = at <= most
            element, owner, most, at, r = element[keep], owner[keep], most[keep], at[keep], r[keep]
            np.minimum.at(first.reshape(-1), owner * REGISTERS + (r & np.uint64(REGISTERS - 1)).astype(np.int64), at)
        todo = np.flatnonzero(np.isinf(first).any(1))
        level *= 3
    return np.clip(np.floor(OFFSET - np.log(first) / math.log(RATIO)), 0, 255).astype(np.uint8)


def estimate(a, b, size_a, size_b):
    """Maximum-likelihood similarity of pairs of sets from their registers and sizes."""
    import numpy as np

    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = size_a / (size_a + size_b)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (RATIO - 1) / RATIO) / math.log(RATIO)
    more, less = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    fit = up[:, None] * np.log(more + tiny) + down[:, None] * np.log(less + tiny) + same[:, None] * np.log(
        np.clip(1 - more - less, tiny, 1))
    return grid[np.arange(len(u)), fit.argmax(1)]


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n_shingles, load (bytes of text over 6), set_key (of the whole set; null if empty) and sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = ShingleSets(width)
        for batch, texts in batches_of_texts(batches, 1):
            sizes, keys, registers, part, elements = [], [], [], [], 0
            for s in own.of(texts):
                sizes.append(len(s))
                keys.append(set_key(s))
                if len(s):
                    part.append(s)
                    elements += len(s)
                if elements > ELEMENTS:
                    registers.append(sketches(part))
                    part, elements = [], 0
            if part:
                registers.append(sketches(part))
            rows = iter(np.concatenate(registers) if registers else ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([len(t) // 6 + 1 for t in texts], pa.int64()), pa.array(keys, pa.int64()),
                 pa.array([next(rows).tobytes() if n else None for n in sizes], pa.binary())],
                names=["doc_id", "n_shingles", "load", "set_key", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, load long, set_key long, sketch binary")


def _partners(label, side, registers, sizes, limit: float):
    """For each set the later ones, or those of the other side, whose registers agree often enough and whose sizes allow a link."""
    import numpy as np

    left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    for i in left:
        j = right[right > i] if left is right or side.min() == side.max() else right
        j = j[(label[j] != label[i]) & (np.minimum(sizes[j], sizes[i]) + 1e-9 >= limit * np.maximum(sizes[j], sizes[i]))]
        # registers that differ in more than half of all places are far below any limit that this serves
        j = j[(registers[j] == registers[i]).sum(1) >= REGISTERS * max(0.0, limit - MARGIN)]
        if len(j):
            yield i, j


def _likeness(i, j, registers, sizes):
    import numpy as np

    return estimate(np.broadcast_to(registers[i], (len(j), REGISTERS)), registers[j], np.full(len(j), float(sizes[i])), sizes[j].astype(float))


def sketch_links(label, side, registers, sizes, sets_of, percent: int):
    """Pairs of places that connect what is linked across components; ``sets_of`` gives the full sets of places."""
    import numpy as np

    limit, found = percent / 100, []
    near = list(_partners(label, side, registers, sizes, limit))
    if not near:
        return found
    places = np.unique(np.concatenate([[i for i, _ in near], *(j for _, j in near)]).astype(np.int64))
    sets = sets_of(places)
    marks, _, lost = signatures(sets, signature_bits(sets))
    at = np.zeros(len(label), np.int64)
    at[places] = np.arange(len(places))
    for i, j in near:
        j = j[label[j] != label[i]]
        # what two sets can share at most, by their bitmaps
        common = np.bitwise_count(marks[at[j]] & marks[at[i]]).sum(1, dtype=np.int64) + np.minimum(lost[at[j]], lost[at[i]])
        j = j[(100 + percent) * common >= percent * (sizes[j] + sizes[i])]
        if not len(j):
            continue
        likely = _likeness(i, j, registers, sizes)
        for k in np.argsort(-likely, kind="stable"):
            if likely[k] < limit - MARGIN:
                break
            if label[j[k]] == label[i]:
                continue
            a, b = sets[at[i]], sets[at[j[k]]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                label[label == label[j[k]]] = label[i]
                found.append((i, j[k]))
    return found


def _registers(table):
    import numpy as np

    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS), table.column("n_shingles").to_numpy()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Sets are the distinct shingles of ``width`` words; a text with fewer words is one shingle. Documents whose sets
    have 100 * intersection >= percent * union are linked; a component is what links reach, component_id its
    smallest doc_id, kept whether that is the row's own. A null text or one without words has an empty set and is linked
    with nothing. Equal sets are linked first and compared once. Rows that repeat an id are each judged by
    their own text, and share ``kept``; null ids are larger than all others, and rows that are alone with a null id
    are kept with a null component_id. Other columns are not read. An empty table gives an empty result.
    """
    rows = settle(set_table(docs, width))
    sets = settle(rows.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep_id"), F.first("n_shingles").alias("n_shingles"), F.max("load").alias("load"), F.first("sketch").alias("sketch")))
    bands = [F.xxhash64(F.lit(i), F.expr(f"substring(sketch, {i * BAND + 1}, {BAND})")) for i in range(REGISTERS // BAND)]
    banded = sets.select("set_key", F.explode(F.array(*bands)).alias("route"))
    shared = banded.groupBy("route").agg(F.min("set_key").alias("lead"), F.max("set_key").alias("last")).where("lead != last").select("route", "lead")
    members = settle(banded.join(shared, "route"))
    data = texts_of(docs, settle(members.select("set_key").distinct().join(sets, "set_key")), width)
    tools: dict[str, ShingleSets] = {}  # made once in a task

    def forest(label, side, table):
        import numpy as np

        if not tools:
            tools["sets"] = ShingleSets(width)
        texts = table.column("text")
        return sketch_links(np.unique(label, return_inverse=True)[1], side, *_registers(table),
                            lambda places: list(tools["sets"].of(texts.take(places).to_pylist())), percent)

    def sieve(label, side, table):
        import numpy as np

        registers, sizes = _registers(table)
        stay = np.zeros(len(label), bool)
        for i, j in _partners(label, side, registers, sizes, percent / 100):
            j = j[_likeness(i, j, registers, sizes) >= percent / 100 - MARGIN]
            stay[j] = True
            stay[i] |= len(j) > 0
        return np.flatnonzero(stay)

    found = labelled(rows, link(members, data, forest, sieve, sets))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stay when one row of each component is kept, columns as they are.

    The row with the smallest doc_id stays, one without an id only where all are; rows that share an id are told apart by
    a key of their own. Rows with an empty set are in no component and stay.
    """
    rows, key = keyed(docs)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    gone = near_duplicates(rows.select(place.alias("doc_id"), "text"), width, percent).where("not kept").select(F.col("doc_id.key").alias(key))
    return rows.join(gone, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
