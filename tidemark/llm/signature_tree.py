"""Documents with similar word n-grams, joined exactly through signature trees.

A set's signature is a bitmap of its shingles. A tree over the sets of a task holds in each node the OR of the signatures
below, the range of their sizes and the most shingles that one of them loses to shared bits; two sets under a pair of
nodes share at most as many shingles as the bitmaps have common bits, plus that loss. A traversal of two trees (or of one
with itself) drops the pairs of nodes whose sizes or greatest possible overlap forbid a link, or which lie in one component already, and
compares the full sets of the pairs of leaves that remain.

Which sets meet in a tree follows from the pigeonhole principle. Linked sets A and B differ in at most
(|A| + |B|) (100 - p) / (100 + p) shingles; dealt by hash into one part more than that, some part is the same in both. A set's
routes are the hashes of its parts, for its class of sizes and for each larger class that a partner may have. So no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of_texts, settle, small
from tidemark.llm.hashing import ShingleSets, mix
from tidemark.llm.linking import link

#: Children of a node; bits of a signature for each shingle of the largest set, and bits of all signatures of a tree at most.
FANOUT, BITS, ALL_BITS = 8, 8, 1 << 24
#: 64-bit words of signatures that are compared at once.
WORDS = 1 << 18
#: Ratio of the sizes at the ends of a class.
CLASS_RATIO = 1.25
#: Rows of an assignment table that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def size_classes(most: int):
    """Upper ends of the classes of set sizes, up to one that holds ``most``."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, int(ends[-1] * CLASS_RATIO)))
    return ends


def routes(sets, percent: int):
    """Hashes of the parts of each set, for all its classes: (values, number for each set); sets must not be empty."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    ends = np.array(size_classes(int(sizes.max(initial=1)) * 100 // percent + 1))
    own, last = np.searchsorted(ends, sizes), np.searchsorted(ends, sizes * 100 // percent)
    which = np.concatenate([np.arange(a, b + 1) for a, b in zip(own, last, strict=True)])
    of = np.repeat(np.arange(len(sets)), last - own + 1)
    parts = 2 * ends[which] * (100 - percent) // (100 + percent) + 1
    base = np.concatenate([[0], np.cumsum(parts)])
    hashes = np.zeros(base[-1], np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    shingles = np.concatenate(sets)
    values, places = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), shingles >> np.uint64(31)
    for first in range(0, len(of), 4096):  # bounded copies
        rows = np.arange(first, min(first + 4096, len(of)))
        n = sizes[of[rows]]
        at = np.repeat(starts[of[rows]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        slot = np.repeat(base[rows], n) + (places[at] % np.repeat(parts[rows], n).astype(np.uint64)).astype(np.int64)
        np.add.at(hashes, slot, values[at])
    part = np.arange(base[-1]) - np.repeat(base[:-1], parts)
    hashes = mix(hashes + mix((np.repeat(which, parts) * (1 << 32) + part).astype(np.uint64) + np.uint64(1)))
    return hashes.view(np.int64), np.bincount(of, weights=parts, minlength=len(sets)).astype(np.int64)


def set_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, n_shingles, load (bytes of text over 6), set_key of the whole set and its routes (null if empty)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = ShingleSets(width)
        for batch, texts in batches_of_texts(batches, 1):
            sets = list(own.of(texts))
            full = [s for s in sets if len(s)]
            values, n = routes(full, percent) if full else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            counts = np.zeros(len(sets), np.int64)
            counts[[i for i, s in enumerate(sets) if len(s)]] = n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([len(t) // 6 + 1 for t in texts], pa.int64()),
                 pa.array([set_key(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))],
                names=["doc_id", "n_shingles", "load", "set_key", "routes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, load long, set_key long, routes array<long>")


def set_key(s):
    """64-bit key of a whole set; none for an empty one."""
    from hashlib import blake2b

    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None


def signature_bits(sets) -> int:
    """Bits of a signature of these sets, a power of two."""
    bits = 1 << max(6, (BITS * max(len(s) for s in sets) - 1).bit_length())
    while bits > 64 and bits * len(sets) > ALL_BITS:
        bits //= 2
    return bits


def signatures(sets, bits: int):
    """Bitmaps of sets, their sizes and the shingles that each loses to shared bits."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    flags = np.zeros((len(sizes), bits), bool)
    flags[np.repeat(np.arange(len(sizes)), sizes), (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)] = True
    marks = np.packbits(flags, axis=1).view(np.uint64)
    return marks, sizes, sizes - np.bitwise_count(marks).sum(1, dtype=np.int64)


class SignatureTree:
    """Nodes by level, leaves first; ``places`` are the sets of the leaves in the order of the tree."""

    def __init__(self, sets, places, bits: int, height: int):
        import numpy as np

        order = np.lexsort((np.array([len(sets[i]) for i in places]), np.array([sets[i][0] for i in places], np.uint64)))
        self.places = np.asarray(places)[order]
        marks, sizes, lost = signatures([sets[i] for i in self.places], bits)
        self.levels = [(marks, sizes, sizes, lost)]
        while len(self.levels) < height:
            marks, low, high, lost = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(marks, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(lost, at)))

    def components(self, level: int, label):
        """Component of each node whose sets are all in one, else -1."""
        import numpy as np

        own = label[self.places]
        if not level:
            return own
        at = np.arange(0, len(own), FANOUT ** level)
        low, high = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
        return np.where(low == high, low, -1)


def height_of(n: int) -> int:
    h = 1
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def tree_links(sets, label, side, percent: int, seen: list | None = None):
    """Pairs of places that connect what is linked across components; ``label`` is changed to the components found.

    With sets on both sides only pairs across them are compared. ``seen`` gets the pairs of nodes met and the pairs of sets compared.
    """
    import numpy as np

    halves = [np.flatnonzero(side == s) for s in (0, 1)]
    halves = [h for h in halves if len(h)]
    if not halves:
        return []
    bits = signature_bits(sets)
    height = max(height_of(len(h)) for h in halves)
    trees = [SignatureTree(sets, h, bits, height) for h in halves]
    one, two = trees[0], trees[-1]
    itself, chunk = one is two, max(1, WORDS * 64 // bits)
    stack, found = [(height - 1, height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))], []

    def children(tree, level, nodes):
        below = nodes[:, None] * FANOUT + np.arange(FANOUT)
        return below, below < len(tree.levels[level - 1][1])

    while stack:
        high, low, x, y = stack.pop()
        if len(x) > chunk:
            stack.append((high, low, x[chunk:], y[chunk:]))
            x, y = x[:chunk], y[:chunk]
        in_x, in_y = one.components(high, label)[x], two.components(low, label)[y]
        apart = (in_x != in_y) | (in_x < 0)
        x, y = x[apart], y[apart]
        (marks_x, low_x, high_x, lost_x), (marks_y, low_y, high_y, lost_y) = one.levels[high], two.levels[low]
        fit = (100 * high_x[x] >= percent * low_y[y]) & (100 * high_y[y] >= percent * low_x[x])
        x, y = x[fit], y[fit]
        common = np.bitwise_count(marks_x[x] & marks_y[y]).sum(1, dtype=np.int64) + np.minimum(lost_x[x], lost_y[y])
        common = np.minimum(common, np.minimum(high_x[x], high_y[y]))
        fit = (100 + percent) * common >= percent * (low_x[x] + low_y[y])
        if seen is not None:
            seen[0] += len(fit)
        x, y, common = x[fit], y[fit], common[fit]
        if high or low:
            same = (x == y) if itself and high == low else np.zeros(len(x), bool)
            if (~same).any():  # go down on one side: a set against a node is bounded far better than two nodes
                x_, y_ = x[~same], y[~same]
                if high >= low:
                    below, here = children(one, high, x_)
                    stack.append((high - 1, low, below[here], np.broadcast_to(y_[:, None], here.shape)[here]))
                else:
                    below, here = children(two, low, y_)
                    stack.append((high, low - 1, np.broadcast_to(x_[:, None], here.shape)[here], below[here]))
            if same.any():  # the nearest pairs first: they connect most
                below, here = children(one, high, x[same])
                cx, cy = (np.broadcast_to(v, (*below.shape, FANOUT)).reshape(-1) for v in (below[:, :, None], below[:, None, :]))
                both = (here[:, :, None] & here[:, None, :]).reshape(-1) & ((cx < cy) | ((cx == cy) & (high > 1)))
                stack.append((high - 1, high - 1, cx[both], cy[both]))
            continue
        for i in np.argsort(-common, kind="stable"):
            a, b = one.places[x[i]], two.places[y[i]]
            if label[a] == label[b]:
                continue
            if seen is not None:
                seen[1] += 1
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                label[label == label[b]] = label[a]
                found.append((a, b))
    return found


def similar_documents(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Sets are the distinct shingles of ``width`` words between ASCII white space, A-Z in lower case; a text with fewer words
    is one shingle. Rows are linked if 100 * intersection >= percent * union. A null text or one without words has an
    empty set and is linked with nothing. Equal sets are one node, compared once. Rows that repeat an id are each judged by their
    own text; null ids are larger than all others, and a row alone with a null id has a null component_id. Sets are told
    apart by 64-bit keys, shingles by 64-bit hashes. Other columns are not read. An empty table gives an empty result.
    """
    rows = settle(set_rows(docs, width, percent))
    full = rows.where("set_key is not null")
    dealt = full.select("set_key", F.explode("routes").alias("route"))
    shared = dealt.groupBy("route").agg(F.min("set_key").alias("lead"), F.max("set_key").alias("last")).where("lead != last").select("route", "lead")
    members = settle(dealt.join(shared, "route").select("route", "set_key", "lead").distinct())
    wanted = members.select("set_key").distinct().join(
        full.groupBy("set_key").agg(F.min("doc_id").alias("rep_id"), F.max("load").alias("load")), "set_key")
    data = texts_of(docs, settle(wanted), width)
    tools: dict[str, ShingleSets] = {}  # made once in a task

    def forest(label, side, table):
        import numpy as np

        if not tools:
            tools["sets"] = ShingleSets(width)
        sets = list(tools["sets"].of(table.column("text").to_pylist()))
        return tree_links(sets, np.unique(label, return_inverse=True)[1], side, percent)

    return labelled(rows, link(members, data, forest))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of ``rows`` (doc_id, n_shingles, set_key) from labels (node, label) of the sets."""
    own = rows.join(labels, F.col("set_key") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "set_key").alias("label"))
    smallest = own.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    alone = own.where("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.join(smallest, "label").select("doc_id", "n_shingles", F.col("smallest").alias("component_id")).unionByName(alone)


def texts_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """One text for each wanted set (set_key, rep_id and others), found by its document's id and checked by its key, with the other columns."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = ShingleSets(width)
        for batch, texts in batches_of_texts(batches, 1):
            yield batch.filter(pa.array([set_key(s) == k for s, k in zip(own.of(texts), batch.column(0).to_pylist(), strict=True)], pa.bool_()))

    found = docs.where("text is not null").select("doc_id", "text").join(
        small(wanted, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("set_key", "text", *(c for c in wanted.columns if c not in ("set_key", "rep_id")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return settle(found.mapInArrow(run, kinds).dropDuplicates(["set_key"]))
