"""Components of sets under links that only an exact comparison can show, without a list of candidate pairs.

Sets that may be linked share a route, a key that an operator gives them. A task gets a bounded group of sets and returns
links that connect what is linked in it: a spanning forest, never all pairs.

First, sets meet by cluster, the smallest set with which they share a route; most links are found there. A cluster beyond a
task's bounds is cut into blocks whose components then meet by one set each, until they fit. What remains are routes
over several components: their sets meet whole, a group beyond the bounds as pairs of blocks, but pairs of
one component are not compared again. So every two sets that share a route are connected or have been compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle, small

#: Words and sets that a task compares together; a pair of blocks has up to twice as many.
LOAD, SETS = 1 << 19, 1024
#: Rows of an assignment table that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

GROUP = ["level", "slot", "low", "high"]
#: forest(set keys, labels, sides, columns as Arrow table) -> linked pairs of places; sides 0 and 1 are compared across if both occur.
Forest = Callable


def _forest(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components: in each partition, every node to the smallest that it reaches there."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        nodes = [x for x, up in above.items() if up != x]
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """Components of links (a, b): (node, label), the label being the smallest node of the component.

    Links are first contracted within partitions. Then labels spread to neighbours and jump to the label of their
    label, until none changes.
    """
    links = settle(_forest(links))
    edges = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = settle(spread.join(jump, "label").select("node", "old", F.least("label", "root").alias("label")))
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) of all nodes after new links between labels (a, b)."""
    links = settle(links)
    if links.isEmpty():
        return labels
    roots = small(connected(links), BROADCAST_ROWS).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return settle(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def _times(load: str, n: str) -> Column:
    """Blocks into which a group of this load and so many sets is cut."""
    return F.greatest(F.ceil(F.col(load) / LOAD), F.ceil(F.col(n) / SETS)).cast("long")


def _together(rows: DataFrame, group: str) -> DataFrame:
    """level and slot for the rows of groups (``group``, load, blocks, most): small groups of like size share a task's group."""
    alone = rows.where("blocks = 1").select(group, "total", "most").distinct().withColumn("level", F.floor(F.log2(F.greatest("most", F.lit(1)))).cast("int"))
    levels = alone.groupBy("level").agg(F.sum("total").alias("total"), F.count("*").alias("n")).collect()  # at most 64
    slots = F.create_map(*(F.lit(x) for r in levels for x in (r.level, max(1, -(-r.total // LOAD), -(-r.n // (SETS // 2)))))) if levels else F.create_map().cast("map<int,int>")
    level = F.floor(F.log2(F.greatest("most", F.lit(1)))).cast("int")
    return (rows.withColumn("level", F.when(F.col("blocks") == 1, level).otherwise(-1))
            .withColumn("slot", F.when(F.col("level") >= 0, F.pmod(F.xxhash64(group), F.coalesce(F.element_at(slots, F.col("level")), F.lit(1)).cast("long")))
                        .otherwise(F.col(group))))


def _with_totals(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (group, set_key, load) with total and most load of their group and the blocks that it needs."""
    totals = rows.groupBy(group).agg(F.sum("load").alias("total"), F.max("load").alias("most"), F.count("*").alias("n")).withColumn("blocks", _times("total", "n"))
    return settle(rows.join(totals.drop("n"), group))


def _links(rows: DataFrame, data: DataFrame, forest: Forest) -> DataFrame:
    """Links (a, b) between labels that ``forest`` finds in the groups of ``rows`` (GROUP, side, set_key, label); ``data`` has the sets' columns."""
    def run(table):
        import pyarrow as pa

        label = table.column("label").to_numpy()
        pairs = forest(label, table.column("side").to_numpy(), table)
        return pa.table({c: pa.array([int(label[p[i]]) for p in pairs], pa.int64()) for i, c in enumerate("ab")})

    return data.join(small(rows, BROADCAST_ROWS), "set_key").groupBy(*GROUP).applyInArrow(run, "a long, b long")


def _sieved(rows: DataFrame, sketches: DataFrame | None, sieve: Forest | None) -> DataFrame:
    """The settled rows (GROUP, side, set_key, label) that ``sieve`` keeps, all without one."""
    if sieve is None:
        return rows

    def run(table):
        return table.take(sieve(table.column("label").to_numpy(), table.column("side").to_numpy(), table)).drop_columns(["sketch", "n_shingles"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return settle(sketches.select("set_key", "sketch", "n_shingles").join(small(rows, BROADCAST_ROWS), "set_key")
                  .select(*rows.columns, "sketch", "n_shingles").groupBy(*GROUP).applyInArrow(run, kinds))


def _by_cluster(rows: DataFrame, data: DataFrame, labels: DataFrame, forest: Forest, sift: Callable) -> tuple[DataFrame, DataFrame]:
    """Labels after comparing the sets of a cluster, by blocks where it is large; and the rows (cluster, set_key, load) that are to meet again."""
    sized = _with_totals(rows, "cluster")
    placed = _together(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("set_key", "total"), "blocks"))
    named = placed.join(labels.withColumnRenamed("node", "set_key"), "set_key")
    labels = merged(labels, _links(sift(settle(named.select(
        "level", "slot", F.col("block").alias("low"), F.col("block").alias("high"), F.lit(0).alias("side"), "set_key", "label"))), data, forest))
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return labels, large
    own = large.join(labels.withColumnRenamed("node", "set_key"), "set_key")
    first = own.groupBy("cluster", "label").agg(F.min_by(F.struct("set_key", "load"), "set_key").alias("one"))
    several = first.groupBy("cluster").count().where("count > 1").select("cluster")
    return labels, settle(first.join(several, "cluster").select("cluster", "one.set_key", "one.load"))


def _open_rows(members: DataFrame, loads: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups (GROUP, side, set_key, label) in which all sets of routes over several components meet."""
    own = members.select("route", "set_key").join(labels.withColumnRenamed("node", "set_key"), "set_key")
    spans = own.groupBy("route").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first != last").select("route", "first")
    rows = settle(own.join(spans, "route").join(loads, "set_key"))
    heavy = rows.groupBy("first").agg(F.ceil(F.sum("load") / LOAD).alias("splits"))
    sets = (rows.join(heavy, "first").select(F.xxhash64("first", F.pmod(F.xxhash64("route"), F.col("splits"))).alias("family"), "set_key", "label", "load")
            .dropDuplicates(["family", "set_key"]))
    placed = _together(_with_totals(sets, "family"), "family")
    alone = placed.where("blocks = 1").select("level", "slot", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"),
                                              F.lit(0).alias("side"), "set_key", "label")
    # In a large group the largest component has blocks of its own, which do not meet each other.
    large = placed.where("blocks > 1")
    by_label = large.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    sizes = by_label.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max(F.struct("n", "label", "load")).alias("m"),
                                           F.sum("n").alias("n"), F.sum("load").alias("load"))
    cuts = sizes.select("family", "main", F.col("m.n").alias("n_main"), F.col("m.load").alias("load_main"),
                        (F.col("n") - F.col("m.n")).alias("n_rest"), (F.col("load") - F.col("m.load")).alias("load_rest"))
    cuts = cuts.select("family", "main", _times("load_main", "n_main").alias("mains"), _times("load_rest", "n_rest").alias("rests"))
    is_main = F.col("label") == F.col("main")
    end = F.col("mains") + F.col("rests") - 1
    pairs = (large.join(cuts, "family")
             .withColumn("block", F.when(is_main, F.pmod(F.xxhash64("set_key"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("set_key"), "rests")))
             .withColumn("other", F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0).cast("long")), end)))
             .select("level", "slot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     (F.col("block") > F.col("other")).cast("int").alias("side"), "set_key", "label"))
    return settle(alone.unionByName(pairs))


def link(members: DataFrame, data: DataFrame, forest: Forest, sieve: Forest | None = None, sketches: DataFrame | None = None) -> DataFrame:
    """Labels (node, label) of the sets of ``members`` (route, set_key, lead: the route's smallest set).

    ``data`` has the columns that ``forest`` compares and load, its words, by set_key. ``sieve`` may drop the sets of a
    group that ``sketches`` show to have no partner there, before their data are sent; it returns the places of those that stay.
    """
    def sift(rows: DataFrame) -> DataFrame:
        return _sieved(rows, sketches, sieve)

    loads = settle(data.select("set_key", "load"))
    clusters = settle(members.groupBy("set_key").agg(F.min("lead").alias("cluster")).join(loads, "set_key"))
    labels = clusters.select(F.col("set_key").alias("node"), F.col("set_key").alias("label"))
    n = None
    while n is None or n > 0:
        labels, clusters = _by_cluster(clusters, data, labels, forest, sift)
        last, n = n, clusters.count()
        if last is not None and n > 0.7 * last:  # more rounds would not help; what follows is complete in any case
            break
    rows = _open_rows(members, loads, labels)
    return merged(labels, _links(sift(rows), data, forest))
