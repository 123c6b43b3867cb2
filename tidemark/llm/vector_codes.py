"""Product codes of vectors: k-means per part of the vectors, in exact integers, with adaptive bounds on distances.

Each part of each vector keeps, from round to round, its entry, its b next closest entries with lower bounds of their
distances in ascending order, and one outer bound for all other entries. A round moves the bounds by how far the entries
moved. What lies above the exact distance to the own entry cannot win; only the uncertain head of the list is compared
in integers, and all entries only where even the outer bound fails. b shrinks to the longest head that was needed.
The state is a table that each round writes; codebooks are of fixed size and pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.common import settle, small

#: The list of a part starts with this share of the entries, and has at least so many.
LIST_SHARE, LEAST_LIST = 16, 2
#: Components from this size on cannot be squared and summed in 64 bits; such vectors are left out like infinite ones.
TOO_LARGE = 1 << 27
#: Rows that a task compares together, and rows of label sums that are broadcast at most.
ROWS, BROADCAST_ROWS = 4096, 100_000
#: Relative slack of a bound, far above the rounding of its arithmetic.
SLACK = 1e-9


def _squares(x, entries):
    """Exact squared distances of parts (n x d) to entries (k x d) or to own ones (n x m x d)."""
    import numpy as np

    if entries.ndim == 3:
        return ((entries - x[:, None]) ** 2).sum(2)
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if most * most * x.shape[1] * 4 < 1 << 52:  # whole numbers that doubles hold exactly
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def _below(squares):
    """Distances as lower bounds in four bytes."""
    import numpy as np

    return np.nextafter((np.sqrt(squares) * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def search_all(x, entries, b: int):
    """Entry, list, bounds and outer bound of parts by comparing all entries; ties go to the lower index."""
    import numpy as np

    d = _squares(x, entries)
    order = np.argsort(d, axis=1, kind="stable")[:, :b + 2]
    near = np.take_along_axis(d, order, 1)
    outer = _below(near[:, b + 1]) if near.shape[1] > b + 1 else np.full(len(x), np.inf, np.float32)
    return order[:, 0].astype(np.uint16), order[:, 1:b + 1].astype(np.uint16), _below(near[:, 1:b + 1]), outer


def search(x, entries, moves, code, near, lower, outer):
    """The same after the entries moved, and how much of its list each part needed (b + 1: all entries)."""
    import numpy as np

    b = near.shape[1]
    lower = np.nextafter(lower - moves[near].astype(np.float32), np.float32(-np.inf))
    outer = np.nextafter(outer - np.float32(moves.max(initial=0)), np.float32(-np.inf))
    ahead = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], 1)[:, ::-1], 1)[:, ::-1]
    own = np.sqrt(_squares(x, entries[code][:, None])[:, 0]) * (1 + SLACK)
    needed = (ahead <= own[:, None]).sum(1)
    code, near = code.copy(), near.copy()
    for j in np.unique(needed):
        rows = np.flatnonzero(needed == j)
        if j == b + 1:
            code[rows], near[rows], lower[rows], outer[rows] = search_all(x[rows], entries, b)
        elif j:
            ids = np.concatenate([code[rows, None], near[rows, :j]], 1)
            d = _squares(x[rows], entries[ids])
            order = np.lexsort((ids, d), axis=1)
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            code[rows] = ids[:, 0]
            near[rows[:, None], np.arange(j)], lower[rows[:, None], np.arange(j)] = ids[:, 1:], _below(d[:, 1:])
    return code, near, lower, outer, needed


class Codebooks:
    """Entries (parts x k x d integers) with the distances that they moved in the last round."""

    def __init__(self, entries, moves=None):
        self.entries, self.moves = entries, moves

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def updated(self, sums: list[Row]):
        """Entries replaced by the floored means of their parts; ``sums`` are (part, entry, place, total), place -1 the count."""
        import numpy as np

        new, totals = self.entries.copy(), {}
        for r in sums:
            totals[r.part, r.entry, r.place] = r.total
        for (part, entry, place), total in totals.items():
            if place >= 0:
                new[part, entry, place] = total // totals[part, entry, -1]
        apart = ((new - self.entries) ** 2).sum(2)
        return Codebooks(new, np.sqrt(apart.astype(float)) * (1 + SLACK))


def fixed_point(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """vec_id, label and ``x``, the floored scaled components, of the vectors that take part."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < TOO_LARGE))
    usable = vectors.where(F.col("embedding").isNotNull() & fit & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = usable.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).head()
    return usable.where(F.size("embedding") == (first.n if first else 0)).select("vec_id", "label", x.alias("x"))


def _arrow(table, name, kind, *shape):
    import numpy as np

    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, *shape)


def _binaries(array):
    import pyarrow as pa

    return pa.array([row.tobytes() for row in array], pa.binary())


STATE = "x binary, codes binary, near binary, lower binary, outer binary, needed binary, error long"


def _assigned(df: DataFrame, books: Codebooks, b: int, old_b: int | None) -> DataFrame:
    """The state (vec_id, label and STATE) after assigning every part; ``old_b`` is the list length of the state ``df``, None at the start."""
    parts, k, d = books.entries.shape

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                t = whole.slice(at, ROWS)
                n = t.num_rows
                if old_b is None:
                    x = t.column("x").flatten().to_numpy().reshape(n, parts, d)
                else:
                    x = _arrow(t, "x", np.int64, parts, d)
                    codes, near = _arrow(t, "codes", np.uint16, parts), _arrow(t, "near", np.uint16, parts, old_b)
                    lower, outer = _arrow(t, "lower", np.float32, parts, old_b), _arrow(t, "outer", np.float32, parts)
                new = []
                for p in range(parts):
                    if old_b is None:
                        new.append((*search_all(x[:, p], books.entries[p], b), np.zeros(n, np.int64)))
                    else:  # entries that a shorter list drops fall under the outer bound
                        out = np.minimum(outer[:, p], lower[:, p, b:].min(1, initial=np.inf))
                        new.append(search(x[:, p], books.entries[p], books.moves[p], codes[:, p], near[:, p, :b], lower[:, p, :b], out))
                codes, near, lower, outer, needed = (np.stack(c, 1) for c in zip(*new, strict=True))
                error = sum(_squares(x[:, p], books.entries[p][codes[:, p]][:, None])[:, 0] for p in range(parts))
                yield pa.RecordBatch.from_arrays(
                    [t.column("vec_id"), t.column("label"), _binaries(x), *map(_binaries, (codes, near, lower, outer, needed.astype(np.uint16))),
                     pa.array(error, pa.int64())], names=["vec_id", "label", *(c.split()[0] for c in STATE.split(", "))])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    columns = ["vec_id", "label", "x"] + ([] if old_b is None else ["codes", "near", "lower", "outer"])
    return df.select(*columns).mapInArrow(run, f"{kinds}, {STATE}")


def _sums(state: DataFrame, shape) -> list[Row]:
    """(part, entry, place, total) over all rows: component sums, counts (place -1) and, at entry -1, how often a list was needed so far."""
    parts, k, d = shape

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total, count, needed = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64), np.zeros(k + 2, np.int64)
        for t in batches:
            x, codes = _arrow(t, "x", np.int64, parts, d), _arrow(t, "codes", np.uint16, parts)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p])
                count[p] += np.bincount(codes[:, p], minlength=k)
            needed += np.bincount(_arrow(t, "needed", np.uint16, parts).reshape(-1), minlength=k + 2)
        p, e = np.nonzero(count)
        put = [(np.repeat(p, d), np.repeat(e, d), np.tile(np.arange(d), len(p)), total[p, e].reshape(-1)), (p, e, np.full(len(p), -1), count[p, e])]
        at = np.flatnonzero(needed)
        put.append((np.full(len(at), -1), np.full(len(at), -1), at, needed[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*put, strict=True)],
                                         names=["part", "entry", "place", "total"])

    rows = state.select("x", "codes", "needed").mapInArrow(run, "part long, entry long, place long, total long")
    return rows.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()


def list_length(b: int, needed: dict[int, int]) -> int:
    """Next length of the lists: the longest head that was needed, among those that a list could answer."""
    return max(LEAST_LIST, max((j for j in needed if j <= b), default=b)) if needed else b


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024):
    """Codes of vectors and their codebooks: (DataFrame of vec_id, label, codes, error; Codebooks), codes as two-byte numbers.

    Components become floor(scale * x); vectors are cut into equal parts, each with a codebook that starts as that part of
    the rows with the smallest vec_id (ties by the vector, null ids last). ``error`` is the squared distance in integers.
    Vectors that are null, empty, of another length than the first, not divisible into parts, or that hold null, not
    finite or too large (2 ** 27 after scaling) components are left out. Repeated ids are rows of their own; labels may be
    null; other columns are not read. With fewer rows than entries the codebooks are as long as there are rows; an empty
    table gives an empty result and empty codebooks.
    """
    import numpy as np

    rows = fixed_point(vectors, parts, scale)
    start = [r.x for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    shape = len(start), parts, -1
    books = Codebooks(np.array(start, np.int64).reshape(shape if start else (0, parts, 1)).transpose(1, 0, 2).copy())
    if not start:
        return rows.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), books
    k = len(start)
    b = max(0, min(k - 1, max(LEAST_LIST, k // LIST_SHARE)))
    state = settle(_assigned(rows, books, b, None))
    for _ in range(rounds):
        sums = _sums(state, books.entries.shape)
        books = books.updated([r for r in sums if r.part >= 0])
        needed = {r.place: r.total for r in sums if r.part < 0 and r.place}
        old, b = b, min(b, list_length(b, needed))
        state = settle(_assigned(state, books, b, old))
    return state.select("vec_id", "label", "codes", "error"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` and label_error, the sum of ``error`` over rows of the same label; null labels are one."""
    sums = small(settle(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))), BROADCAST_ROWS)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("same"))).drop("same")


def code_text(codes):
    """Two hex digits for each part, from two-byte little-endian numbers below 256."""
    digits = F.lower(F.hex(codes))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(codes) / 2 - 1, F.lit(0)).cast("int")),
                                    lambda i: F.substring(digits, 4 * i + 1, F.lit(2))), "")
