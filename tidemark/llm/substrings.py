"""Removing byte strings that an earlier document has already, with run-length indexes of the repetitive parts.

Four steps, each a Spark stage. Documents are dealt to chunks, and everything that travels between chunks is packed.

1. Anchors. Of the 32-byte strings inside each 50-byte window the one with the smallest hash is its anchor. Equal
   windows have equal anchors, so only windows whose anchor stands in two documents can repeat. Chunks send sorted,
   delta-coded anchor hashes to the routes that collect them and get a bit for each back.
2. Segments. Stretches of such windows are cut into segments of windows that share a shorter anchor, and the distinct
   segments of a chunk, with the first document of each, go to the route of that anchor: equal windows meet there.
3. Run-length indexes. A segment that was seen before repeats wholly. Of the others, the earliest of each anchor are
   indexed in a run-compressed Burrows-Wheeler transform, and the later ones streamed through it; their windows with a
   match of 50 bytes are marked. What an earlier segment has not explained is indexed next, and so on.
4. Marks return to the chunks, which join them into removed runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions
from tidemark.llm.hashing import BASE, UNDO, byte_values, mix, powers
from tidemark.llm.run_index import RunLengthIndex

#: Bytes of a repeated string, of an anchor, and of the shorter anchor that segments are routed by.
WINDOW, ANCHOR, ROUTE = 50, 32, 10
#: Bytes of text hashed together in a task, and of a chunk of documents.
BLOCK, CHUNK = 1 << 18, 8 << 20
#: Windows in a segment.
SEGMENT = 40
#: Bytes of segments that are indexed together, and rounds of indexing; what is open then is grouped window by window.
INDEXED, ROUNDS = 1 << 21, 4


class Windows:
    """Hashes over blocks of documents: anchors of all windows, routes, and range hashes."""

    def __init__(self):
        self.values = byte_values()
        self.up, self.down = powers(BASE, 2 * BLOCK), powers(UNDO, 2 * BLOCK)

    @staticmethod
    def blocks(texts: list[bytes]):
        """(first, texts) of consecutive texts of about BLOCK bytes."""
        first, size, part = 0, 0, []
        for i, t in enumerate(texts):
            if part and size + len(t) > BLOCK:
                yield first, part
                first, size, part = i, 0, []
            part.append(t)
            size += len(t)
        if part:
            yield first, part

    def grams(self, raw, most: int = 32):
        """Polynomial hashes of all strings of 1, 2, 4, ... ``most`` bytes."""
        import numpy as np

        h, k = {1: self.values[raw]}, 1
        while k < most:
            h[2 * k] = h[k][:-k] * np.uint64(pow(BASE, k, 1 << 64)) + h[k][k:] if len(h[k]) > k else h[k][:0]
            k *= 2
        return h

    @staticmethod
    def smallest(h, width: int):
        """Minimum of each ``width`` neighbours."""
        import numpy as np

        size = 1
        while 2 * size <= width:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        rest = width - size
        return np.minimum(h[:len(h) - rest], h[rest:]) if rest else h

    def of(self, texts: list[bytes], routes: bool = False):
        """(raw bytes, owner text of each window or -1, anchor of each window, route anchor of each window)."""
        import numpy as np

        joined = b"".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        n = len(raw) - WINDOW + 1
        if n <= 0:
            none = np.zeros(0, np.uint64)
            return joined, none.astype(np.int64), none, none
        grams = self.grams(raw)
        anchor = self.smallest(mix(grams[32]), WINDOW - ANCHOR + 1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), lengths)[:n]
        owner = np.where(np.arange(n) + WINDOW <= np.cumsum(lengths)[owner], owner, -1)
        return joined, owner, anchor, self.routes(grams, len(raw)) if routes else None

    def routes(self, grams, n: int):
        """Route anchor of each window of ``n`` bytes."""
        import numpy as np

        ten = grams[8][:n - ROUTE + 1] * np.uint64(pow(BASE, 2, 1 << 64)) + grams[2][8:8 + n - ROUTE + 1]
        return self.smallest(mix(ten + np.uint64(1)), WINDOW - ROUTE + 1)

    def first_routes(self, texts: list[bytes]):
        """Route anchor of the first window of each text."""
        import numpy as np

        found = [np.zeros(0, np.uint64)]
        for _, part in self.blocks(texts):
            raw = np.frombuffer(b"".join(part), np.uint8)
            found.append(self.routes(self.grams(raw, 8), len(raw))[np.cumsum([0, *map(len, part)])[:-1]])
        return np.concatenate(found)

    def whole(self, raw):
        """Polynomial hash of each window."""
        import numpy as np

        grams, n = self.grams(raw), len(raw) - WINDOW + 1
        out, at = np.zeros(n, np.uint64), 0
        for k in (32, 16, 2):
            out = out * np.uint64(pow(BASE, k, 1 << 64)) + grams[k][at:at + n]
            at += k
        return mix(out)

    def range_hashes(self, raw, starts, lengths):
        import numpy as np

        if len(raw) > len(self.up):
            self.up, self.down = powers(BASE, len(raw)), powers(UNDO, len(raw))
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.values[raw] * self.up[:len(raw)], dtype=np.uint64)])
        return mix((total[starts + lengths] - total[starts]) * self.down[starts] + lengths.astype(np.uint64))


def pack(ascending) -> bytes:
    """Ascending whole numbers as delta code: planes of bytes, deflated."""
    import zlib

    import numpy as np

    delta = np.diff(ascending.astype(np.uint64), prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes):
    import zlib

    import numpy as np

    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def runs_of(values):
    """(value, start, stop) of each run of equal values."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[:len(values)])
    return [(values[a], int(a), int(b)) for a, b in zip(starts, np.append(starts[1:], len(values)), strict=False)]


class Chunk:
    """The documents of a chunk in ascending order of id, and what can be computed from them again at any time."""

    def __init__(self, table, space: int, n_routes: int):
        import numpy as np

        order = table.column("ord").to_numpy()
        by = np.argsort(order, kind="stable")
        self.ids, self.rank = np.unique(order[by], return_inverse=True)
        texts = table.column("text").to_pylist()
        self.texts = [texts[i].encode() for i in by]
        self.row, self.space, self.n_routes, self.windows = by, space, n_routes, Windows()

    def code(self, anchors):
        """Anchors cut to the hash space, ordered by route and then value."""
        import numpy as np

        h = anchors & np.uint64(self.space - 1)
        route = h % np.uint64(self.n_routes)
        return route * np.uint64(self.space) + h // np.uint64(self.n_routes)

    def codes(self):
        """Code and document of each run of equal anchors in a document."""
        import numpy as np

        codes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, part in self.windows.blocks(self.texts):
            _, owner, anchor, _ = self.windows.of(part)
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            new &= owner >= 0
            codes.append(self.code(anchor[new]))
            docs.append(self.rank[first + owner[new]])
        return np.concatenate(codes), np.concatenate(docs)

    def anchors(self):
        """Distinct anchor codes, ascending, and whether each stands in two documents of the chunk."""
        import numpy as np

        code, doc = self.codes()
        if not len(code):
            return code, np.zeros(0, bool)
        by = np.argsort(code)
        code, doc = code[by], doc[by]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return code[starts], np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)

    def routed(self, codes):
        """(route, start, stop) of each route's part of ascending codes."""
        import numpy as np

        return [(int(r), a, b) for r, a, b in runs_of(codes // np.uint64(self.space))]

    def segments(self, bits: dict[int, bytes]):
        """Blocks of (first text, bytes, start, length, owner, hash, route) of segments of windows with shared anchors."""
        import numpy as np

        codes = np.sort(self.codes()[0])
        codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])[:len(codes)]]
        flags = [np.unpackbits(np.frombuffer(bits[r], np.uint8), count=b - a).astype(bool) for r, a, b in self.routed(codes)]
        shared = codes[np.concatenate(flags)] if flags else codes
        for first, part in self.windows.blocks(self.texts):
            raw, owner, anchor, route = self.windows.of(part, routes=True)
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            runs = np.flatnonzero(new)
            code = self.code(anchor[runs])
            at = np.minimum(np.searchsorted(shared, code), max(0, len(shared) - 1))
            hit = shared[at] == code if len(shared) else np.zeros(len(code), bool)
            candidate = np.repeat(hit, np.diff(np.append(runs, len(anchor)))) & (owner >= 0)
            edge = np.ones(len(anchor), bool)
            edge[1:] = (route[1:] != route[:-1]) | (owner[1:] != owner[:-1]) | (candidate[1:] != candidate[:-1])
            starts = np.flatnonzero(edge)
            counts = np.diff(np.append(starts, len(anchor)))
            keep = candidate[starts] if len(starts) else np.zeros(0, bool)
            starts, counts = starts[keep], counts[keep]
            if len(counts) and counts.max() > SEGMENT:
                pieces = -(-counts // SEGMENT)
                offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                starts = np.repeat(starts, pieces) + offset * SEGMENT
                counts = np.minimum(SEGMENT, np.repeat(counts, pieces) - offset * SEGMENT)
            lengths = counts + WINDOW - 1
            hashes = self.windows.range_hashes(np.frombuffer(raw, np.uint8), starts, lengths) if len(starts) else np.zeros(0, np.uint64)
            yield first, raw, starts, lengths, owner[starts], hashes, (route[starts] % np.uint64(self.n_routes)).astype(np.int64)


def _send_anchors(space, n_routes):
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        chunk = Chunk(table, space, n_routes)
        codes, twice = chunk.anchors()
        parts = chunk.routed(codes)
        return pa.table({
            "route": pa.array([r for r, _, _ in parts], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(parts), pa.int64()),
            "codes": pa.array([pack(codes[a:b] - np.uint64(r * space)) for r, a, b in parts], pa.binary()),
            "twice": pa.array([np.packbits(twice[a:b]).tobytes() for _, a, b in parts], pa.binary())})
    return run


def _shared_anchors(key, table):
    """A bit for each anchor that a chunk sent: whether it stands in two documents."""
    import numpy as np
    import pyarrow as pa

    codes = [unpack(x) for x in table.column("codes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool)
             for x, c in zip(table.column("twice").to_pylist(), codes, strict=True)]
    every = np.concatenate(codes)
    by = np.argsort(every, kind="stable")
    every = every[by]
    same = np.zeros(len(every), bool)
    same[1:] = every[1:] == every[:-1]
    same[:-1] |= same[1:].copy()
    inside = np.concatenate(twice)[by]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    group = np.cumsum(np.concatenate([[0], (every[1:] != every[:-1]).astype(np.int64)]))
    shared = np.empty(len(every), bool)
    shared[by] = same | np.logical_or.reduceat(inside, starts)[group]
    cuts = np.cumsum([0, *map(len, codes)])
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array(["bits"] * len(codes)), "route": table.column("route"),
                     "data": pa.array([np.packbits(shared[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _bits_of(side, kind):
    return {r: d for k, r, d in zip(side.column("kind").to_pylist(), side.column("route").to_pylist(), side.column("data").to_pylist(), strict=True)
            if k == kind}


def _distinct(chunk: Chunk, bits):
    """Segments of a chunk by block, and the order of its distinct ones: (route, hash), ascending."""
    import numpy as np

    blocks = list(chunk.segments(bits))
    hashes = np.concatenate([b[5] for b in blocks] or [np.zeros(0, np.uint64)])
    routes = np.concatenate([b[6] for b in blocks] or [np.zeros(0, np.int64)])
    docs = np.concatenate([chunk.rank[b[0] + b[4]] for b in blocks] or [np.zeros(0, np.int64)])
    by = np.lexsort((docs, hashes, routes))
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (routes[by][1:] != routes[by][:-1])
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    first = by[new]
    return blocks, routes[first], docs[first], first, which, docs


def _send_segments(space, n_routes):
    def run(key, left, right):
        import zlib

        import numpy as np
        import pyarrow as pa

        names = ["route", "chunk", "lengths", "docs", "bytes"]
        rows = {n: [] for n in names}
        if left.num_rows:
            chunk = Chunk(left, space, n_routes)
            blocks, routes, docs, first, _, _ = _distinct(chunk, _bits_of(right, "bits"))
            cuts = np.cumsum([0] + [len(b[2]) for b in blocks])
            block = np.searchsorted(cuts, first, "right") - 1
            inner = first - cuts[block]
            texts = [blocks[b][1][(s := int(blocks[b][2][i])):s + int(blocks[b][3][i])]
                     for b, i in zip(block.tolist(), inner.tolist(), strict=True)]
            for route, a, b in runs_of(routes):
                rows["route"].append(int(route))
                rows["chunk"].append(key[0].as_py())
                rows["lengths"].append(np.array([len(t) for t in texts[a:b]], np.uint8).tobytes())
                rows["docs"].append(zlib.compress(np.ascontiguousarray(chunk.ids[docs[a:b]].view(np.uint8).reshape(-1, 8).T).tobytes(), 1))
                rows["bytes"].append(zlib.compress(b"".join(texts[a:b]), 1))
        return pa.table({"route": pa.array(rows["route"], pa.int64()), "chunk": pa.array(rows["chunk"], pa.int64()),
                         **{n: pa.array(rows[n], pa.binary()) for n in names[2:]}})
    return run


def marked(segments: list[bytes], docs, anchors):
    """Windows (bits) of distinct segments that stand in a segment of an earlier document.

    Only segments with the same route anchor can have a window in common.
    """
    import numpy as np

    marks = np.zeros(len(segments), np.uint64)
    sizes = np.array([len(s) - WINDOW + 1 for s in segments], np.uint64)
    full = np.where(sizes >= 64, ~np.uint64(0), (np.uint64(1) << (sizes % np.uint64(64))) - np.uint64(1))
    left = np.lexsort((docs, anchors))
    for _ in range(ROUNDS):
        left = _crowded(left, anchors)
        if not len(left):
            return marks
        lead = np.ones(len(left), bool)
        lead[1:] = anchors[left][1:] != anchors[left][:-1]
        leads, rest = left[lead], left[~lead]
        group = (np.cumsum(lead) - 1)[~lead]
        later = docs[rest] > docs[leads][group]
        size = np.cumsum([len(segments[i]) for i in leads])
        for batch in range(int(size[-1]) // INDEXED + 1):
            mine = size // INDEXED == batch
            own = np.flatnonzero(mine[group] & later)
            if len(own):
                index = RunLengthIndex([segments[i] for i in leads[mine]])
                marks[rest[own]] |= index.matching([segments[i] for i in rest[own]], WINDOW)
        left = rest[marks[rest] != full[rest]]
    for i, bits in _by_window(segments, docs, _crowded(left, anchors)):
        marks[i] |= np.uint64(bits)
    return marks


def _crowded(left, anchors):
    """Those of ``left`` (sorted by anchor) that share their anchor with another."""
    import numpy as np

    a = anchors[left]
    same = a[1:] == a[:-1]
    return left[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(left) else left


def _by_window(segments, docs, left):
    """(segment, marks) found by the first document of each distinct window."""
    import numpy as np

    if not len(left):
        return
    own = [segments[i] for i in left]
    raw = np.frombuffer(b"".join(own), np.uint8)
    sizes = np.fromiter(map(len, own), np.int64, len(own)) - WINDOW + 1
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(own)), sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    at = np.repeat(np.cumsum(sizes + WINDOW - 1) - sizes - WINDOW + 1, sizes) + place
    value, doc = Windows().whole(raw)[at], np.asarray(docs)[left][owner]
    by = np.argsort(value)
    starts = np.flatnonzero(np.concatenate([[True], value[by][1:] != value[by][:-1]]))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(by))))
    if _alike(raw, at[by], at[by[starts]][group]):
        earlier = np.empty(len(by), bool)
        earlier[by] = np.minimum.reduceat(doc[by], starts)[group] < doc[by]
    else:
        first: dict[bytes, int] = {}
        windows = [raw[a:a + WINDOW].tobytes() for a in at.tolist()]
        for w, d in zip(windows, doc.tolist(), strict=True):
            first[w] = min(d, first.get(w, d))
        earlier = np.array([first[w] < d for w, d in zip(windows, doc.tolist(), strict=True)])
    yield from zip(left, np.bitwise_or.reduceat(earlier.astype(np.uint64) << place.astype(np.uint64), ends - sizes), strict=True)


def _alike(raw, a, b) -> bool:
    """Whether the windows from ``a`` equal those from ``b`` byte by byte."""
    import numpy as np

    windows, block = np.lib.stride_tricks.sliding_window_view(raw, WINDOW), 1 << 18
    other = np.flatnonzero(a != b)
    return all(np.array_equal(windows[a[o]], windows[b[o]]) for o in (other[i:i + block] for i in range(0, len(other), block)))


def _mark_segments(key, table):
    """For each segment that a chunk sent: all bits if an earlier document has it, else the marks of its windows."""
    import zlib

    import numpy as np
    import pyarrow as pa

    texts, docs, counts = [], [], []
    for lengths, d, data in zip(*(table.column(c).to_pylist() for c in ("lengths", "docs", "bytes")), strict=True):
        lengths, data = np.frombuffer(lengths, np.uint8).astype(np.int64), zlib.decompress(data)
        stops = np.cumsum(lengths).tolist()
        texts += [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        docs.append(np.ascontiguousarray(np.frombuffer(zlib.decompress(d), np.uint8).reshape(8, -1).T).view(np.int64).ravel())
        counts.append(len(lengths))
    docs = np.concatenate(docs)
    place: dict[bytes, int] = {}
    which = np.fromiter((place.setdefault(t, len(place)) for t in texts), np.int64, len(texts))
    first = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(first, which, docs)
    distinct = list(place)
    marks = marked(distinct, first, Windows().first_routes(distinct))[which]
    marks[docs > first[which]] = ~np.uint64(0)
    cuts = np.cumsum([0, *counts])
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array(["marks"] * len(counts)), "route": table.column("route"),
                     "data": pa.array([zlib.compress(marks[a:b].tobytes(), 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _remove(space, n_routes):
    def run(key, left, right):
        import zlib
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        n = left.num_rows
        removed, spans, digest, kept = [0] * n, [0] * n, [""] * n, [[]] * n
        if n:
            chunk = Chunk(left, space, n_routes)
            blocks, routes, firsts, _, which, docs = _distinct(chunk, _bits_of(right, "bits"))
            sent = _bits_of(right, "marks")
            marks = np.concatenate([np.frombuffer(zlib.decompress(sent[int(r)]), np.uint64) for r in np.unique(routes)]
                                   or [np.zeros(0, np.uint64)])[which]
            marks[docs > firsts[which]] = ~np.uint64(0)
            done, at = 0, 0
            for first, raw, starts, lengths, _, _, _ in blocks:
                own = marks[at:at + len(starts)]
                at += len(starts)
                change = np.zeros(len(raw) + 1, np.int64)
                counts = lengths - WINDOW + 1
                for bit in range(int(counts.max()) if len(counts) else 0):
                    hit = starts[((own >> np.uint64(bit)) & np.uint64(1)).astype(bool) & (bit < counts)] + bit
                    change[hit] += 1  # a window belongs to one segment, so no place repeats here
                    change[hit + WINDOW] -= 1
                gone = np.cumsum(change[:-1]) > 0
                place = 0
                while place < len(raw) or (done < len(chunk.texts) and not len(chunk.texts[done])):
                    text = chunk.texts[done]
                    g = gone[place:place + len(text)]
                    row = int(chunk.row[done])
                    edge = np.flatnonzero(np.diff(g.view(np.int8), prepend=0, append=0))
                    removed[row], spans[row] = int(g.sum()), len(edge) // 2
                    kept[row] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    digest[row] = sha256(np.frombuffer(text, np.uint8)[~g].tobytes()).hexdigest()
                    place += len(text)
                    done += 1
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in left.column("text").to_pylist()], pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                         "kept_sha256": pa.array(digest, pa.string()), "removed": pa.array(kept, span)})
    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``removed``, the byte ranges that go.

    A byte goes if it is covered by a 50-byte string that also starts in a document with a smaller id. Texts are UTF-8
    bytes; a null text is empty. Strings are judged on the input and never cross documents. Rows with the same id are not
    earlier than one another; a null id is later than all others. Texts under 50 bytes stay. Other columns are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    last = (1 << 63) - 1
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_chunks = max(partitions(spark), math.ceil(total / CHUNK))
    n_routes = 2 * partitions(spark)
    space = 1 << max(24, (total * 2 // (WINDOW - ANCHOR + 2) * 64).bit_length())
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).cast("long").alias("chunk"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("ord"), "doc_id", "text")
    reply = "chunk long, kind string, route long, data binary"
    bits = (dealt.groupBy("chunk").applyInArrow(_send_anchors(space, n_routes), "route long, chunk long, codes binary, twice binary")
            .groupBy("route").applyInArrow(_shared_anchors, reply))
    marks = (dealt.groupBy("chunk").cogroup(bits.groupBy("chunk"))
             .applyInArrow(_send_segments(space, n_routes), "route long, chunk long, lengths binary, docs binary, bytes binary")
             .groupBy("route").applyInArrow(_mark_segments, reply))
    return (dealt.groupBy("chunk").cogroup(bits.unionByName(marks).groupBy("chunk"))
            .applyInArrow(_remove(space, n_routes), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                          "removed array<struct<start:bigint,end:bigint>>"))
