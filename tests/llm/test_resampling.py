import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tidemark.llm import resampling as rs
from tidemark.llm.crc import RunningCrc


def _features(text, width):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(plain.UP))
    return [" ".join(w[i:i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)], len(w)


def _plain(docs, target, width, buckets, percent, least, seed):
    code = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for count, rows in ((s, docs), (t, target)):
        for _, text in rows:
            for g in _features(text, width)[0]:
                count[code(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = {}
    for d, text in docs:
        f, n = _features(text, width)
        weight = sum(gain[code(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least]
    fit = sorted((d for d in out if out[d][3]), key=lambda d: (-out[d][2], d))
    rank = {d: i + 1 for i, d in enumerate(fit[:percent * len(fit) // 100])}
    return {d: (*v[:3], rank.get(d)) for d, v in out.items()}


def test_crc_of_every_run():
    draw = random.Random(4)
    for n in (0, 1, 31, 32, 33, 1023, 1024, 1057, 40_000):
        raw = draw.randbytes(n)
        at = sorted([draw.randint(0, n) for _ in range(200)])
        low, high = np.array(at[::2]), np.array(at[1::2])
        got = RunningCrc(np.frombuffer(raw, np.uint8)).of(low, high).tolist()
        assert got == [zlib.crc32(raw[i:j]) for i, j in zip(low, high, strict=True)]


def test_features_stay_inside_their_text():
    texts = ["Hello wörld, 12 the-end", "", "a b", "中文 字x Y 😀", "...", "solo", "x" * 5000 + " " + "é" * 3000]
    for width in (1, 2, 3):
        codes, of, n = rs.features([t.encode() for t in texts], width, 997)
        want = sorted((i, zlib.crc32(g.encode()) % 997) for i, t in enumerate(texts) for g in _features(t, width)[0])
        assert sorted(zip(of.tolist(), codes.tolist(), strict=True)) == want and n.tolist() == [_features(t, 1)[1] for t in texts]


@pytest.mark.parametrize(("width", "percent"), [(1, 10), (2, 35), (1, 100), (1, 0)])
def test_draw_equals_a_plain_one(spark, width, percent, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK", 500)
    draw = random.Random(width)
    docs = [(7 * i, t) for i, t in enumerate(plain.sentences(2, 150, 30) + plain.sentences(3, 40, 10))] + [(-1, None), (-2, ""), (-3, "!?")]
    docs += [(5000 + i, docs[0][1]) for i in range(40)]
    draw.shuffle(docs)
    target = list(enumerate(plain.sentences(9, 10, 30, 40))) + [(99, None)]
    schema = "doc_id long, text string"
    args = width, 500, percent, 20, 11
    found = rs.importance_scores(spark.createDataFrame(docs, schema).repartition(5), spark.createDataFrame(target, schema), *args).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in found} == _plain(docs, target, *args)


def test_odd_rows(spark):
    odd = plain.odd(spark).withColumn("rank", F.lit("r")).withColumn("score", F.lit(0)).withColumn("above", F.lit(1)).withColumn("bucket", F.lit("b"))
    target = odd.limit(3)
    got = rs.importance_scores(odd, target, percent=50, least_words=2).collect()
    fit = [r for r in got if r.n_features >= 2]
    assert len(got) == len(plain.odd_rows()) and sorted(r.rank for r in got if r.rank) == list(range(1, len(fit) // 2 + 1))
    assert all(r.weight == 0 and r.rank is None for r in got if r.n_features == 0)
    rows = rs.resample(odd, target, percent=50, least_words=2)
    assert rows.columns == odd.columns and rows.count() == len(fit) // 2
    assert rs.importance_scores(plain.empty(spark), target).count() == 0 == rs.resample(plain.empty(spark), target).count()
    assert rs.importance_scores(odd, plain.empty(spark)).count() == len(plain.odd_rows())
    assert rs.resample(odd, target, percent=100, least_words=0).count() == len(plain.odd_rows())
