"""Operators made of DataFrame functions alone: decontamination, fingerprints, mixing, URL filters."""

import hashlib

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.llm import plain
from tidemark.llm import decontaminate, fingerprints, mixing, url_filter
from tidemark.llm import queries as q

ITEMS = "item_id long, text string"


def test_no_operator_runs_python(spark):
    docs, items = plain.odd(spark), spark.createDataFrame([(1, "one two three four five six")], ITEMS)
    urls = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    for df in (decontaminate.decontaminate(docs, items), fingerprints.fingerprints(docs), mixing.mixed(docs, mixing.ranked_weights(docs)),
               url_filter.judge_urls(urls, url_filter.rule_table(spark, q.URL_RULES))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def _contained(docs, items, t=0.8):
    def words(text):
        return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()

    out = {}
    for i, text in items:
        w = words(text)
        n = min(5, len(w))
        own = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, doc in docs:
            x = words(doc)
            has = len(own & {tuple(x[k:k + n]) for k in range(len(x) - n + 1)}) if own else 0
            if own and has + 1e-9 >= t * len(own):
                out[d, i] = has, len(own)
    return out


def test_items_are_found_in_documents_of_any_length(spark):
    items = list(enumerate(plain.sentences(3, 25, 30))) + [(50, "short one"), (51, "Solo"), (52, ""), (53, None)]
    filler = plain.sentences(4, 12, 900)
    docs = []
    for d, text in enumerate(filler):
        w = text.split()
        w[100:100] = items[d][1].split()
        if d % 3:  # changed words: some stay above the limit
            for k in range(d % 3):
                w[110 + 9 * k] = "changed"
        docs.append((d, " ".join(w).upper().replace(" ", ", ") + (" short\none solo" if d == 5 else "")))
    df = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in df.collect()}
    assert got == _contained(docs, items)
    assert {(5, 50), (5, 51)} <= set(got) and len(got) > 6


def test_sketches_are_small_and_lose_nothing(spark):
    rows = decontaminate.item_sketches(spark.createDataFrame(list(enumerate(plain.sentences(3, 5, 64))), ITEMS), 5, 0.8).collect()
    assert {r.n_item for r in rows} == {60} and sum(r.in_sketch for r in rows) == 5 * 13 and {r.need for r in rows} == {1}


def test_only_pairs_of_the_sketch_are_verified(spark, monkeypatch):
    """Items that share most shingles with many documents become no candidates unless their minima are there."""
    shared, *rest = plain.sentences(6, 13, 20)
    items = spark.createDataFrame([(i, shared + " " + t) for i, t in enumerate(rest)], ITEMS)  # one passage in all items
    docs = spark.createDataFrame([(100 + i, shared) for i in range(30)] + [(1, shared + " " + rest[1])], "doc_id long, text string")
    sketches = decontaminate.settle(decontaminate.item_sketches(items, 5, 0.8))
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.candidate_pairs(docs, sketches).collect()}
    assert (1, 1) in pairs and len(pairs) < 31 * 12
    asked = []
    search = decontaminate.candidate_pairs
    monkeypatch.setattr(decontaminate, "candidate_pairs", lambda d, s: asked.append(1) or search(d, s).where("item_id != 1"))
    assert decontaminate.contained_items(docs, items).count() == 0 and asked


def test_copies_of_an_id_and_hot_ids_are_searched_in_parts(spark):
    one = plain.sentences(8, 1, 40)[0]
    items = spark.createDataFrame([(None, one)], ITEMS)
    docs = [(None, " ".join(one.split()[k:k + 9])) for k in range(0, 36, 4)] + [(None, "nothing here to see at all")] * 50 + [(1, one[:60])]
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got] == [(None, None, 36, 36)]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    items, docs = spark.createDataFrame(list(enumerate(plain.sentences(3, 5, 30))), ITEMS), list(enumerate(plain.sentences(3, 9, 30)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(decontaminate.contained_items(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(decontaminate.contained_items(docs, items).collect()) == want and len(want) == 5


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over"), (None, "negative id")], ITEMS)
    left = decontaminate.decontaminate(plain.odd(spark), items)
    assert left.columns == plain.odd(spark).columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7, 8, 9, 10, 10, 11]
    assert decontaminate.decontaminate(plain.empty(spark), items).count() == 0
    assert decontaminate.decontaminate(plain.odd(spark), items.where("false")).count() == len(plain.odd_rows())


def test_leaks_are_judged_row_by_row(spark):
    one, two, three = plain.sentences(9, 3, 20)
    half = one.split()
    docs = [(None, one, 0), (None, three, 1), (None, None, 2), (5, "x " + two, 3), (5, three, 4), (6, " ".join(half[:12]), 5),
            (6, " ".join(half[8:]), 6), (7, two + " " + one, 7)]
    for ids in ((1, 1), (None, None), (1, 2)):
        items = spark.createDataFrame(list(zip(ids, (one, two), strict=True)), ITEMS)
        left = decontaminate.without_leaks(spark.createDataFrame(docs, "doc_id long, text string, row_key long").repartition(3), items)
        assert left.columns == ["doc_id", "text", "row_key"]
        assert sorted(r.row_key for r in left.collect()) == [1, 2, 4, 5, 6]
    empty = decontaminate.without_leaks(plain.empty(spark), items)
    assert empty.columns == plain.odd(spark).columns and empty.count() == 0


def test_fingerprints_of_equal_and_odd_texts(spark):
    rows = fingerprints.fingerprints(plain.odd(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert by[""] == by["   \n\t "] == {""} and len(next(iter(by[plain.LONG]))) == 128
    assert fingerprints.fingerprints(plain.empty(spark)).count() == 0


def test_likeness_follows_similarity(spark):
    rows = []
    for i, (a, b) in enumerate(zip(plain.sentences(1, 40, 300, 10**6), plain.sentences(2, 40, 300, 10**6), strict=True)):
        a, b = a.split(), b.split()
        rows.append((i, " ".join(a), " ".join(a[:i * 7] + b[i * 7:])))
    f = fingerprints.packed_fingerprint
    pairs = spark.createDataFrame(rows, "i long, a string, b string").select("i", f(F.col("a")).alias("x"), f(F.col("b")).alias("y"))
    got = pairs.select("i", fingerprints.likeness(F.col("x"), F.col("y")).alias("near"))
    errors = []
    for r in got.collect():
        a, b = (plain.shingles(t, 5) for t in rows[r.i][1:])
        errors.append(abs(r.near - len(a & b) / len(a | b)))
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.2


def test_short_texts_agree_by_chance_bin_by_bin(spark):
    """A text of one shingle fills all bins with copies of one value; unrelated texts still agree in 1 of 16 only."""
    f = fingerprints.packed_fingerprint
    pairs = spark.createDataFrame([(f"a{i} b{i} c{i} d{i} e{i}", f"v{i} w{i} x{i} y{i} z{i}") for i in range(300)], "a string, b string")
    near = [r.near for r in pairs.select(fingerprints.likeness(f(F.col("a")), f(F.col("b"))).alias("near")).collect()]
    assert max(near) < 0.15 and sum(near) / len(near) < 0.03


def test_next_row_is_found_across_ranges(spark):
    ids = [-3000, -1, 0, 5, 255, 256, 257, 70_000, 10**12, 10**12 + 1, 9 * 10**15]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(3)
    rows = fingerprints.ranges_with_next(df).withColumn(
        "n", F.lead("doc_id").over(W.partitionBy("range_no").orderBy("is_copy", "doc_id", "text"))).where("not is_copy").collect()
    assert {r.doc_id: r.n for r in rows} == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_fingerprint_query(spark, tmp_path):
    docs = [(3, "one two three four five six"), (9, None), (4, "seven eight nine ten eleven twelve"), (700, "é ü ö")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in q.op2_document_fingerprints(spark, str(tmp_path)).collect()}
    texts = dict(docs)
    for i, n in ((3, 4), (4, 9), (9, 700), (700, 3)):
        t, after = texts[i] or "", texts[n] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert got[9].fingerprint == "" and got[9].near_edited == 1.0 and got[4].near_next == 0.0


def test_targets_by_repeated_redistribution(spark):
    sizes = {"a": 100, "b": 5, "c": 400, None: 20, "d": 1}
    docs = [(i, "w " * n, s) for i, (s, n) in enumerate((s, n) for s, total in sizes.items() for n in ([total] if total < 10 else [total // 10] * 10))]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix_plan(df, mixing.ranked_weights(df)).collect()
    order = ["a", "b", "c", "d", None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, list(order)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    source = {d: s for d, _, s in docs}
    taken = dict.fromkeys(order, 0)
    for r in rows:
        assert r.target == pytest.approx(target[source[r.doc_id]], abs=1e-5) and r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)


def test_mixing_odd_rows_is_whole_and_repeatable(spark):
    df = plain.odd(spark)
    one, two = (sorted(mixing.mix_plan(df.repartition(n), mixing.ranked_weights(df)).collect(), key=str) for n in (1, 5))
    assert one == two and len(one) == len(plain.odd_rows())
    assert all(r.taken == 0 for r in one if r.size == 0)
    mix = mixing.mixed(df, mixing.ranked_weights(df))
    assert mix.columns == [*df.columns, "mix_copy", "mix_words"]
    words = {}
    for r in mix.collect():
        words[r.source] = words.get(r.source, 0) + r.mix_words
    plan = {}
    for r in mixing.mix_plan(df, mixing.ranked_weights(df)).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    assert abs(sum(words.values()) - sum(plan.values())) <= len(one)
    empty = plain.empty(spark)
    assert mixing.mix_plan(empty, mixing.ranked_weights(empty)).count() == 0


def test_urls_by_rule(spark):
    urls = ["http://a.example.org/es/1", "http://EXAMPLE.org/en/12?x", "http://example.org", "http://org/", "https://notexample.org/en/1",
            "ftp://x.com/fr/a#b", "http://x.com/de/", "http://x.com/dea", "no url", None, "", "://", "http:///path", "http://a.b/c://d.org/",
            "http://" + "x." * 200 + "org/" + "y" * 5000]
    rows = [(i, u, "old") for i, u in enumerate(urls)] + [(0, urls[0], "old"), (None, urls[6], "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = url_filter.judge_urls(df, url_filter.rule_table(spark, q.URL_RULES)).collect()
    assert len(got) == len(rows)

    def want(url):
        at = (url or "").find("://")
        rest = url[at + 3:] if at >= 0 else ""
        host = rest[:min([len(rest)] + [rest.find(c) for c in "/?#" if c in rest])]
        path = rest[len(host):]
        path = path[:min([len(path)] + [path.find(c) for c in "?#" if c in path])]
        host = host.translate(plain.UP)
        fit = [(len(h + p), h + p, v) for v, h, p in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow" if host else "block")))

    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want(r.url)
    assert url_filter.judge_urls(df.where("false"), url_filter.rule_table(spark, q.URL_RULES)).count() == 0
    none = url_filter.judge_urls(df, url_filter.rule_table(spark, [])).collect()
    assert {r.rule for r in none} == {None}
