import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks import compare
from tests.llm import plain
from tidemark.llm import mixing, secrets
from tidemark.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    note, ok = compare.compare(spark, compare.duck(SF), SF, q.queries()[name], q.oracle_sql()[name])
    assert ok, note


def test_each_stage_takes_effect(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = plain.sentences(1, 12, 60)
    texts = [t.replace("t", "word") for t in texts]
    rows = [(i, t, "en", "ab"[i % 2], len(t), "extra") for i, t in enumerate(texts)]
    rows += [(20, texts[0], "en", "a", 1, "x"), (21, texts[1] + " more", "en", "b", 1, "x"), (22, "123 456", "en", "a", 7, "x"), (23, None, None, None, None, None),
             (24, texts[2] + " " + item, "en", "a", 1, "x"), (25, "unlike all others here: token = abcdefghijkl0 " + plain.sentences(5, 1)[0].replace("t", "n"), "en", "b", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rule string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert n == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["language_id"]) == {r[0] for r in rows} - {22, 23}
    near = plain.components([(r[0], r[1]) for r in rows if r[0] not in (22, 23)], 5, 80)
    assert set(seen["near_dedup"]) == {i for i, c in near.items() if i == c} and 21 not in seen["near_dedup"]
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {24}
    masked = seen["secret_scan"][25]
    assert "abcdefghijkl0" not in masked.text and masked.n_chars == len(masked.text)
    assert all(secrets.find_spans(r.text, secrets.RULES) == [] for r in seen["secret_scan"].values())
    assert set(seen["source_mixing"]) <= set(seen["secret_scan"]) and {"mix_copy", "mix_words"} < set(docs.columns)
    before = spark.read.parquet(f"{tmp_path}/3")
    words = {r.doc_id: r.taken for r in mixing.mix_plan(before, mixing.ranked_weights(before)).collect()}
    taken = {}
    for r in docs.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.mix_words
    assert taken == {i: n for i, n in words.items() if n}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
