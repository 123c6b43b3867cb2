"""Registered queries of these operators over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate, fingerprints, language, licenses, mixing, near_duplicates, resampling, secrets, signature_tree,
    substrings, token_counts, url_filter, vector_codes,
)
from tidemark.llm.common import table
from tidemark.llm.sql import CODES_SQL, CONTAINMENT_SQL, MIXTURE_SQL, RESAMPLING_SQL, URL_SQL, component_sql

#: The rules that pages are judged by (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _of_kind(kind: str):
    return lambda s: s.kind == kind


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = W.partitionBy("range_no").orderBy("is_copy", "doc_id", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.char_length("text") - half), F.left("next_text", half))

    def marked(rows: DataFrame, is_own) -> DataFrame:
        return (rows.withColumn("edited", edited).withColumn("f", fingerprints.packed_fingerprint(F.col("text")))
                .withColumn("g", F.when(is_own, fingerprints.packed_fingerprint(F.col("edited")))))

    pairs = (marked(fingerprints.ranges_with_next(docs).withColumn("next_text", F.coalesce(F.lead("text").over(ordered), F.lit(""))), ~F.col("is_copy"))
             .withColumn("next_f", F.lead("f").over(ordered)).where(~F.col("is_copy")).drop("range_no", "is_copy"))
    # A row without an id follows nothing and has no next document: the end of its edited text is dropped.
    alone = marked(docs.where("doc_id is null").withColumn("next_text", F.lit("")), F.lit(True)).withColumn("next_f", F.lit(None).cast("array<bigint>"))
    return pairs.unionByName(alone).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_hex(F.col("f")).alias("fingerprint"), fingerprints.as_hex(F.col("g")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("f"), F.col("g")).alias("near_edited"),
        fingerprints.likeness(F.col("f"), F.col("next_f")).alias("near_next"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_plan(docs, mixing.ranked_weights(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("license_hits", lambda h: h.base)
    labels = F.array_join(F.sort_array(F.array_distinct(F.transform("license_hits", lambda h: h.label))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h.start)).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h.start)).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(F.transform(base, lambda h: h.label))), ",").alias("base_labels"),
        labels.alias("labels"),
        F.coalesce(F.array_max(F.transform("license_hits", lambda h: h.score)), F.lit(0.0)).alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    pieces = vocabulary("piece_bpe_32k.model")
    model = language.fit(docs.where(~held_out), pieces)
    return language.predict_language(docs, model, pieces).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES if r.base]
    of_base = F.filter("secret_spans", lambda s: s.kind.isin(*base))
    counts = [F.size(F.filter("secret_spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(of_base), 256).alias("base_sha256"),
                        secrets.listed(F.col("secret_spans")).alias("spans"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.similar_documents(table(spark, sf_dir, "documents"), width=3, percent=90).select(
        "doc_id", "n_shingles", "component_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return vector_codes.with_label_error(coded).select(
        "vec_id", vector_codes.code_text(F.col("codes")).alias("code"), "error", "label_error",
        F.lit(books.digest).alias("codebooks_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=1, buckets=10_000, percent=10,
        least_words=20, seed=2024)


QUERIES = [
    op1_benchmark_decontamination, op2_document_fingerprints, op3_suffix_array_dedup, op4_source_mixing,
    op5_license_scan, op6_language_id, op7_near_duplicates, op8_secret_scan, op9_url_filter, op10_token_counts,
    op11_ngram_jaccard_join, op12_vector_codes, op13_importance_resampling,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": CONTAINMENT_SQL, "op4_source_mixing": MIXTURE_SQL, "op9_url_filter": URL_SQL,
            "op7_near_duplicates": component_sql(2, 80, kept=True), "op11_ngram_jaccard_join": component_sql(3, 90),
            "op12_vector_codes": CODES_SQL, "op13_importance_resampling": RESAMPLING_SQL}
