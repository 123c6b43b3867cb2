"""URL filters: hashed host-suffix and path-prefix expressions joined to a rule list.

A rule is a host and a path. It fits a URL whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path. The longest fitting rule decides; of equally long ones the longer host, then block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import folded, lower_ascii, quoted, unfolded

#: Length in hex digits of the part of a digest that is joined on; the rest is compared afterwards.
PREFIX = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if null or malformed."""
    return lower_ascii(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _expressions(rules: DataFrame) -> tuple[Column, DataFrame]:
    """The expression shapes (labels of the host, characters of the path) that rules have, and hashed rules.

    A host has at most 127 labels and a URL some thousand characters, so the shapes stay few however long the
    list of rules is.
    """
    hashed = (rules.where("rule_host is not null and rule_path is not null and rule_host != ''")
              .withColumn("rule", F.concat("rule_host", "rule_path"))
              .withColumn("digest", F.sha2("rule", 256))
              .select(F.substring("digest", 1, PREFIX).alias("prefix"), F.col("digest").alias("rule_digest"),
                      "rule", "rule_host", "verdict"))
    shapes = rules.where("rule_host is not null and rule_path is not null and rule_host != ''").select(
        F.size(F.split("rule_host", r"\.")).alias("labels"), F.char_length("rule_path").alias("chars")).distinct()
    literal = [F.struct(F.lit(r.labels).alias("labels"), F.lit(r.chars).alias("chars")) for r in shapes.collect()]
    none = F.expr("cast(array() as array<struct<labels:int,chars:int>>)")
    return (F.array(*literal) if literal else none), hashed


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               without_host: str = "block") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``urls``.

    Null and malformed URLs (no ``://``) have an empty host and path, fit no rule and get ``without_host``;
    other URLs without a rule get ``default``. Repeated URLs are expanded and joined once. Columns of the input
    that are called host, path, rule or verdict are replaced. An empty list of rules fits nothing.
    """
    shapes, hashed = _expressions(rules)
    new = ("host", "path", "rule", "verdict")
    parsed = urls.select(folded(urls, new), host_of(quoted(url)).alias("host"), path_of(quoted(url)).alias("path"))
    exprs = (parsed.select("host", "path").where("host != ''").distinct()
             .withColumn("labels", F.size(F.split("host", r"\.")))
             .withColumn("shape", F.explode(F.filter(
                 shapes, lambda s: (s.labels <= F.col("labels")) & (s.chars <= F.char_length("path")))))
             .withColumn("digest", F.sha2(F.concat(
                 F.expr("substring_index(host, '.', -shape.labels)"), F.expr("left(path, shape.chars)")), 256))
             .select("host", "path", "digest", F.substring("digest", 1, PREFIX).alias("prefix")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(
        F.char_length("rule"), F.char_length("rule_host"), F.col("verdict") == "block", "rule"))
    found = (exprs.join(hashed, "prefix").where("digest = rule_digest").groupBy("host", "path").agg(best.alias("best")))
    return (parsed.join(found, ["host", "path"], "left")
            .select(*unfolded(urls, new), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.when(F.col("host") == "", without_host).otherwise(default))
                    .alias("verdict")))
