"""Secret scans: Boolean trigram queries from each rule's regular expression, over an inverted trigram index.

The index has, for every trigram that some query uses and every shard of the documents, the sorted ids of the
documents holding it. A rule's query is intersected and united per shard; only documents that it leaves are searched
for the rule. Rules without mandatory trigrams are searched for in every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of_texts, folded, partitions


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; shorter matches are dropped but still consume text."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules in their listed order, then the further rules of this scanner (public token formats).
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: Alternative strings that a query keeps apart before it stops extending them.
MOST_STRINGS = 64

Query = list[list[frozenset[str]]]  # all of (any of (all of trigrams))


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _any_of(strings: set[str]) -> Query:
    """Query for texts that hold one of the strings; empty (no demand) if one of them has no trigram."""
    options = {_trigrams(s.lower()) for s in strings}
    if not options or frozenset() in options:
        return []
    return [sorted((o for o in options if not any(p < o for p in options)), key=sorted)]


def trigram_query(pattern: str) -> Query:
    """What lower-cased text must hold to match: a conjunction of disjunctions of trigram sets."""
    from re import _constants as op
    from re import _parser

    def strings_of(node) -> set[str] | None:
        """All strings that a node can match, if they are few."""
        kind, arg = node
        if kind is op.LITERAL:
            return {chr(arg).lower()}
        if kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}
        if kind is op.SUBPATTERN:
            return strings_of_all(arg[-1])
        if kind is op.BRANCH:
            parts = [strings_of_all(p) for p in arg[1]]
            return None if None in parts else set().union(*parts)
        if kind is op.MAX_REPEAT and arg[1] == 1:
            one = strings_of_all(arg[2])
            return None if one is None else one | ({""} if arg[0] == 0 else set())
        return None

    def strings_of_all(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            part = strings_of(node)
            if part is None or len(out) * len(part) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in part}
        return out

    def demand(nodes) -> Query:
        query: Query = []
        run = {""}
        for node in nodes:
            part = strings_of(node)
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a in run for b in part}
                continue
            query += _any_of(run)
            run = {""} if part is None else part
            if part is None:
                kind, arg = node
                if kind is op.SUBPATTERN:
                    query += demand(arg[-1])
                elif kind is op.MAX_REPEAT and arg[0] >= 1:
                    once = strings_of_all(arg[2])
                    query += demand(arg[2]) if once is None else _any_of({s * min(arg[0], 8) for s in once})
                elif kind is op.BRANCH:
                    parts = [demand(p) for p in arg[1]]
                    if all(len(p) == 1 for p in parts):
                        query.append([s for p in parts for s in p[0]])
        return query + _any_of(run)

    return demand(_parser.parse(pattern))


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (shard, trigram, ids) of the listed trigrams over all documents; ASCII letters count in lower case."""
    table = sorted(t.encode() for t in trigrams)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known = np.zeros(1 << 24, bool)
        for t in table:
            known[t[0] << 16 | t[1] << 8 | t[2]] = True
        for batch, texts in batches_of_texts(batches, 1):
            at, found = [], []
            for i, text in enumerate(texts):
                b = np.frombuffer(text.encode().lower(), np.uint8)
                if len(b) < 3:
                    continue
                code = b[:-2].astype(np.uint32) << np.uint32(16)
                code |= b[1:-1].astype(np.uint32) << np.uint32(8)
                code |= b[2:]
                hits = np.unique(code[known[code]])
                at += [i] * len(hits)
                found += [int(c).to_bytes(3, "big").decode() for c in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())],
                                             names=["doc_id", "trigram"])

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(4 * partitions(docs.sparkSession)))
    return (docs.select("doc_id", "text").where("doc_id is not null and text is not null")
            .mapInArrow(run, f"doc_id {kind}, trigram string").groupBy(shard.alias("shard"), "trigram")
            .agg(F.sort_array(F.collect_set("doc_id")).alias("ids")))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): the rules with mandatory trigrams whose query the document meets."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for options in q for o in options for t in o})
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = trigram_index(docs, trigrams).groupBy("shard").agg(
        F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings"))

    def ids(trigram: str) -> Column:
        return F.coalesce(F.element_at("postings", F.lit(trigram)), F.expr(f"cast(array() as array<{kind}>)"))

    def fold(parts: list[Column], how) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = how(out, p)
        return out

    def meets(q: Query) -> Column:
        return fold([fold([fold([ids(t) for t in sorted(o)], F.array_intersect) for o in options], F.array_union)
                     for options in q], F.array_intersect)

    lists = F.array(*(F.struct(F.lit(k).alias("rule"), meets(q).alias("ids")) for k, q in queries.items()))
    return (index.select(F.explode(lists).alias("c")).select("c.rule", F.explode("c.ids").alias("doc_id"))
            .groupBy("doc_id").agg(F.collect_set("rule").alias("rules")))


def find_spans(text: str, rules) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the rules' secrets in one text, by start and then by the order of the rules."""
    found = []
    for n, rule in enumerate(rules):
        pattern = rule.pattern
        if rule.group == 0 and pattern.endswith("]+") and pattern.count("[") == 1 and pattern.startswith("["):
            pattern = f"{pattern[:-1]}{{{rule.least},}}"  # whole runs of one class: no shorter match can hide a longer one
        for m in re.compile(pattern, re.ASCII).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), n, rule.kind, m.end()))
    return [(s, kind, e) for s, _, kind, e in sorted(found)]


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """Add ``secret_spans`` (array of start, kind, end in code points, end exclusive) to every row of ``docs``.

    Rows come back in any order with all their columns; a column of that name is replaced. Null texts count as empty
    and have no spans. Rows with a null id are not in the index and are searched for every rule; rows that repeat an
    id share the postings of that id and are each searched in their own text, so nothing is lost. Spans of
    different rules may overlap.
    """
    @F.pandas_udf("array<struct<start:bigint,kind:string,end:bigint>>")
    def spans(text, kinds):
        import pandas as pd

        return pd.Series([[{"start": s, "kind": k, "end": e} for s, k, e in _spans_of(t, ks, rules)] for t, ks in zip(text, kinds, strict=True)])

    rows = _scanned(docs, rules, ("secret_spans",))
    found = spans(F.when(F.size("todo") > 0, F.col("text")), "todo")
    return rows.select(*[_column(c) for c in docs.columns if c != "secret_spans"], found.alias("secret_spans"))


#: Columns that stand beside the folded ones, so that a text travels once.
BESIDE = ("doc_id", "text")


def _column(name: str) -> Column:
    """A column of the table that ``_scanned`` was given."""
    return (F.col(name) if name in BESIDE else F.col("kept").getField(name)).alias(name)


def _spans_of(text: str | None, kinds, rules) -> list[tuple[int, str, int]]:
    """Spans of the rules named by ``kinds`` in one text; none in a null one."""
    kinds = () if kinds is None else set(kinds)
    return find_spans(text, wanted) if text and (wanted := [r for r in rules if r.kind in kinds]) else []


def _scanned(docs: DataFrame, rules, without: tuple[str, ...] = ()) -> DataFrame:
    """Id, text, the other columns of ``docs`` folded into one, and the rules to search the text for (``todo``)."""
    found = candidates(docs, rules).select(F.col("doc_id").alias("candidate_id"), F.col("rules").alias("candidate_rules"))
    full = tuple(r for r in rules if not trigram_query(r.pattern))
    always = [r.kind for r in full]
    # Rules without trigrams meet every text here; their match is a run in one class, which the JVM finds first.
    possible = F.lit(False)
    for r in full:
        run = f"{r.pattern[:-1]}{{{r.least},}}" if r.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else r.pattern
        possible = possible | F.col("text").rlike(run)
    every = [r.kind for r in rules]
    todo = (F.when(F.col("doc_id").isNull(), F.array(*map(F.lit, every)))
            .otherwise(F.concat(F.coalesce("candidate_rules", F.expr("cast(array() as array<string>)")),
                                F.when(possible, F.array(*map(F.lit, always))).otherwise(F.expr("cast(array() as array<string>)"))
                                if always else F.expr("cast(array() as array<string>)"))))
    rows = docs.select("doc_id", "text", folded(docs, (*without, *BESIDE))).join(found, F.col("doc_id") == F.col("candidate_id"), "left")
    return rows.select("doc_id", "text", "kept", todo.alias("todo"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(docs: DataFrame, rules=RULES, mask: str = "[secret]") -> DataFrame:
    """Replace the secrets in every text by ``mask``; overlapping spans become one. ``n_chars``, if present, follows.

    All rows stay, with the columns of the input. Null texts stay null.
    """
    @F.pandas_udf("string")
    def masked(text, kinds):
        import pandas as pd

        out = []
        for t, ks in zip(text, kinds, strict=True):
            parts, at = [], 0
            for s, e in sorted((s, e) for s, _, e in _spans_of(t, ks, rules)):
                if e <= at:
                    continue
                if s >= at:
                    parts += [t[at:s], mask]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if at else None)
        return pd.Series(out)

    # Only texts with something to search for go to Python, once, and only masked ones come back.
    new = {"text": F.coalesce("masked", "text")}
    scanned = _scanned(docs, rules).select("doc_id", "text", "kept", masked(F.when(F.size("todo") > 0, F.col("text")), "todo").alias("masked"))
    if "n_chars" in docs.columns:
        old = F.col("kept").getField("n_chars")
        new["n_chars"] = F.when(F.col("masked").isNotNull(), F.char_length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return scanned.select(*[new[c].alias(c) if c in new else _column(c) for c in docs.columns])
