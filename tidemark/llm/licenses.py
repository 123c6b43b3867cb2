"""License scans: a positional index of each template's rarest words.

The rarity of a licence word is its inverse document frequency over all documents. A template is indexed under its
rarest words with their positions. A file looks up those of its words that are in the index; postings that agree on
where the template would begin are intersected, and a template counts if its mandatory phrases stand there.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest words that a template is indexed under.
KEYS = 6


@dataclass(frozen=True)
class Template:
    """``text`` is matched by relative position; each of ``phrases`` must stand in the matched stretch.

    A base template is its own phrase: all of its words are keys and must agree.
    """
    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False


#: Base phrases with their labels.
BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)
#: Opening sentences of public licence texts and notices, and phrases none of their copies lacks.
NOTICES = (
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the Software), to deal in the Software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("permission to use copy modify", "with or without fee")),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("apache-text", "you may not use this file except in compliance with the License. You may obtain a copy of the "
             "License at http www apache org licenses LICENSE 2 0",
             ("except in compliance with the license",)),
    Template("gpl-text", "This program is free software you can redistribute it and or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation",
             ("free software you can redistribute it",)),
    Template("mpl-text", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0",
             ("mozilla public license",)),
    Template("unlicense-text", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
    Template("cc-text", "This work is licensed under a Creative Commons Attribution 4 0 International License",
             ("licensed under a creative commons",)),
)


def words_of(text: str) -> list[str]:
    import re

    # Bytes from 128 on belong to words, so words of the UTF-8 bytes are the words of the text.
    return [w.decode() for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())]


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all documents each licence word stands, and the number of documents.

    One row per licence word comes back, however many documents there are.
    """
    known = F.array(*map(F.lit, words))
    found = F.array_intersect(F.split(lower_ascii(F.coalesce("text", F.lit(""))), SPLIT), known)
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count().collect()
    df = {r.w: r["count"] for r in rows}
    return df, df.pop("", 0)


class PositionalIndex:
    """Rarest words of the templates -> (template, position) postings."""

    def __init__(self, templates, df: dict[str, int], n_docs: int, keys: int):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.phrases = [[words_of(p) for p in t.phrases] for t in templates]
        idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for ws in self.words for w in ws}
        self.postings = defaultdict(list)
        self.needed = []
        for n, ws in enumerate(self.words):
            rare = sorted(set(ws), key=lambda w: (-idf[w], w))
            rare = set(rare if templates[n].base else rare[:keys])
            places = [(w, i) for i, w in enumerate(ws) if w in rare]
            for w, i in places:
                self.postings[w].append((n, i))
            self.needed.append(len(places) if templates[n].base else (len(places) + 1) // 2)
        self.keys = frozenset(self.postings)

    def look_up(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words in place) of each template found in a file's words."""
        if self.keys.isdisjoint(words):
            return []
        votes = Counter()
        for at, w in enumerate(words):
            if w in self.keys:
                for n, i in self.postings[w]:
                    votes[n, at - i] += 1
        found = []
        for (n, start), v in votes.items():
            if v < self.needed[n]:
                continue
            own = self.words[n]
            if self.templates[n].base:
                found.append((n, start, 1.0))
                continue
            low, high = max(0, start - 3), start + len(own) + 3
            if all(_stands(words, p, low, high) for p in self.phrases[n]):
                same = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(own))
                found.append((n, start, same / len(own)))
        return found


def _stands(words: list[str], phrase: list[str], low: int, high: int) -> bool:
    return any(words[i:i + len(phrase)] == phrase for i in range(low, min(high, len(words)) - len(phrase) + 1))


def scan_licenses(docs: DataFrame, templates=BASE + NOTICES, keys: int = KEYS) -> DataFrame:
    """Add ``n_words`` and ``license_hits`` (label, base, start, end, score; words from 0) to doc_id, for each row.

    A null or empty text has no words and no hits. Every place of a base phrase is a hit of its own; a notice may be
    hit at several starts. Rows are independent, so null and repeated ids are fine, and other columns are not read.
    An empty table gives an empty result.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    df, n_docs = document_frequencies(texts, vocabulary)
    index = PositionalIndex(templates, df, n_docs, keys)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        find = re.compile(rb"[0-9a-z\x80-\xff]+").findall
        raw_keys = frozenset(k.encode() for k in index.keys)
        hit = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("score", pa.float64())]))
        for batch in batches:
            n_words, hits = [], []
            for text in batch.column(1).to_pylist():
                words = find(text.encode().lower())
                n_words.append(len(words))
                own = [] if raw_keys.isdisjoint(words) else sorted(
                    (s, n, x) for n, s, x in index.look_up([w.decode() for w in words]))
                hits.append([{"label": index.templates[n].label, "base": index.templates[n].base, "start": s,
                              "end": s + len(index.words[n]), "score": x} for s, n, x in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, hit)],
                                             names=["doc_id", "n_words", "license_hits"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, license_hits "
                            "array<struct<label:string,base:boolean,start:bigint,end:bigint,score:double>>")
