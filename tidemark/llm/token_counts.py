"""Token counts: pieces of each distinct pre-token, joined to the documents' pre-token frequencies.

A task keeps a dictionary from pre-token to number of pieces. Every batch adds the pre-tokens that it sees for the
first time, encoded together, and each document then sums frequency times pieces; token ids are never kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of the byte-level vocabulary and its one special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
#: Pre-tokens in a task's dictionary. When it is full it starts anew, which costs time, never counts.
DICTIONARY = 1_000_000
#: Characters of text that are split before their new pre-tokens are encoded.
BLOCK = 4_000_000


class PieceCounts:
    """Number of vocabulary pieces of pre-tokens, each distinct one encoded once."""

    def __init__(self, vocabulary: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)  # they are split already
        self.tokenizer.encode_special_tokens = True
        self.pieces: dict[str, int] = {}
        self.find = regex.compile(PATTERN).findall

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the text's pre-tokens, and how often the special token stands in it."""
        parts = text.split(SPECIAL) if SPECIAL in text else [text]
        found = Counter(self.find(parts[0]))
        for part in parts[1:]:
            found.update(self.find(part))
        return found, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        found = [self.frequencies(t) for t in texts]
        if len(self.pieces) > DICTIONARY:
            self.pieces.clear()
        known = self.pieces
        new = list(set().union(*(f for f, _ in found)) - known.keys()) if found else []
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            known.update(zip(part, (len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(int.__mul__, map(known.__getitem__, f), f.values())) + special for f, special in found]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``vocabulary`` is the path of a byte-level tokenizers file on every machine. A null text counts as empty, which
    has 0 bytes and tokens. Rows are independent: null and repeated ids and equal texts need no care, an empty table
    gives an empty result. The text is never shuffled.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = None
        for batch in batches:
            counts = counts or PieceCounts(vocabulary)
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            tokens: list[int] = []
            block: list[str] = []
            size = 0
            for t in texts:
                block.append(t)
                size += len(t)
                if size >= BLOCK:
                    tokens += counts.count(block)
                    block, size = [], 0
            tokens += counts.count(block)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(tokens, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
