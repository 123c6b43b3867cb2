"""Language identification by unigram pieces with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum
over all of its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The
piece probabilities are fitted by expectation maximisation, also over all segmentations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of_texts, settle

UNKNOWN = "und"
#: Distinct texts of each language that the model is fitted on (about: a draw by hash), and rounds of fitting.
TRAIN_DOCS = 400
ROUNDS = 3
#: Words scored together, and characters of them.
CHUNK, CHUNK_CHARACTERS = 5000, 200_000
#: Longest piece, its mark included; no segmentation reaches further back.
REACH = 17
#: Words whose scores a task remembers, and characters of them; when it has more it starts anew.
DICTIONARY, CHARACTERS = 200_000, 1 << 22
#: Probability of a character that no piece covers; share of all counts spread over pieces not seen.
FLOOR = 1e-7
START = "▁"

LETTERS = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> Counter:
    """Lower-case words (runs of letters of any length) of a text with their frequencies."""
    found = Counter(LETTERS.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        if letters := "".join(c for c in w if c.isalpha()):
            found[letters] += n
    return found


class Pieces:
    """The vocabulary's pieces of letters, with look-up of all pieces inside many words at once."""

    def __init__(self, vocabulary: str):
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        own = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
        own = sorted(p for p in own if p.removeprefix(START).isalpha() and len(p) <= REACH)
        self.n = len(own)
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.by_length = {}
        for size in sorted({len(p) for p in own}):
            ids = [i for i, p in enumerate(own) if len(p) == size]
            codes = np.array([[ord(c) for c in own[i]] for i in ids], np.uint64)
            h = np.zeros(len(ids), np.uint64)
            for k in range(size):
                h = h * self.base + codes[:, k]
            order = np.argsort(h)
            self.by_length[size] = h[order], np.array(ids)[order]

    def edges(self, words: list[str]):
        """For words of one length: yields (start, end, rows, piece ids) of all pieces that stand in them, by rising end."""
        import numpy as np

        length = len(words[0]) + 1
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), np.uint32).reshape(-1, length)
        prefix = np.zeros((length + 1, len(words)), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * self.base + codes[:, i]
        found, power, last = [], 1, 0
        for size in self.by_length:
            if size > length:
                break
            power, last = power * pow(int(self.base), size - last, 2**64) % 2**64, size
            keys, ids = self.by_length[size]
            h = prefix[size:] - prefix[:-size] * np.uint64(power)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            starts, rows = np.nonzero(keys[at] == h)
            if len(rows):
                bounds = np.searchsorted(starts, np.arange(length + 2 - size))
                found.append((size, bounds.tolist(), rows, ids[at[starts, rows]]))
        for end in range(1, length + 1):
            for size, bounds, rows, ids in found:
                if size <= end and bounds[end - size] < bounds[end - size + 1]:
                    of = slice(bounds[end - size], bounds[end - size + 1])
                    yield end - size, end, rows[of], ids[of]


def forward(pieces: Pieces, words: list[str], prob):
    """Log probabilities of words of one length under ``prob`` (pieces x languages), and of all their prefixes.

    Sums of the last columns are brought back to 1 now and then, so that words of any length keep their precision:
    the logarithm of a prefix's probability is that of its sum plus its shift.
    """
    import numpy as np

    length = len(words[0]) + 1
    alpha = np.zeros((length + 1, len(words), prob.shape[1]))
    shift = np.zeros_like(alpha) if length > REACH else None
    alpha[0] = 1

    def step(end: int) -> None:
        if end > REACH and end % REACH == 1:
            unit = alpha[end - 1].copy()
            alpha[end - REACH:end] /= unit
            shift[end - REACH:end] += np.log(unit)
        if shift is not None:
            shift[end] = shift[end - 1]
        alpha[end] += alpha[end - 1] * FLOOR  # a character may always stand for itself

    done = 0
    for start, end, rows, ids in pieces.edges(words):
        while done < end:
            done += 1
            step(done)
        alpha[end, rows] += alpha[start, rows] * prob[ids]
    while done < length:
        done += 1
        step(done)
    return (np.log(alpha[length]) if shift is None else np.log(alpha[length]) + shift[length]), alpha, shift


def expected_counts(pieces: Pieces, words: list[str], weights, prob):
    """Expected uses of each piece in words of one length under one language's ``prob``, times the words' weights."""
    import numpy as np

    total, alpha, shift = forward(pieces, words, prob[:, None])
    before = np.log(alpha[:, :, 0]) + (0 if shift is None else shift[:, :, 0])
    length = len(before) - 1
    after = np.zeros_like(before)  # log probabilities of the suffixes
    counts = np.zeros(pieces.n)
    by_start: dict[int, list] = {}
    for e in pieces.edges(words):
        by_start.setdefault(e[0], []).append(e)
    for start in range(length - 1, -1, -1):
        grown = np.full(len(words), FLOOR)  # relative to the suffix that is a character shorter
        for _, end, rows, ids in by_start.get(start, ()):
            grown[rows] += prob[ids] * np.exp(after[end, rows] - after[start + 1, rows])
        after[start] = after[start + 1] + np.log(grown)
        for _, end, rows, ids in by_start.get(start, ()):
            np.add.at(counts, ids, weights[rows] * prob[ids] * np.exp(before[start, rows] + after[end, rows] - total[rows, 0]))
    return counts


def fit(labelled: DataFrame, vocabulary: str, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS):
    """Piece probabilities of each language, from rows with text and lang: (languages, pieces x languages array).

    About ``train_docs`` distinct texts of each language are used, all where it has fewer: drawn by the hash of the whole
    text, and counted once however many rows repeat them. Texts are told apart by 64-bit hashes. Word counts and expected
    piece counts are Spark aggregations; to the driver come a row per language and one per language and piece of the fixed
    vocabulary.
    """
    import numpy as np

    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text", F.lit(11)).alias("key"))
    sizes = {r.lang: r["count"] for r in rows.select("lang", "key").distinct().groupBy("lang").count().collect()}
    languages = sorted(sizes)
    pieces = Pieces(vocabulary)
    if not languages:
        return [], np.zeros((pieces.n, 0))
    rate = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, train_docs / sizes[lang]))))
    drawn = rows.where(F.col("key") / 2.0**64 + 0.5 < F.element_at(rate, F.col("lang")))

    def split(batches: Iterator) -> Iterator:
        import pandas as pd

        seen = set()  # of the drawn texts only, which are few
        for b in batches:
            found = []
            for lang, text, key in zip(b["lang"], b["text"], b["key"], strict=True):
                if (lang, key) not in seen:
                    seen.add((lang, key))
                    found += [(lang, key, w, n) for w, n in words_in(text).items()]
            yield pd.DataFrame(found, columns=["lang", "key", "word", "n"])

    once = drawn.mapInPandas(split, "lang string, key long, word string, n long").dropDuplicates(["lang", "key", "word"])
    words = settle(once.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    prob = np.full((pieces.n, len(languages)), 1 / pieces.n)
    for _ in range(rounds):
        now = prob

        def expect(batches: Iterator) -> Iterator:
            import pandas as pd

            own = Pieces(vocabulary)
            for b in batches:
                b = b.assign(size=b["word"].str.len())
                for (lang, _), part in b.groupby(["lang", "size"], sort=False):
                    counts = expected_counts(own, part["word"].tolist(), part["n"].to_numpy(float), now[:, languages.index(lang)])
                    ids = np.flatnonzero(counts > 0)
                    yield pd.DataFrame({"lang": lang, "piece": ids, "n": counts[ids]})

        got = words.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(
            F.sum("n").alias("n")).collect()
        prob = np.full((pieces.n, len(languages)), 0.1)
        for r in sorted(got):
            prob[r.piece, languages.index(r.lang)] += r.n
        prob /= prob.sum(0)
    return languages, prob


class Predictor:
    """Languages of texts under a fitted model; remembers the scores of words that it has seen."""

    def __init__(self, model, vocabulary: str):
        import numpy as np

        self.languages, self.prob = model
        self.pieces = Pieces(vocabulary)
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)), np.float32)
        self.characters = 0

    def _learn(self, words) -> None:
        import numpy as np

        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for same in by_length.values():
            size = max(1, min(CHUNK, CHUNK_CHARACTERS // len(same[0])))
            for i in range(0, len(same), size):
                chunk = same[i:i + size]
                low, high = len(self.place), len(self.place) + len(chunk)
                self.place.update(zip(chunk, range(low, high), strict=True))
                self.characters += len(chunk) * len(chunk[0])
                if high > len(self.scores):
                    more = np.zeros((max(2 * len(self.scores), high, 65536) - len(self.scores), len(self.languages)), np.float32)
                    self.scores = np.concatenate([self.scores, more])
                self.scores[low:high] = forward(self.pieces, chunk, self.prob)[0]

    def predict(self, texts) -> list[tuple[str, float]]:
        """(language, posterior) of each text."""
        import numpy as np

        out = []
        for at in range(0, len(texts), 250):
            part = [words_in(t) if t else None for t in texts[at:at + 250]]
            if len(self.place) > DICTIONARY or self.characters > CHARACTERS:
                self.place, self.scores, self.characters = {}, self.scores[:0], 0
            if self.languages:
                self._learn(set().union(*(p for p in part if p)) - self.place.keys())
            for p in part:
                if not p or not self.languages:
                    out.append((UNKNOWN, 0.0))
                    continue
                rows = np.fromiter(map(self.place.__getitem__, p), np.int64, len(p))
                total = np.fromiter(p.values(), float, len(p)) @ self.scores[rows]
                best = int(total.argmax())
                out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def predict_language(docs: DataFrame, model, vocabulary: str) -> DataFrame:
    """Per row: doc_id, lang_pred and score, the posterior of that language with equal priors.

    Texts that are null or have no letter, and all texts if no language was learned, get ``und`` with score 0. Ties go
    to the first language by name. Every word of a text counts; only the text is used. Rows are independent: ids may be
    null or repeat, other columns are not read, an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        predictor = None
        for batch, texts in batches_of_texts(batches, 1):
            predictor = predictor or Predictor(model, vocabulary)
            found = predictor.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model, vocabulary: str, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is identified with a posterior of at least ``least``, columns as they are.

    Null texts and texts without a letter go. Every row is judged by itself.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        predictor = None
        for batch, texts in batches_of_texts(batches, at):
            predictor = predictor or Predictor(model, vocabulary)
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in predictor.predict(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
