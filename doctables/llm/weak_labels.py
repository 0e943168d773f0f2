"""A quality classifier without labels: heuristics vote, expectation-maximisation weighs them, a hashed linear scorer learns the result.

Each heuristic votes for good, for bad, or not at all. How often each combination of votes occurs is counted over all documents; on that
table, which has at most 3**n rows, EM estimates how often each heuristic votes what in good and in bad documents, and so how likely each
combination is good. These probabilities are the labels from which a logistic scorer over hashed words and word shapes is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import BLANK, LOWER, SpanHasher, mixed, numbered, renamed, slices, text_bytes, words_of

GOOD, BAD, SILENT = 2, 1, 0
N_VOTES = 7
DIMENSIONS = 1 << 12
MAX_FITTED = 6000
MIN_SCORE = 0.3


def _bytes_in(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(characters))


MARK, ENDING = _bytes_in(b"#*$%&|<>{}\\^~=_"), _bytes_in(b".,;:!?")
#: Letters; all bytes beyond ASCII belong to some.
LETTER = _bytes_in(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
#: What a byte looks like: a letter, a digit, or itself.
LOOK = np.where(LETTER, 97, np.where(_bytes_in(b"0123456789"), 48, np.arange(256))).astype(np.uint8)


class Slice:
    """The words of a slice of texts as arrays: what the heuristics and the scorer measure."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        self.starts, self.ends, self.first = words_of(self.data, self.offsets, BLANK)
        self.n_texts, self.n = len(self.offsets) - 1, np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_texts), self.n)
        self.number = numbered(self.data, self.starts, self.ends)[0].astype(np.int64) if len(self.starts) else np.zeros(0, np.int64)
        self.again = np.flatnonzero((self.number[1:] == self.number[:-1]) & (self.doc[1:] == self.doc[:-1])) + 1

    def per_text(self, word_value: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, word_value, self.n_texts)

    def inside(self, hit: np.ndarray) -> np.ndarray:
        """Per word, how many of its bytes are hit."""
        total = np.concatenate(([0], np.cumsum(hit)))
        return total[self.ends] - total[self.starts]

    def most_frequent(self) -> np.ndarray:
        """Per text, how often its most frequent word occurs."""
        cell, count = np.unique(self.doc * (len(self.number) + 1) + self.number, return_counts=True)
        out = np.zeros(self.n_texts, np.int64)
        np.maximum.at(out, cell // (len(self.number) + 1), count)
        return out

    def repeated_lines(self) -> np.ndarray:
        """Per text, the share of its lines with a word that an earlier line equals."""
        breaks = np.union1d(np.flatnonzero(self.data == 10), self.offsets)
        starts, ends = breaks[:-1], breaks[1:]
        starts = starts + ((starts < len(self.data)) & (self.data[np.minimum(starts, max(len(self.data) - 1, 0))] == 10) if len(self.data) else 0)
        held = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[held], ends[held]
        doc = np.searchsorted(self.offsets, starts, side="right") - 1
        number = numbered(self.data, starts, ends)[0].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        different = np.unique(doc * (len(number) + 1) + number) // (len(number) + 1)
        lines = np.bincount(doc, minlength=self.n_texts)
        return 1 - np.bincount(different, minlength=self.n_texts) / np.maximum(lines, 1)

    def votes(self) -> np.ndarray:
        """The heuristics' votes, a row per text: words, repeated words, marks, length, sentence ends, plain words, frequent words and lines."""
        n = np.maximum(self.n, 1)
        runs = np.bincount(self.doc[self.again], minlength=self.n_texts) / n
        marks = self.per_text(self.inside(MARK[self.data])) / n
        mean = self.per_text(self.inside((self.data & 0xC0) != 0x80)) / n
        end = ENDING[self.data[self.ends - 1]]
        ends = self.per_text(end) / n
        letters, endings, size = self.inside(LETTER[self.data]), self.inside(ENDING[self.data]), self.ends - self.starts
        # letters, then nothing but sentence ends: as many of these as bytes behind the last letter
        last = np.maximum.accumulate(np.where(LETTER[self.data], np.arange(1, len(self.data) + 1), 0))[self.ends - 1] if len(self.ends) else size
        plain = self.per_text((letters > 0) & (letters == last - self.starts) & (letters + endings == size)) / n
        most, same = self.most_frequent(), self.repeated_lines()
        vote = lambda good, bad: np.where(good, GOOD, np.where(bad, BAD, SILENT))
        out = np.stack([
            vote(self.n >= 30, self.n < 8),
            vote(runs < 0.02, runs > 0.2),
            vote(marks < 0.05, marks > 0.3),
            vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 14)),
            vote((ends >= 0.02) & (ends <= 0.4), (ends == 0) & (self.n > 40)),
            vote(plain > 0.9, plain < 0.6),
            np.where(same < 0.3, vote(most < 0.12 * n, (most > 0.3 * n) & (self.n > 10)), BAD),
        ], axis=1)
        out[self.n == 0] = [BAD, *[SILENT] * (N_VOTES - 1)]
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, slot, value of the hashed words, shapes and repeated words; scaled by the number of words, each text's to length 1."""
        word = SpanHasher(LOWER[self.data])(self.starts, self.ends) % np.uint64(DIMENSIONS)
        look = LOOK[self.data]
        opens = np.concatenate(([True], look[1:] != look[:-1]))[: len(look)]
        opens[self.starts] = True
        at = np.flatnonzero(opens)
        runs = look[at] + np.where(np.diff(np.append(at, len(look))) > 1, 128, 0).astype(np.uint8)  # runs of one look are one, and marked
        place = np.cumsum(opens) - 1
        shape = SpanHasher(runs)(place[self.starts], place[self.ends - 1] + 1) if len(self.starts) else word
        shape = mixed(shape + np.uint64(1)) % np.uint64(DIMENSIONS)
        slots = [word.astype(np.int64), shape.astype(np.int64), np.ones(4 * len(self.again), np.int64)]
        texts = [self.doc, self.doc, np.repeat(self.doc[self.again], 4)]
        cell, count = np.unique(np.concatenate(texts) * DIMENSIONS + np.concatenate(slots), return_counts=True)
        text, slot = np.divmod(cell, DIMENSIONS)
        value = np.sqrt(count / self.n[text])
        return text, slot, value / np.sqrt(np.bincount(text, value**2, self.n_texts))[text]


def patterns_of(votes: np.ndarray) -> list[str]:
    """Each text's votes as digits."""
    return np.ascontiguousarray(votes + 48, np.uint8).view(f"S{N_VOTES}").ravel().astype(str).tolist()


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, each heuristic's vote probabilities [class, heuristic, vote], and how likely each pattern is good."""
    n_votes = patterns.shape[1]
    good = np.clip(0.5 + ((patterns == GOOD).sum(axis=1) - 2.0 * (patterns == BAD).sum(axis=1)) / (2 * n_votes), 0.02, 0.98)
    for _ in range(rounds):
        weight = np.stack(((1 - good) * counts, good * counts))
        share = weight[1].sum() / max(weight.sum(), 1e-9)
        table = np.stack([np.stack([[weight[c][patterns[:, h] == v].sum() + 1.0 for v in range(3)] for h in range(n_votes)]) for c in range(2)])
        table /= table.sum(axis=2, keepdims=True)
        log = np.stack([sum(np.log(table[c, h, patterns[:, h]]) for h in range(n_votes)) for c in range(2)])
        log += np.log(np.clip([[1 - share], [share]], 1e-9, 1))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        if np.abs(new - good).max(initial=0) < 1e-7:
            good = new
            break
        good = new
    return float(share), table, good


def fit(row: np.ndarray, at: np.ndarray, value: np.ndarray, target: np.ndarray, passes: int = 60, rate: float = 6.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the offset) of a logistic scorer for targets between 0 and 1, by gradient steps over all rows.

    ``row``, ``at``, ``value``: the features of all rows, one after another.
    """
    n = max(len(target), 1)
    weights, offset, square = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-6)
    for _ in range(passes):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at] * value, len(target)) + offset, -40, 40)))
        miss = (score - target) / n
        gradient = np.bincount(at, miss[row] * value, DIMENSIONS) + decay * weights
        square += gradient**2
        weights -= rate * gradient / np.sqrt(square) / 10
        offset -= rate * miss.sum() / 2
    return np.append(weights, offset)


def scores(words: Slice, weights: np.ndarray) -> np.ndarray:
    """The scorer's probabilities; 0 for a text without words."""
    text, slot, value = words.features()
    raw = np.bincount(text, weights[slot] * value, words.n_texts) + weights[-1]
    return np.where(words.n > 0, 1 / (1 + np.exp(-np.clip(raw, -40, 40))), 0.0)


def fitting_rows(table: DataFrame, n_docs: int, max_fitted: int) -> DataFrame:
    """At most ``max_fitted`` texts: the first by a hash of id and text. A filter by that hash comes first, so few rows are ordered."""
    hashed = table.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text")
    kept = min(1.0, 2 * max_fitted / n_docs)
    first = lambda rows: rows.orderBy("h", "doc_id").limit(max_fitted).select("text")
    if kept < 1:
        few = hashed.filter(F.pmod("h", F.lit(1 << 20)) < int(kept * (1 << 20)) + 1)
        if few.agg(F.count(F.lit(1))).first()[0] >= max_fitted:
            return first(few)
    return first(hashed)  # small tables, and tables of few different rows


def scored(docs: DataFrame, max_fitted: int = MAX_FITTED, min_score: float = MIN_SCORE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, votes (one digit each), weak_label (how likely good by the votes), score (0 to 1), kept.

    Votes and their combinations cover all documents. The scorer is fitted on at most ``max_fitted`` of them, chosen by a hash of id and
    text. A missing text counts as empty: it is bad. Repeated rows are scored alike. An empty table gives an empty result.
    """
    table = renamed(docs, {"doc_id": id_column, "text": text_column}).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, n = np.unique(Slice(batch.column("text")).votes() @ 3 ** np.arange(N_VOTES)[::-1], return_counts=True)
            digits = found[:, None] // 3 ** np.arange(N_VOTES)[::-1] % 3
            yield pa.RecordBatch.from_arrays([pa.array(patterns_of(digits)), pa.array(n)], names=["votes", "n"])

    table_of = table.select("text").mapInArrow(voted, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()  # 3**7 rows at most
    n_docs = sum(r.n for r in table_of)
    if not n_docs:
        return docs.sparkSession.createDataFrame([], "doc_id long, votes string, weak_label double, score double, kept boolean")
    _, _, good = expectation_maximisation(np.array([[int(v) for v in r.votes] for r in table_of]), np.array([r.n for r in table_of], float))
    label = {r.votes: float(g) for r, g in zip(table_of, good)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Slice(batch.column("text"))
            text, slot, value = words.features()
            bounds = np.searchsorted(text, np.arange(words.n_texts + 1)).tolist()
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(cut(slot.astype(np.int32)), pa.binary()), pa.array(cut(value.astype(np.float32)), pa.binary()), pa.array(patterns_of(words.votes()))], names=["at", "value", "votes"])

    sample = fitting_rows(table, n_docs, max_fitted).mapInArrow(featured, "at binary, value binary, votes string").collect()
    at, value = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in sample)]) for name, kind in (("at", np.int32), ("value", np.float32)))
    row = np.repeat(np.arange(len(sample)), [len(r["at"]) // 4 for r in sample])
    weights = fit(row, at, value.astype(float), np.array([label[r.votes] for r in sample]))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Slice(batch.column("text"))
            given, marks = patterns_of(words.votes()), scores(words, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(given), pa.array([label[v] for v in given]), pa.array(marks), pa.array(marks >= min_score)], names=["doc_id", "votes", "weak_label", "score", "kept"])

    return table.mapInArrow(judged, "doc_id long, votes string, weak_label double, score double, kept boolean")
