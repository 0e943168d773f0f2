"""Toxicity by a lexicon that survives misspelling, and by what stands around the terms.

The lexicon is learned from labelled rows: words and word beginnings that are far commoner in toxic texts. It is kept as a trie. Each word
of a text is run through it with a Levenshtein automaton, whose state is the set of edit distances along the trie's path (an exchange of
neighbouring letters is one edit), so that one walk finds all terms within one edit. An edit leaves one half of a term as it is, so words
that hold no half of any term where it would stand are not walked. Symbols inside words stand for the letters they look like, and a star
for any letter. A term in quotation marks or after a word of report within its window counts apart from one without. A logistic model over
these counts, fitted on the same rows, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import renamed, slices
from doctables.sinks.stored import stored

MAX_LABELLED = 12_000
MIN_DOCS = 5
MIN_PERCENT = 1
MIN_SHARE = 0.8
WINDOW = 8
MEMO = 200_000
THRESHOLD = 0.3
WORD = re.compile(r"[$@0-9]?[^\W\d_]+(?:['’*$@!0-9]+[^\W\d_]+)*[*$]*")
#: The letters that symbols look like; marks inside words that stand for nothing.
LOOKS_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "'": None, "’": None})
#: Marks and words that introduce what somebody else said.
QUOTES = "\"“”„«»"
REPORTS = {"said", "says", "wrote", "called", "quoted", "quote", "term", "word", "sagte", "schrieb", "zitat", "wort", "dit", "écrit", "citation", "mot", "dijo", "escribió", "cita", "palabra"}


def terms_of(word: str) -> set[str]:
    """What may become a term: the word, and its beginnings (with a star) of four to eight letters."""
    return {word, *(word[:k] + "*" for k in (4, 5, 6, 7, 8) if len(word) > k)}


class Lexicon:
    """A trie of terms, searched with at most one edit. Terms outside ``fuzzy`` are met exactly only. A star in a word is any letter."""

    def __init__(self, terms: list[str], fuzzy: set[str] | None = None):
        self.terms = terms
        self.fuzzy = set(terms) if fuzzy is None else fuzzy
        self.root: dict = {}
        self.memo: dict[str, tuple[str | None, bool]] = {}
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[tuple[int, int], set[str]] = {}
        for term in terms:
            node, letters = self.root, term.rstrip("*")
            for letter in letters:
                node = node.setdefault(letter, {})
            node["*" if term.endswith("*") else ""] = term
            if term in self.fuzzy:
                half = len(letters) // 2
                # an exchange across the middle changes both halves, so its first half counts too
                self.heads.setdefault(half, set()).update({letters[:half], letters[: half - 1] + letters[half : half + 1]})
                self.tails.setdefault((half, len(letters) - half), set()).add(letters[half:])

    def find(self, word: str) -> tuple[str | None, bool]:
        """The nearest term (None: none within one edit), and whether it is met exactly."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = self._exact(word) or self._edited(word) or (None, False)
        return found

    def _exact(self, word: str) -> tuple[str, bool] | None:
        node = self.root
        for letter in word:
            node = node.get(letter) if letter != "*" else None
            if node is None:
                return None
            if "*" in node:
                return node["*"], True
        return (node[""], True) if "" in node else None

    def _possible(self, word: str) -> bool:
        """Whether the word holds one half of a term within a place of where it stands in the term."""
        return any(word[:n] in some for n, some in self.heads.items()) or any(
            word[at : at + n] in some for (half, n), some in self.tails.items() for at in (half, half - 1, half + 1)
        )

    def _edited(self, word: str) -> tuple[str, bool] | None:
        hidden = "*" in word
        if not hidden and not self._possible(word):
            return None
        first, most = list(range(len(word) + 1)), 0 if hidden else 1
        for letter, node in self.root.items():
            if letter and letter != "*":
                found = self._walk(node, letter, "", word, first, None, most)
                if found:
                    return found, False
        return None

    def _walk(self, node: dict, letter: str, before: str, word: str, row: list[int], above: list[int] | None, most: int) -> str | None:
        new = [row[0] + 1]
        for k in range(1, len(word) + 1):
            cost = min(new[k - 1] + 1, row[k] + 1, row[k - 1] + (word[k - 1] != letter and word[k - 1] != "*"))
            if above is not None and k > 1 and word[k - 1] == before and word[k - 2] == letter:
                cost = min(cost, above[k - 2] + 1)
            new.append(cost)
        for end, distance in (("", new[-1]), ("*", min(new[2:], default=9))):
            term = node.get(end)
            if term is not None and distance <= most and (most == 0 or term in self.fuzzy):
                return term
        if min(new) <= most:
            for following, below in node.items():
                if following and following != "*":
                    found = self._walk(below, following, letter, word, new, row, most)
                    if found:
                        return found
        return None

    def meets(self, token: str) -> tuple[str | None, bool]:
        """The term that a token of a text meets, as it stands, by what its symbols look like, or by its letters alone."""
        if token.isalpha():
            return self.find(token)
        plain = "".join(filter(str.isalpha, token))
        for word in dict.fromkeys((token.translate(LOOKS_LIKE), token.rstrip("*$").translate(LOOKS_LIKE), plain)):
            if word.strip("*"):
                term, _ = self.find(word)
                if term is not None:
                    return term, False
        return None, False


def hits(text: str, lexicon: Lexicon) -> list[tuple[str, bool, bool]]:
    """Term, met exactly, quoted, for every word of a text that meets a term. What is quoted shows in the words within the window."""
    low, out = text.lower(), []
    last: deque = deque(maxlen=WINDOW)
    for m in WORD.finditer(low):
        term, exact = lexicon.meets(m[0])
        if term is not None:
            around = low[last[0].start() if last else 0 : m.start()]
            following = list(islice(WORD.finditer(low, m.end()), WINDOW))
            ahead = low[m.end() : following[-1].end() + 1 if len(following) == WINDOW else len(low)]
            opened = sum(around.count(q) for q in QUOTES) % 2 == 1 and any(q in ahead for q in QUOTES)
            out.append((term, exact, opened or any(x[0] in REPORTS for x in last)))
        last.append(m)
    return out


def counts(found: list[tuple[str, bool, bool]]) -> list[float]:
    """The model's inputs: exact and misspelled terms, plain and quoted, damped, and whether there is any plain one."""
    number = Counter((exact, quoted) for _, exact, quoted in found)
    damped = [np.log1p(number[e, q]) for e in (True, False) for q in (False, True)]
    return [1.0, *damped, float(number[True, False] > 0)]


def fit(inputs: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model by Newton steps."""
    weights = np.zeros(inputs.shape[1])
    pull = np.full(inputs.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (p - target) + pull * weights
        curve = (inputs * (p * (1 - p))[:, None]).T @ inputs + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def chosen_terms(toxic: dict[str, int]) -> list[str]:
    """Of terms that begin alike: the longest that nearly all their texts share, else the shortest beginning."""
    most: dict[str, list[tuple[int, str]]] = {}  # the two commonest terms of each beginning
    for t, n in toxic.items():
        for k in range(4, min(8, len(t.rstrip("*"))) + 1):
            most[t[:k]] = sorted([*most.get(t[:k], []), (n, t)], reverse=True)[:2]
    narrow = lambda t: any(u != t and 10 * n >= 9 * toxic[t] for n, u in most.get(t[:-1], []))
    kept: list[str] = []
    begun: set[str] = set()
    for t in sorted((t for t in toxic if not (t.endswith("*") and narrow(t))), key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        if len(t.rstrip("*")) > 2 and not any(t[:k] in begun for k in range(4, 9)):
            kept.append(t)
            if t.endswith("*"):
                begun.add(t[:-1])
    return kept


def learned(table: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and model from about ``max_labelled`` labelled rows that are not held out, chosen by a hash of their id."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    n, nothing = known.count(), (Lexicon([]), np.array([-3.0, 0, 0, 0, 0, 0]))
    if not n:
        return nothing
    share = min(1.0, max_labelled / n)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = table.join(chosen, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = stored(rows.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))  # copies count once

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[toxic > 0].update(set().union(*map(terms_of, set(WORD.findall(text.lower())))) | {""})
            both = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][t] for t in both], pa.int64()), pa.array([seen[0][t] for t in both], pa.int64())], names=["term", "toxic", "other"])

    seen = rows.mapInArrow(told, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    total = seen.filter("term = ''").first()  # the empty term stands for all documents
    least = max(MIN_DOCS, (total.toxic * MIN_PERCENT) // 100) if total else MIN_DOCS
    strong = seen.filter((F.col("term") != "") & (F.col("toxic") >= least) & (F.col("toxic") >= MIN_SHARE * (F.col("toxic") + F.col("other"))))
    # each is in a share of the toxic rows, so they are as many as such a row has words, times a constant
    kept = chosen_terms({r.term: r.toxic for r in strong.orderBy("term").collect()})
    lexicon = Lexicon(kept)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [[f"{t}\t{int(e)}\t{int(q)}" for t, e, q in hits(x, lexicon)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.list_(pa.string()))], names=["toxic", "hits"])

    sample = [(r.toxic > 0, [(t, e == "1", q == "1") for t, e, q in (h.split("\t") for h in r.hits)]) for r in rows.mapInArrow(found, "toxic int, hits array<string>").collect()]
    if not sample:
        return nothing
    bad, good = Counter(), Counter()
    for toxic, own in sample:
        (bad if toxic else good).update({t for t, exact, _ in own if not exact})
    # a term that clean texts come near by chance is only met exactly
    fuzzy = {t for t in kept if good[t] == 0 or bad[t] >= 3 * good[t]}
    lexicon = Lexicon(kept, fuzzy)
    own = [(toxic, [h for h in found_ if h[1] or h[0] in fuzzy]) for toxic, found_ in sample]
    weights = fit(np.array([counts(h) for _, h in own]), np.array([float(t) for t, _ in own]))
    # where no labelled text was misspelled, an edited term counts as four fifths of a term
    if not any(not exact and not quoted for t, h in own if t for _, exact, quoted in h):
        weights[3] = max(weights[3], 0.8 * (weights[1] + weights[5] / np.log(2)))
    return lexicon, weights


def scored(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, terms (what was met).

    A missing or empty text has the score of a text without terms. Labels without id or verdict are left out; of several, the highest
    counts. Without labels the lexicon is empty. Repeated rows are scored alike. A missing id is not held out.
    """
    table = renamed(docs, {"doc_id": id_column, "text": text_column}).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    lexicon, weights = learned(table, renamed(labels, {"doc_id": "doc_id", "toxic": "toxic"}), max_labelled)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            met = [hits(x, lexicon) for x in batch.column("text").to_pylist()]
            mark = 1 / (1 + np.exp(-np.clip(np.array([counts(h) for h in met]) @ weights, -30, 30)))
            terms = [sorted({t for t, _, _ in h}) for h in met]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(mark), pa.array(terms, pa.list_(pa.string()))], names=["doc_id", "score", "terms"])

    out = table.mapInArrow(judge, "doc_id long, score double, terms array<string>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms")
