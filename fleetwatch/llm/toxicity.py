"""Toxicity scores from a learned lexicon, matched with Levenshtein automata, and the context of each hit.

1. From a bounded sample of labelled rows, words and word beginnings that mark toxic documents are learned.
2. The lexicon is a trie. Its product with the Levenshtein automata of one edit is walked character by
   character; the states met are determinised once and kept, so a word costs one lookup per character.
3. Hits are weighed by what the sample says about that entry at that distance, and split by their window
   of words: quoted or reported speech counts on its own, so the model learns how much it excuses.
4. A logistic model turns the features of a document into a score.

Nulls and empty texts are documents without words and get the score of such a document. Repeated rows get
equal scores. Without any labelled row of both kinds, every document gets the share of toxic labels (0 if
there are none). Labels, language, source and id are not inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.labelled import distinct_sample, remainder, teaching_rows
from fleetwatch.llm.logistic import fit, sigmoid
from fleetwatch.llm.words import hand_back, release_worker_memory, tidy
from fleetwatch.session import cut

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Bounds of the fit: labelled rows, letters of a word beginning.
MOST_ROWS, LONGEST = 12_000, 12
SHORTEST, LEAST_DOCS, LEAST_SHARE = 3, 4, 0.8
#: The probability of an entry's toxic documents at the overall rate, times all terms that are tried, is e to the
#: minus this at most.
LEAST_SURPRISE = 1.0
FUZZY_FROM = 5  # letters of an entry from which one edit is allowed; the end of a whole word counts as one
SAME_SHARE = 0.9  # of the toxic documents of a beginning, for a longer one to stand for it
CONTEXT = 6  # words on either side
MEMORY = 200_000  # words and states that a worker keeps
#: Bytes of pieces that a worker remembers, with what an entry itself takes.
KNOWN_BYTES, ENTRY = 48 << 20, 130
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”„«»‘’…"
_QUOTE = re.compile(r"[\"“”„«»‘]")
_REPORT = frozenset(
    "said says called call quote quoted quotes word words term terms slur insult insults wrote writes "
    "sagte nannte wort mot terme dit appelle dijo llamó palabra".split()
)
_END = "$"
FEATURES = 7


@dataclass
class Trie:
    """Lexicon entries; an entry ending in ``$`` is a whole word, any other one begins a word."""

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    begins: dict[int, int] = field(default_factory=dict)
    whole: dict[int, int] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, entries: Iterable[str]) -> Trie:
        trie = cls()
        for number, entry in enumerate(entries):
            letters = entry.removesuffix(_END)
            trie.lengths.append(len(entry))
            node = 0
            for c in letters:
                if c not in trie.next[node]:
                    trie.next.append({})
                    trie.next[node][c] = len(trie.next) - 1
                node = trie.next[node][c]
            (trie.whole if entry.endswith(_END) else trie.begins)[node] = number
        return trie


class LexiconAutomaton:
    """Trie and Levenshtein automata as one automaton; its states are made when a word first needs them.

    A state is a set of (trie node, edits) together with the beginnings that have been met on the way.
    """

    def __init__(self, entries: list[str], edits: int = 1):
        self.trie, self.edits = Trie.of(entries), edits
        self.start = self._state({0: 0})
        self.moves: dict[tuple[frozenset, str], tuple] = {}

    def _closed(self, reached: dict[int, int]) -> dict[int, int]:
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            if e < self.edits:
                for child in self.trie.next[node].values():
                    if reached.get(child, self.edits + 1) > e + 1:
                        reached[child] = e + 1
                        todo.append((child, e + 1))
        return reached

    def _state(self, reached: dict[int, int]) -> tuple:
        closed = self._closed(reached)
        met = tuple((self.trie.begins[n], e) for n, e in closed.items() if n in self.trie.begins)
        return frozenset(closed.items()), met

    def _move(self, state: frozenset, c: str) -> tuple:
        reached: dict[int, int] = {}
        for node, e in state:
            child = self.trie.next[node].get(c)
            if child is not None:
                reached[child] = min(e, reached.get(child, e))
            if e < self.edits:
                for n in (node, *self.trie.next[node].values()):
                    reached[n] = min(e + 1, reached.get(n, e + 1))
        return self._state(reached)

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(entry, edits) of every entry that the word is, or begins with, within the allowed edits."""
        if len(self.moves) > MEMORY:
            self.moves.clear()
        state, met = self.start
        best: dict[int, int] = dict(met)
        for c in word:
            step = self.moves.get((state, c))
            if step is None:
                step = self.moves[state, c] = self._move(state, c)
            state, met = step
            if not state:
                break
            for n, e in met:
                best[n] = min(e, best.get(n, e))
        for node, e in state:
            n = self.trie.whole.get(node)
            if n is not None:
                best[n] = min(e, best.get(n, e))
        return tuple((n, e) for n, e in best.items() if e == 0 or self.trie.lengths[n] >= FUZZY_FROM)


class Scanner:
    """Hits of a text: (entry, edits, quoted), and its number of words."""

    def __init__(self, entries: list[str]):
        self.automaton = LexiconAutomaton(entries)
        self.known: dict[str, tuple] = {}
        self.held = 0

    def hits(self, text: str) -> tuple[list[tuple[int, int, bool]], int]:
        pieces = text.lower().split()
        if self.held > KNOWN_BYTES:
            self.known.clear()
            self.held = 0
        known, found = self.known, []
        for i, piece in enumerate(pieces):
            met = known.get(piece)
            if met is None:
                met = known[piece] = tuple(m for w in self._words(piece) for m in self.automaton.match(w))
                self.held += len(piece) + ENTRY * (1 + len(met))
            if met:
                quoted = self._quoted(pieces, i)
                found.extend((n, e, quoted) for n, e in met)
        return found, len(pieces)

    @staticmethod
    def _words(piece: str) -> list[str]:
        """Runs of letters; a piece with other characters between its letters (``id1ot``) also as it stands."""
        runs, core = _WORD.findall(piece), piece.strip(_EDGE)
        return [*runs, core] if len(runs) > 1 and len(core) <= 3 * LONGEST else runs

    @staticmethod
    def _quoted(pieces: list[str], i: int) -> bool:
        """Whether the window opens a quotation before the word and closes it after, or reports speech."""
        before, after = pieces[max(0, i - CONTEXT) : i], pieces[i + 1 : i + 1 + CONTEXT]
        own = pieces[i]
        opened = _QUOTE.search(own[:1]) or any(_QUOTE.match(p) for p in before)
        closed = _QUOTE.search(own[1:]) or any(_QUOTE.search(p[1:]) for p in after)
        return bool(opened and closed) or any(p.strip(".,;:!?") in _REPORT for p in before)


@dataclass
class Lexicon:
    entries: list[str]
    #: Log-odds of a toxic document, by (entry, edits).
    weights: dict[tuple[int, int], float]

    def weight(self, entry: int, edits: int) -> float:
        """A misspelling that the sample does not hold weighs half as much as the term."""
        return self.weights.get((entry, edits), 0.5**edits * self.weights.get((entry, 0), 0.0))

    def features(self, hits: list[tuple[int, int, bool]], n_words: int) -> list[float]:
        plain = [self.weight(n, e) for n, e, quoted in hits if not quoted]
        quoted = [self.weight(n, e) for n, e, q in hits if q]
        gain, excused = sum(w for w in plain if w > 0), sum(w for w in quoted if w > 0)
        return [
            1.0,
            math.log1p(gain),
            max([0.0, *plain]),
            max([0.0, *quoted]),
            math.log1p(excused),
            math.log1p(100.0 * gain / max(20, n_words)),
            float(gain > 0),
        ]


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray
    rate: float


def word_beginnings(docs: DataFrame) -> DataFrame:
    """(term, toxic, n): documents, and toxic ones, with each word (``$`` at its end) and each beginning of one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                terms = set()
                for w in set(_WORD.findall(text.lower())):
                    terms.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
                    terms.add(w[:LONGEST] + _END if len(w) <= LONGEST else w[:LONGEST])
                n.update(terms)
                if label:
                    toxic.update(terms)
                if len(n) > 500_000:
                    yield _counts(n, toxic)
                    n, toxic = Counter(), Counter()
        if n:
            yield _counts(n, toxic)

    return (
        docs.select("text", "label")
        .mapInArrow(tidy(count), "term string, toxic long, n long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    )


def _counts(n: Counter, toxic: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"term": list(n), "toxic": [toxic[t] for t in n], "n": list(n.values())},
        schema=pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())]),
    )


def learn_entries(docs: DataFrame) -> list[str]:
    """All terms that mark toxic documents beyond chance, the shortest of those that say the same.

    The sample has a bounded number of rows, so their number needs no other bound.
    """
    rate = docs.agg(F.avg("label")).first()[0] or 0.0
    if not 0 < rate < 1:
        return []
    share = F.col("toxic") / F.col("n")
    clean = F.col("n") - F.col("toxic")
    surprise = F.col("toxic") * math.log(1 / rate) - clean * F.log(F.col("n") * math.e / F.greatest(clean, F.lit(1)))
    terms = cut(word_beginnings(docs).where(F.col("n") >= LEAST_DOCS), "terms")
    tried = math.log(max(1, terms.count()))
    rows = (
        terms.where((F.col("toxic") >= LEAST_DOCS) & (share >= LEAST_SHARE) & (surprise >= LEAST_SURPRISE + tried))
        .select("term", "toxic")
        .collect()
    )
    found = {r["term"]: r["toxic"] for r in rows}
    longest: dict[str, str] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):
        stem = next((s for k in range(SHORTEST, len(term)) if (s := term[:k]) in longest), None)
        if stem is None:
            longest[term] = term
        elif term.startswith(longest[stem]) and found[term] >= SAME_SHARE * found[stem]:
            longest[stem] = term  # as good as the shorter one, and meets fewer other words
    return sorted(longest.values(), key=lambda t: (-found[t], t))


def learn_weights(docs: DataFrame, entries: list[str]) -> dict[tuple[int, int], float]:
    """Log-odds per (entry, edits), from the documents of the sample that have such a hit."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, n, toxic = Scanner(entries), Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                kinds = {(e, d) for e, d, _ in scanner.hits(text)[0]} | {(-1, 0)}
                n.update(kinds)
                if label:
                    toxic.update(kinds)
        yield pa.RecordBatch.from_pydict(
            {
                "entry": [k[0] for k in n],
                "edits": [k[1] for k in n],
                "toxic": [toxic[k] for k in n],
                "n": list(n.values()),
            },
            schema=pa.schema([(c, pa.int64()) for c in ("entry", "edits", "toxic", "n")]),
        )

    rows = (
        docs.select("text", "label")
        .mapInArrow(tidy(hits), "entry long, edits long, toxic long, n long")
        .groupBy("entry", "edits")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .collect()
    )
    toxic, n = next(((r["toxic"], r["n"]) for r in rows if r["entry"] < 0), (0, 0))
    rate = (toxic + 1) / (n + 2)
    prior = 2.0  # documents at the overall rate that every entry starts from
    odds = lambda t, m: math.log((t + prior * rate) / (m - t + prior * (1 - rate)))
    return {
        (r["entry"], r["edits"]): odds(r["toxic"], r["n"]) - math.log(rate / (1 - rate))
        for r in rows
        if r["entry"] >= 0
    }


def _feature_rows(docs: DataFrame, lexicon: Lexicon, extra: str) -> DataFrame:
    """``extra`` columns and ``f``, the features of each text."""
    names = [c.split()[0] for c in extra.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon.entries)
        for batch in batches:
            rows = [lexicon.features(*scanner.hits(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(rows, pa.list_(pa.float64()))], names=[*names, "f"]
            )

    return docs.select(*names, "text").mapInArrow(tidy(run), f"{extra}, f array<double>")


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Lexicon, weights and logistic model from at most ``most_rows`` labelled rows outside the held-out fold."""
    sample = distinct_sample(docs, teaching_rows(labels, "toxic", FOLDS, HELD_OUT, most_rows))
    entries = learn_entries(sample)
    lexicon = Lexicon(entries, learn_weights(sample, entries) if entries else {})
    rows = _feature_rows(sample, lexicon, "doc_id long, label int").orderBy("doc_id").collect()
    y = np.array([r["label"] for r in rows], float)
    rate = float(y.mean()) if len(y) else 0.0
    if not 0 < rate < 1:
        return Model(lexicon, np.zeros(FEATURES), rate)
    return Model(lexicon, fit(np.array([r["f"] for r in rows]), y, ridge=1.0, free=0), rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    rows = _feature_rows(docs, model.lexicon, "doc_id long")
    if not 0 < model.rate < 1:
        return rows.select("doc_id", F.lit(float(model.rate)).alias("score"))
    total = sum((F.col("f")[i] * float(w) for i, w in enumerate(model.coefficients)), F.lit(0.0))
    return rows.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, learn(docs, labels)).select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with their columns; nothing is shuffled."""
    model = learn(docs, labels)
    if not 0 < model.rate < 1:
        return docs if model.rate < THRESHOLD else docs.limit(0)
    lexicon, coefficients = model.lexicon, model.coefficients

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_worker_memory()
        scanner = Scanner(lexicon.entries)
        for batch in texts:
            f = [lexicon.features(*scanner.hits(t or "")) for t in batch]
            yield pd.Series(sigmoid(np.array(f).reshape(-1, FEATURES) @ coefficients) < THRESHOLD)
        del scanner
        hand_back()

    return docs.where(clean("text"))
