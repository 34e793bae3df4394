"""Toxicity by a lexicon that tolerates misspelling.

The lexicon, whole words and word beginnings, is learned from labelled documents. Levenshtein
automata of its terms run over its trie as one automaton, whose states are made as words ask for
them: a word is read once, character by character, whatever the number of terms. Each hit is then
weighed by its context window: inside quotation marks or beside a verb of reporting it counts
as a quotation, beside a second person as abuse. A logistic model over the weighed hits scores.

Null and empty texts have no hits and get the score of such documents. With no labels of both
kinds there is no lexicon and all scores are 0. Whole texts are read. Repeated rows score alike.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, slices

#: Labelled documents of each class that a fit reads at most (about), and the candidates that it weighs at a time, those
#: most frequent in toxic documents first. Both are parameters of fit.
PER_CLASS, CANDIDATES = 4000, 8000
#: A term must be in MIN_DOCS toxic documents and so much likelier there than elsewhere, and add this share of the toxic
#: documents to those explained. A document that n chosen terms cover counts SEEN ** n for the next, so that
#: less than 1 / (1 - SEEN) / MIN_SHARE terms can be chosen at a time.
MIN_SHARE, MIN_DOCS, MIN_LIFT, SEEN = 0.003, 3, 25.0, 0.25
PREFIXES, LONGEST = range(4, 9), 40
#: Code points of context on either side of a hit.
WINDOW = 48

WORD = re.compile(r"\w+")
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’", "`": "`"}
#: Verbs of reporting, and second persons, of the languages in the corpus.
REPORTING = frozenset("said says called quoted quote wrote sagte nannte schrieb dit appelé écrit dijo llamó escribió".split())
SECOND = frozenset("you your youre du dich dein ihr euch tu toi vous votre tú eres usted ustedes".split())


def allowed(term: str) -> int:
    """Edits that a term of this length tolerates."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Lexicon:
    """Terms, those ending in * as beginnings of words; match() gives the fewest edits to any, or None."""

    def __init__(self, terms: Iterable[str], exact: Iterable[str] = ()):
        self.terms, strict = tuple(terms), frozenset(exact)
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]  # the edits that a word ending at this node tolerates, or -1
        self.begin: list[int] = [-1]
        self.most: list[int] = [0]
        for term in self.terms:
            node, word = 0, term.rstrip("*")
            edits = 0 if term in strict else allowed(word)
            self.most[0] = max(self.most[0], edits)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    for column, new in ((self.children, {}), (self.whole, -1), (self.begin, -1), (self.most, 0)):
                        column.append(new)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            at = self.begin if term.endswith("*") else self.whole
            at[node] = max(at[node], edits)
        self.alphabet = {c for d in self.children for c in d}
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.members: list[dict[int, int]] = []
        self.ends: list[int | None] = []
        self.begins: list[int | None] = []
        self.start = self.state({0: 0})

    def state(self, edits: dict[int, int]) -> int:
        """The number of the state where each trie node has been reached with so few edits."""
        todo = list(edits)
        while todo:  # leaving out a character of the term takes an edit and no character of the word
            node = todo.pop()
            for child in self.children[node].values():
                e = edits[node] + 1
                if e <= self.most[child] and e < edits.get(child, 99):
                    edits[child] = e
                    todo.append(child)
        key = frozenset(edits.items())
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.moves.append({})
            self.members.append(edits)
            self.ends.append(min((e for n, e in edits.items() if e <= self.whole[n]), default=None))
            self.begins.append(min((e for n, e in edits.items() if e <= self.begin[n]), default=None))
        return self.states[key]

    def move(self, state: int, c: str) -> int:
        """The state after one more character of the word, or -1 if no term can follow."""
        out: dict[int, int] = {}
        for node, e in self.members[state].items():
            if e < self.most[node]:
                out[node] = min(out.get(node, 99), e + 1)  # a character too many
            for label, child in self.children[node].items():
                cost = e + (label != c)
                if cost <= self.most[child]:
                    out[child] = min(out.get(child, 99), cost)
        self.moves[state][c] = found = self.state(out) if out else -1
        return found

    def match(self, word: str) -> int | None:
        state, best = self.start, None
        for c in word:
            c = c if c in self.alphabet else "\0"
            to = self.moves[state].get(c)
            state = self.move(state, c) if to is None else to
            if state < 0:
                return best
            begun = self.begins[state]
            if begun is not None and (best is None or begun < best):
                if not begun:
                    return 0
                best = begun
        end = self.ends[state]
        return best if end is None else end if best is None else min(best, end)


class Words(dict):
    """Edits by word, for the words met lately."""

    def __init__(self, lexicon: Lexicon, limit: int = 300_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        edits = self.lexicon.match(word)
        self[word] = found = -1 if edits is None else edits
        return found


def quoted(text: str, start: int, end: int, window: int = WINDOW) -> bool:
    """Whether quotation marks open before and close after, both within the window and on one line, or
    the text line is itself a quotation."""
    left, right = text[max(0, start - window) : start].rpartition("\n")[2], text[end : end + window].partition("\n")[0]
    return any(left.count(a) % 2 == 1 and b in right if a == b else left.rfind(a) > left.rfind(b) and b in right for a, b in QUOTES.items())


def hits(text: str, words: Words, window: int = WINDOW) -> tuple[float, float, float]:
    """Weight of exact hits, of misspelled hits, and of quotations among them."""
    low = text.lower()
    if max(map(words.__getitem__, set(WORD.findall(low))), default=-1) < 0:
        return 0.0, 0.0, 0.0
    exact = near = quotes = 0.0
    for m in WORD.finditer(low):
        edits = words[m.group()]
        if edits < 0:
            continue
        around = {*WORD.findall(low[max(0, m.start() - window) : m.start()]), *WORD.findall(low[m.end() : m.end() + window])}
        weight = 1.5 if around & SECOND else 1.0
        if quoted(low, m.start(), m.end(), window):
            quotes += weight
        elif around & REPORTING:
            quotes += weight / 2
            exact, near = exact + weight / 2 * (edits == 0), near + weight / 2 * (edits > 0)
        else:
            exact, near = exact + weight * (edits == 0), near + weight * (edits > 0)
    return exact, near, quotes


def features(found: np.ndarray) -> np.ndarray:
    """Columns: any exact hit and how many, the same for misspelled ones and quotations, and 1."""
    return np.column_stack([f(found[:, k]) for k in range(3) for f in (lambda x: np.minimum(x, 1), lambda x: np.log1p(np.minimum(x, 20)))] + [np.ones(len(found))])


#: What the weights are drawn to where labels don't tell.
PRIOR = np.array([3.0, 1.0, 1.5, 1.0, 0.3, 0.2, -3.0])


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    exact: tuple[str, ...]
    weights: tuple[float, ...]

    def scores(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-features(found) @ np.array(self.weights))) if self.terms else np.zeros(len(found))


def entries(text: str) -> set[str]:
    """What a text could add to the lexicon: words, of those over LONGEST characters beginnings alone, and beginnings."""
    words = {w for w in WORD.findall(text.lower()) if not w.isdigit()}
    return {*(w for w in words if len(w) <= LONGEST), *(w[:k] + "*" for w in words for k in PREFIXES if len(w) > k)}


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that have a term: sums over each slice."""
    for b in slices(batches):
        n: tuple[Counter, Counter] = Counter(), Counter()
        for y, text in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
            n[y].update(entries(text))
        terms = list(n[0] | n[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], ["term", "pos", "neg"])


def chosen(counts: dict[str, int], having: list[list[str]], least: float) -> list[str]:
    """Terms that explain the toxic documents, each given by the candidates it has: again and again the
    one that covers most of what the others leave, as long as that is `least`. Words that toxic documents merely share, as near
    copies do, add little beside the terms that make them toxic."""
    where: dict[str, list[int]] = {}
    for k, terms in enumerate(having):
        for t in terms:
            where.setdefault(t, []).append(k)
    left = np.ones(len(having))
    docs = {t: np.array(ks) for t, ks in where.items()}
    heap = [(-float(len(ks)), -counts[t], -len(t), t) for t, ks in docs.items()]  # lazily updated: gains only fall
    heapq.heapify(heap)
    kept: list[str] = []
    while heap:
        _, pos, size, term = heapq.heappop(heap)
        gain = float(left[docs[term]].sum())
        if gain < least:
            continue
        if heap and -heap[0][0] > gain + 1e-9:
            heapq.heappush(heap, (-gain, pos, size, term))
            continue
        near = [t for t in docs if t.startswith(term.rstrip("*")) and len(docs[t]) >= 0.9 * len(docs[term])]
        term = max(near, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t))  # as long as it says the same
        if term not in kept:
            kept.append(term)
        left[docs[term]] *= SEEN
    return kept


def lexicon(sample: DataFrame, size: dict[int, int], candidates_: int = CANDIDATES) -> list[str]:
    """The terms of a sample (y, text) with so many rows of each class. Where more than candidates_ terms come into question,
    the choice goes on among the documents that none of the chosen terms is in, until nothing more can be chosen."""
    kept: list[str] = []
    rate = lambda n, y: (F.col(n) + 0.5) / (size[y] + 1)
    while True:
        done = frozenset(kept)

        def left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True)
                yield b.filter(pa.array([y == 0 or done.isdisjoint(entries(text)) for y, text in rows], pa.bool_()))

        rows = sample.mapInArrow(left, "y int, text string") if kept else sample
        counts = rows.mapInArrow(_terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        strong = counts.where((F.col("pos") >= MIN_DOCS) & (rate("pos", 1) / rate("neg", 0) >= MIN_LIFT)).orderBy(F.desc("pos"), "term").limit(candidates_)
        counted = {r.term: r.pos for r in strong.collect()}

        def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield pa.RecordBatch.from_arrays([pa.array([[t for t in entries(text) if t in counted] for text in b.column("text").to_pylist()], pa.list_(pa.string()))], ["terms"])

        having = rows.where("y = 1").mapInArrow(candidates, "terms array<string>").where(F.size("terms") > 0)
        new = chosen(counted, [r.terms for r in having.collect()], max(MIN_DOCS - 1, MIN_SHARE * size[1])) if counted else []
        kept += new
        if not new or len(counted) < candidates_:
            return kept


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, candidates_: int = CANDIDATES) -> Model:
    """A model from about per_class labelled documents of each class at most, read by Spark, which also bounds the terms
    that come to the driver, candidates_ at a time. Scoring has no such bounds."""
    sample, stands_for = labelled_sample(docs, labels, label, held_out, per_class, id_col, text_col)
    if not stands_for:
        return Model((), (), ())
    sample = sample.dropDuplicates(["text"]).persist()
    try:
        size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(size) < 2:
            return Model((), (), ())
        terms = lexicon(sample, size, candidates_)

        def misspelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Near hits by term in documents that aren't toxic."""
            each = {t: Lexicon([t]) for t in terms if allowed(t.rstrip("*"))}
            every = Words(Lexicon(terms))
            for b in slices(batches):
                n: Counter = Counter()
                for text in b.column("text").to_pylist():
                    near = [w for w in set(WORD.findall(text.lower())) if every[w] > 0]
                    n.update({t for t, own in each.items() if any(own.match(w) for w in near)})
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

        common = sample.where("y = 0").mapInArrow(misspelled, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") > max(1, 0.0005 * size[0]))
        exact = tuple(sorted(r.term for r in common.collect()))

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words(Lexicon(terms, exact))
            for b in slices(batches):
                found = np.array([hits(t, words) for t in b.column("text").to_pylist()]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array(np.minimum(found[:, k], 20)) for k in range(3))], ["y", "exact", "near", "quotes"])

        table = sample.mapInArrow(count, "y int, exact double, near double, quotes double").groupBy("y", "exact", "near", "quotes").agg(F.count("*").alias("n")).collect()
    finally:
        sample.unpersist()
    x = features(np.array([[r.exact, r.near, r.quotes] for r in table]))
    y = np.array([r.y for r in table], float)
    n = np.array([r.n * stands_for[r.y] for r in table])
    w = PRIOR.copy()
    for _ in range(50):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (n * (y - p)) - (w - PRIOR)
        w += np.clip(np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient), -2, 2)
    w[:6] = np.maximum(w[:6], 0)
    return Model(tuple(terms), exact, tuple(w.tolist()))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a column of scores, all others as they were."""
    kept = docs.schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Lexicon(model.terms, model.exact))
        for b in slices(batches):
            found = np.array([hits(t or "", words) for t in b.column(text_col).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(model.scores(found))], [*kept, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
