"""Toxicity scores from a fuzzy lexicon in context.

The lexicon is learned from labelled training rows: words and stems that stand in many distinct contexts of toxic
documents and in few of clean ones (contexts, not documents, so that copies of one toxic text add nothing). Its trie is
intersected with Levenshtein automata, made deterministic as words are read: a state is the set of (trie node, edits)
that the letters so far allow, and most words die after a few letters. Each hit is weighed in its sentence, as far as a
window of words reaches: it is a quotation if an opening mark before it and the closing mark that belongs to it stand
around it, or if a word of reporting does without marks; address in the second person outside those marks makes it
abuse. An apostrophe, or marks around other words, quote nothing. A logistic regression over these counts gives the score.

Defined results: null and empty texts have no hits and get the score of a text without any; labels of unknown documents,
null labels and labels other than 0 and 1 are not used, and of several labels of a document the highest counts; with no
toxic (or no clean) training row the lexicon is empty and every score is the smoothed rate of label 1; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored. The lexicon has no limit of its own; the
bounded sample that it is learned from bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import by_row, materialize, text_chunks

#: Opening marks, with the marks that close them.
CLOSING = {'"': '"', "'": "'", "`": "`'", "«": "»", "»": "«", "‹": "›", "›": "‹", "“": "”", "„": "“”", "‚": "‘’", "‘": "’", "”": "”", "’": "’"}
QUOTES = "".join(CLOSING)
PUNCTUATION = QUOTES + ".,;:!?()[]{}<>|/\\-–—_…"
SENTENCE_ENDS = ".!?…"
#: Verbs and nouns of reporting, and second-person address.
REPORTING = {"said", "says", "quote", "quoted", "called", "wrote", "writes", "word", "term", "sagte", "sagt", "schrieb", "wort", "dit", "écrit", "mot", "dijo", "dice", "escribió", "palabra"}
ADDRESS = {"you", "your", "you're", "ur", "u", "du", "dich", "dir", "dein", "tu", "toi", "te", "ton", "vous", "tú", "ti", "usted"}
EXACT, STEM, FUZZY = 1, 2, 3
FEATURES = 8


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class FuzzyTrie:
    """The trie of words and stems, read together with the Levenshtein automata of its words."""

    MOST_STATES = 100_000

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.edits, self.word, self.stem = [0], [-1], [False]  # edits that some word below allows; those of the word that ends here
        for term in words:
            self.word[self._node(term, edits_allowed(term))] = edits_allowed(term)
        for term in stems:
            self.stem[self._node(term, 0)] = True
        self._restart()

    def _node(self, term: str, edits: int) -> int:
        at = 0
        for c in term:
            self.edits[at] = max(self.edits[at], edits)
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({}), self.edits.append(0), self.word.append(-1), self.stem.append(False)
            at = self.children[at][c]
        self.edits[at] = max(self.edits[at], edits)
        return at

    def _restart(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of a set of nodes with the fewest edits of each; letters that the word leaves out are added. -1: dead, -2: a stem."""
        queue = list(reached.items())
        while queue:
            node, e = queue.pop()
            if reached[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.edits[child] and reached.get(child, 9) > e + 1:
                    reached[child] = e + 1
                    queue.append((child, e + 1))
        if not reached:
            return -1
        if any(e == 0 and self.stem[n] for n, e in reached.items()):
            return -2
        key = frozenset(reached.items())
        if (k := self.number.get(key)) is None:
            k = self.number[key] = len(self.sets)
            self.sets.append(key), self.next.append({})
            ends = [e for n, e in key if e <= self.word[n]]
            self.accepts.append(0 if not ends else EXACT if min(ends) == 0 else FUZZY)
        return k

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.edits[node] or e == 0:
                reached[node] = min(e, reached.get(node, 9))

        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                reach(child, e if letter == c else e + 1)
            reach(node, e + 1)
        to = self.next[state][c] = self._state(reached)
        return to

    def match(self, word: str) -> int:
        """0, EXACT, STEM or FUZZY."""
        if len(self.sets) > self.MOST_STATES:
            self._restart()
        state = self.start
        for c in word:
            to = self.next[state].get(c)
            if to is None:
                to = self._step(state, c)
            if to < 0:
                return STEM if to == -2 else 0
            state = to
        return self.accepts[state]


def marks_of(word: str) -> tuple[str, str]:
    """The quotation marks before a word's letters, and those after; marks that stand alone are both."""
    core = word.strip(PUNCTUATION)
    at = word.find(core) if core else len(word)
    before = "".join(c for c in word[:at] if c in QUOTES)
    return before, "".join(c for c in word[at + len(core) :] if c in QUOTES) if core else before


def quotation(words: list[str]) -> list[int]:
    """Of a sentence's words: the number of the quotation that each stands in, 0 for none. Marks that do not match quote nothing."""
    out, opened = [0] * len(words), None
    for i, w in enumerate(words):
        before, after = marks_of(w)
        alone = not w.strip(PUNCTUATION)
        closes = lambda: opened and any(c in opened[1] for c in after)  # noqa: B023, E731
        if before and not (alone and closes()):
            opened = (i, CLOSING[before[-1]])
            if alone:
                continue
        if closes():
            out[opened[0] : i + 1] = [opened[0] + 1] * (i + 1 - opened[0])
            opened = None
    return out


def sentence_around(words: list[str], i: int, window: int) -> tuple[int, int]:
    """The bounds of the words around one, up to the sentence's ends and ``window`` words to each side."""
    lo, hi = i, i + 1
    while lo > max(0, i - window) and not words[lo - 1].rstrip(QUOTES + ")]}").endswith(tuple(SENTENCE_ENDS)):
        lo -= 1
    while hi < min(len(words), i + window + 1) and not words[hi - 1].rstrip(QUOTES + ")]}").endswith(tuple(SENTENCE_ENDS)):
        hi += 1
    return lo, hi


def context_features(kinds: list[int], at: list[int], words: list[str], n: int, window: int) -> list[float]:
    """Of a document's hits (kinds and positions) among its n words."""
    plain, quoted, addressed, spots = [0, 0, 0], 0, 0, []
    for kind, i in zip(kinds, at, strict=True):
        lo, hi = sentence_around(words, i, window)
        own = words[lo:hi]
        inside = quotation(own)
        number = inside[i - lo]
        outside = {w.strip(PUNCTUATION) for w, k in zip(own, inside, strict=True) if not number or k != number}
        address = bool(outside & ADDRESS)
        if not address and (number or outside & REPORTING):
            quoted += 1
            continue
        plain[kind - 1] += 1
        addressed += address
        spots.append(i)
    densest, first = 0, 0
    for last, i in enumerate(spots):
        while i - spots[first] > 4 * window:
            first += 1
        densest = max(densest, last - first + 1)
    return [*(math.log1p(x) for x in (*plain, quoted, addressed, densest)), float(bool(spots)), min(1.0, 50 * len(spots) / max(1, n)) if n else 0.0]


def features(texts: pa.Array, trie: FuzzyTrie, window: int) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), FEATURES))
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    bounds = split.offsets.to_numpy()
    flat = split.values.dictionary_encode()
    codes, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
    kinds = np.fromiter((trie.match(w.strip(PUNCTUATION)) for w in distinct), np.int8, len(distinct))
    hits = kinds[codes] if len(codes) else np.empty(0, np.int8)
    where = np.flatnonzero(hits)
    of = np.searchsorted(bounds, where, side="right") - 1
    for doc in np.unique(of).tolist():
        lo, hi = int(bounds[doc]), int(bounds[doc + 1])
        at = where[of == doc] if len(where) < 64 else where[np.searchsorted(where, lo) : np.searchsorted(where, hi)]
        words = [distinct[k] for k in codes[lo:hi].tolist()]
        out[doc] = context_features(hits[at].tolist(), (at - lo).tolist(), words, hi - lo, window)
    return out


@dataclass
class ToxicityModel:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = 0.0
    window: int = 6

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and score (0 to 1)."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = FuzzyTrie(model.words, model.stems)
            for part in text_chunks(batches, "text"):
                z = features(part.column("text"), trie, model.window) @ np.array(model.weights) + model.bias
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 50) -> tuple[list[float], float]:
    """Weighted logistic regression with a ridge penalty, by Newton's method: weights and bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * weight.sum())
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b[:-1].tolist(), float(b[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000, min_contexts: int = 5, lift: float = 30.0, window: int = 6, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from ``docs`` that ``labels`` (doc_id, toxic) covers.

    The fit uses a bounded sample: about ``per_class`` documents of each label, chosen by a hash of doc_id, whole texts.
    """
    of = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = materialize(of.join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id"), "toxicity-labels")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = ToxicityModel(window=window)
    if len(counts) < 2:
        n, toxic = sum(counts.values()), counts.get(1, 0)
        model.bias = math.log((toxic + 0.5) / (n - toxic + 0.5))
        return model
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, per_class / n))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("y")] * (1 << 20))
    # at most about 2 * per_class ids, so they are broadcast
    sample = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id"), "toxicity-sample")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", 1 << 20):
            found = set()
            for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                words = [w.strip(PUNCTUATION) for w in (text or "").lower().split()]
                found.update((w, p, y) for w, p in zip(words, ["", *words], strict=False) if 3 <= len(w) <= 40)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.string(), pa.int32()), strict=True)], ["word", "before", "y"])

    seen = sample.mapInArrow(contexts, "word string, before string, y int").distinct()
    by_word = materialize(seen.groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")), "toxicity-words")
    totals = by_word.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()

    def strong(table: DataFrame) -> DataFrame:
        rate = F.col("bad") / F.lit(float(max(1, totals.bad or 0)))
        return table.where((F.col("bad") >= min_contexts) & (rate >= lift * (F.col("good") + 0.5) / F.lit(float(max(1, totals.good or 0))))).orderBy(F.desc("bad"), "word")

    prefixes = F.transform(F.sequence(F.lit(4), F.least(F.length("word"), F.lit(8))), lambda k: F.substring("word", 1, k))
    by_stem = by_word.where(F.length("word") >= 4).select(F.explode(prefixes).alias("word"), "bad", "good")
    by_stem = by_stem.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum((F.col("bad") > 0).cast("int")).alias("forms")).where("forms >= 3")
    model.words = [r.word for r in strong(by_word).select("word").collect()]
    model.stems = [r.word for r in strong(by_stem).select("word").collect()]
    words, stems = model.words, model.stems

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FuzzyTrie(words, stems)
        for part in text_chunks(batches, "text"):
            x = features(part.column("text"), trie, window)
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    # the bounded sample's few numbers
    rows = sample.select("text", "y").mapInArrow(measured, "y int, x array<double>").toPandas()
    if len(rows) and rows["y"].nunique() == 2:
        y = rows["y"].to_numpy()
        n = {k: int((y == k).sum()) for k in (0, 1)}
        weight = np.where(y == 1, counts[1] / n[1], counts[0] / n[0])
        weight = weight / weight.sum() * len(y)
        model.weights, model.bias = logistic(np.stack(rows["x"].to_numpy()), y, weight)
    return model


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **fit: object) -> DataFrame:
    """The documents that score under ``threshold``, with all their columns; rows may repeat a doc_id."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **fit)

    def judged(rows: DataFrame, ids: str) -> DataFrame:
        return model.score(rows, ids, text_col).select("doc_id", (F.col("score") < threshold).alias("kept"))

    return by_row(docs, materialize(judged(docs, id_col), "toxicity-verdicts"), lambda many, row: judged(many, row).where("kept").select(F.col("doc_id").alias(row)), id_col)
