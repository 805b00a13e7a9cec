"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model of the letters within words: raw counts at the highest order, the
number of distinct letters before at lower ones. All languages share sorted arrays of n-gram and context hashes, with
a column of probabilities and of back-off weights for each. A text goes to the language with the lowest cross-entropy
a letter; a temperature makes the gap to the others a probability, and a language's usual cross-entropies tell texts
that are like none (rejected).

The models come from a bounded sample: about ``docs_per_language`` labelled documents of each language, chosen by a hash
of doc_id, whole texts. So their size, and that of the broadcast, grows with the number of languages only. Every language
that a row names is learned, however rare; the calibration holds out rows of languages with ``ENOUGH`` of them only, so
that a rare one is not left without words.

Defined results: null texts and texts without a letter are ``und`` with score 0; without a training row all texts are;
null languages are not learned; ties go to the language first in alphabetical order; repeated rows are judged each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, text_chunks

ORDER = 5
#: Labelled rows of a language from which on a fifth of them calibrates.
ENOUGH = 10
START, STOP = 2, 3
#: Words whose scores a worker remembers.
CACHE_WORDS = 300_000
TEMPERATURES = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For all texts in turn: bounds, codes, and the distinct words (runs of letters, lower-cased; may hold an empty one)."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+")
    flat = split.values.dictionary_encode()
    return split.offsets.to_numpy().astype(np.int64), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Letters:
    """The words' letters, each word between START and STOP, with the hashes of the n-grams that end at each place."""

    word: np.ndarray
    depth: np.ndarray  # places since the word's START
    grams: list[np.ndarray]  # by order - 1; valid where depth >= order - 1

    @classmethod
    def of(cls, words: list[str], order: int) -> Letters:
        letters = np.frombuffer("".join(f"{chr(START)}{w}{chr(STOP)}" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        depth = np.arange(len(letters)) - starts[word] if len(words) else np.empty(0, np.int64)
        grams = [scramble(letters + np.uint64(1))]
        for n in range(2, order + 1):
            further = np.concatenate((np.zeros(n - 1, np.uint64), letters[: len(letters) - n + 1]))[: len(letters)]
            grams.append(scramble(grams[-1] ^ (further + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)))
        return cls(word, depth, grams)

    def context(self, n: int) -> np.ndarray:
        """The hash of the n-1 letters before each place; for the first order one for all."""
        return np.concatenate((np.zeros(1, np.uint64), self.grams[n - 2][:-1]))[: len(self.word)] if n > 1 else np.zeros(len(self.word), np.uint64)


@dataclass
class LanguageModels:
    languages: list[str]
    alphabet: int
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted hashes, discounted probabilities of each language
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted hashes, weights of the lower order
    temperature: float = 0.1
    usual: list[float] | None = None  # of each language, the cross-entropy that texts seldom exceed

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The log2 probability of each word in each language."""
        of, k = Letters.of(words, len(self.grams)), len(self.languages)
        places = np.flatnonzero(of.depth > 0)  # START itself is given
        p = np.full((len(places), k), 1.0 / self.alphabet)
        for n, ((keys, terms), (heads, weights)) in enumerate(zip(self.grams, self.contexts, strict=True), 1):
            deep = of.depth[places] >= n - 1
            at = places[deep]
            term, weight = np.zeros((len(at), k)), np.ones((len(at), k))
            for table, values, wanted, out in ((keys, terms, of.grams[n - 1][at], term), (heads, weights, of.context(n)[at], weight)):
                if len(table):
                    i = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
                    hit = table[i] == wanted
                    out[hit] = values[i[hit]]
            p[deep] = term + weight * p[deep]
        out = np.zeros((len(words), k))
        np.add.at(out, of.word[places], np.log2(p))
        return out


def kneser_ney(words: list[str], counts: np.ndarray, order: int) -> list[tuple[dict, dict]]:
    """Of one language and by order: n-gram hash to discounted probability, and context hash to the lower order's weight, as pairs of arrays."""
    of = Letters.of(words, order)
    weight = counts[of.word].astype(float)
    out = []
    for n in range(1, order + 1):
        at = np.flatnonzero((of.depth >= n - 1) & (of.depth > 0))
        gram, context = of.grams[n - 1][at], of.context(n)[at]
        if n == order:
            number = weight[at]
        else:
            # continuation: one for each distinct letter before; n-grams at a word's start have none and keep their counts
            inner = of.depth[at] >= n
            _, first = np.unique(of.grams[n][at[inner]], return_index=True)
            number = np.where(inner, 0.0, weight[at])
            number[np.flatnonzero(inner)[first]] = 1.0
        keys, where, back = np.unique(gram, return_index=True, return_inverse=True)
        total = np.bincount(back, number, len(keys))
        keys, heads, total = keys[total > 0], context[where][total > 0], total[total > 0]
        ones, twos = (total == 1).sum(), (total == 2).sum()
        discount = min(0.95, max(0.1, ones / (ones + 2.0 * twos))) if ones else 0.5
        heads, head_of = np.unique(heads, return_inverse=True)
        mass, types = np.bincount(head_of, total, len(heads)), np.bincount(head_of, None, len(heads))
        out.append(((keys, np.maximum(total - discount, 0) / mass[head_of]), (heads, np.minimum(1.0, discount * types / mass))))
    return out


def merged(tables: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in tables]))
    values = np.full((len(keys), len(tables)), missing)
    for i, (k, v) in enumerate(tables):
        values[np.searchsorted(keys, k), i] = v
    return keys, values.astype(np.float32)


class Scorer:
    """Scores texts; remembers words."""

    def __init__(self, model: LanguageModels):
        self.model, self.at, self.rows = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the log2 probability in each language, and its number of letters and word ends."""
        bounds, codes, distinct = words_of(texts)
        if len(self.at) + len(distinct) > CACHE_WORDS:
            self.at, self.rows = {}, self.rows[:0]
        new = [w for w in distinct if w and w not in self.at]
        if new:
            scores = [self.model.word_scores(new[i : i + 50_000]) for i in range(0, len(new), 50_000)]
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *scores]).astype(np.float32)
        place = np.fromiter((self.at[w] if w else 0 for w in distinct), np.int64, len(distinct))
        size = np.fromiter((len(w) + 1 if w else 0 for w in distinct), np.int64, len(distinct))
        length = size[codes]
        real = length > 0
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))[real]
        own = self.rows[place[codes[real]]]
        sums = np.stack([np.bincount(doc, own[:, j], len(texts)) for j in range(own.shape[1])], axis=1) if own.shape[1] else np.zeros((len(texts), 0))
        return sums, np.bincount(doc, length[real], len(texts)).astype(np.int64)


def decide(model: LanguageModels, sums: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best language's number, its score and its cross-entropy a letter."""
    best = sums.argmax(axis=1)
    z = (sums - sums.max(axis=1, keepdims=True)) * model.temperature * np.log(2)
    share = 1 / np.exp(z).sum(axis=1)
    entropy = -sums[np.arange(len(sums)), best] / np.maximum(letters, 1)
    return best, share, entropy


def fit_languages(docs: DataFrame, docs_per_language: int = 1000, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModels:
    """Learns from all rows of ``docs`` with a language."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = sorted(counts)
    empty = (np.empty(0, np.uint64), np.empty((0, len(languages)), np.float32))
    if not languages:
        return LanguageModels([], 1, [empty] * order, [empty] * order)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, docs_per_language / n))])
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20))
    sample = materialize(known.where(h < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 20)), "language-sample")
    # a fifth of the sample tells how sure to be
    rare = [lang for lang, n in counts.items() if n < ENOUGH]
    part = F.when(F.col("lang").isin(rare), 1).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(5)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", 4 << 20):
            bounds, codes, distinct = words_of(batch.column("text"))
            number = {lang: i for i, lang in enumerate(languages)}
            own = np.repeat([number[x] for x in batch.column("lang").to_pylist()], np.diff(bounds)).astype(np.int64)
            pairs, n = np.unique(own * len(distinct) + codes, return_counts=True)
            rows = [(languages[p // len(distinct)], distinct[p % len(distinct)], c) for p, c in zip(pairs.tolist(), n.tolist(), strict=True) if distinct[p % len(distinct)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    # the words of a bounded sample
    words = sample.where(part != 0).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toPandas()
    if not len(words):
        return LanguageModels([], 1, [empty] * order, [empty] * order)
    models = []
    for lang in languages:
        own = words[words["lang"] == lang]
        models.append(kneser_ney(own["word"].tolist(), own["n"].to_numpy(), order))
    alphabet = len(set("".join(words["word"]))) + 2
    model = LanguageModels(languages, alphabet, [merged([m[n][0] for m in models], 0.0) for n in range(order)], [merged([m[n][1] for m in models], 1.0) for n in range(order)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in text_chunks(batches, "text"):
            sums, letters = scorer.totals(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(sums), pa.list_(pa.float64())), pa.array(letters)], ["lang", "sums", "letters"])

    held = sample.where(part == 0).select("lang", "text").mapInArrow(measure, "lang string, sums array<double>, letters long").toPandas()
    held = held[held["letters"] > 0]
    if len(held):
        sums, letters = np.stack(held["sums"].to_numpy()), held["letters"].to_numpy()
        true = np.array([languages.index(x) for x in held["lang"]])
        gaps = (sums - sums.max(axis=1, keepdims=True)) * np.log(2)
        loss = [-(t * gaps[np.arange(len(true)), true] - np.log(np.exp(t * gaps).sum(axis=1))).mean() for t in TEMPERATURES]
        model.temperature = TEMPERATURES[int(np.argmin(loss))]
        entropy = -sums[np.arange(len(true)), true] / letters
        model.usual = [float(np.quantile(entropy[true == i], 0.99) * 1.25) if (true == i).any() else float("inf") for i in range(len(languages))]
    return model


def predict(docs: DataFrame, model: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, lang_pred, score, bits_per_letter, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names, usual = np.array([*shared.value.languages, "und"], object), np.array([*(shared.value.usual or [np.inf] * len(shared.value.languages)), np.inf])
        for batch in text_chunks(batches, "text"):
            n = batch.num_rows
            if len(names) > 1:
                sums, letters = scorer.totals(batch.column("text"))
                best, share, entropy = decide(shared.value, sums, letters)
                best, share = np.where(letters > 0, best, len(names) - 1), np.where(letters > 0, share, 0.0)
            else:
                best, share, entropy = np.zeros(n, int), np.zeros(n), np.zeros(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(share), pa.array(entropy), pa.array(entropy > usual[best])], ["doc_id", "lang_pred", "score", "bits_per_letter", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_letter double, rejected boolean")
