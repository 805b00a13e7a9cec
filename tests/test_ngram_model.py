"""Held-out counts against a loop, and how little of a text they exchange."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators import ngram_model, ngrams


def test_tokens_are_those_of_the_columns(spark):
    """Blanks beyond ASCII are tokens, and so are characters beyond the basic plane."""
    texts = ["a b　c\x0bd\x85e", "naïve İstanbul ΟΔΟΣ", "東京タワー 한국 😀x", "it's ’90s _x_ $5.00", "", "  \x1c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").select("seq", F.lower("text").alias("low"))
    for r in rows.select("low", T.all_matches("low", K.WORD).alias("t")).collect():
        assert ngram_model._WORD.findall(r.low) == r.t


def test_held_counts_of_odd_sentences(spark, monkeypatch):
    """Sentences without tokens, of one token, unseen contexts; in blocks of a few tokens; no row carries a sentence."""
    monkeypatch.setattr(ngram_model, "FLUSH", 7)
    learned = ["a b c", "a b d", "x", " ", "a b c a b c", "c"]
    held = ["a b c", "x y", " ", "d a"]
    rows = [(i, t, False) for i, t in enumerate(learned)] + [(100 + i, t, True) for i, t in enumerate(held)]
    got = ngram_model.held_counts(spark.createDataFrame(rows, "seq long, text string, held_out boolean"))
    assert "ids" not in got.columns and "text" not in got.columns
    counts = [Counter(), Counter(), Counter()]
    for t in learned:
        ids = ["<s>", *re.findall(r"\w", t), "</s>"]
        for n in range(3):
            if len(ids) - 1 >= (n + 1 if n else 1):
                counts[n].update((tuple(ids[i - n : i]), ids[i]) for i in range(max(n, 1), len(ids)))
    heads = [Counter(), Counter(), Counter()]
    for n in range(3):
        for (c, _), k in counts[n].items():
            heads[n][c] += k
    cont = Counter(t for _, t in counts[1])
    want = {}
    for j, t in enumerate(held):
        ids = ["<s>", *re.findall(r"\w", t), "</s>"]
        for i in range(1, len(ids)):
            p = (cont[ids[i]] + 1.0) / (sum(cont.values()) + len(counts[0]) + ngrams.SPECIALS)
            for n in (1, 2):
                c = tuple(ids[i - n : i])
                if i >= n and heads[n][c]:
                    types = sum(x == c for x, _ in counts[n])
                    p = max(counts[n][(c, ids[i])] - 0.75, 0) / heads[n][c] + 0.75 * types / heads[n][c] * p
            want[100 + j, i, ids[i]] = round(p, 9)
    assert {(r.seq, r.i, r.tok): round(r.p, 9) for r in got.select("seq", "i", "tok", ngram_model.probability(3, 0.75).alias("p")).collect()} == want
