"""LM scores at any number of segments: every counted n-gram is entered, and the weights come from all training texts."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusmill.llm import lm_score


def level(c):
    """1 for one, then one more for each factor of 1.5."""
    q = 0
    while c and 1.5**q <= c + 1e-9:
        q += 1
    return q


def middle(q):
    if not q:
        return 0.0
    low = math.ceil(1.5 ** (q - 1) - 1e-9)
    return math.sqrt(low * max(low, math.ceil(1.5**q - 1e-9) - 1))


def brute_scores(texts, learn):
    """Deleted interpolation over quantised counts, token by token, without a filter's false positives."""
    split = {i: [*t.lower().split(), "\n"] for i, t in texts.items()}
    grams = lambda i: [(w[k - 2] if k > 1 else "\n" if k == 1 else None, w[k - 1] if k else "\n", w[k]) for w in [split[i]] for k in range(len(w))]
    one = Counter(w for i in learn for w in split[i])
    two = Counter((b, c) for i in learn for _, b, c in grams(i))
    three = Counter(g for i in learn for g in grams(i) if g[0] is not None)
    denominator = sum(one.values()) + 0.5 * (len(one) + 1)
    count = lambda c, less: max(0.0, middle(level(c)) - less)

    def part(c, of, less):
        return min(1.0, count(c, less) / count(of, less)) if count(of, less) > 0 else 0.0

    def parts(g, less):
        a, b, c = g
        low = (count(one[c], less) + 0.5) / denominator
        triple = (part(three[g], two[a, b], less), level(two[a, b])) if a is not None else (0.0, 0)
        return low, (part(two[b, c], one[b], less), level(one[b])), triple

    def fitted(rows):
        weights = defaultdict(lambda: 0.5)
        for _ in range(lm_score.ROUNDS):
            sums, sizes = defaultdict(float), Counter()
            for high, context, low in rows:
                w = weights[context]
                sums[context] += w * high / (w * high + (1 - w) * low)
                sizes[context] += 1
            weights = defaultdict(float, {c: sums[c] / (sizes[c] + 1) for c in sizes if c})
        return weights

    train = [parts(g, 1) for i in learn for g in grams(i)]
    pairs = fitted([(p, c, low) for low, (p, c), _ in train])
    mixed = [(10 ** (-round(-math.log10(pairs[c] * p + (1 - pairs[c]) * low) * lm_score.STEPS) / lm_score.STEPS), t) for low, (p, c), t in train]
    triples = fitted([(p, c, low) for low, (p, c) in mixed])

    def score(i):
        out = 0.0
        for g in grams(i):
            low, (p2, c2), (p3, c3) = parts(g, 0)
            out += math.log10(triples[c3] * p3 + (1 - triples[c3]) * (pairs[c2] * p2 + (1 - pairs[c2]) * low))
        return out

    return {i: score(i) for i in texts}


@pytest.mark.parametrize("size", [4 << 20, 700])
def test_scores_against_brute_force(make, monkeypatch, size):
    """With one segment and with many."""
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", size)
    monkeypatch.setattr(lm_score, "BITS_PER_ENTRY", 200)  # next to no false positives
    rng = np.random.default_rng(7)
    texts = {i: " ".join(f"t{int(x)}" for x in rng.zipf(1.4, 80) if x < 5000) for i in range(120)}
    texts |= {200 + i: f"once{i} pair{i} " * (1 + i % 2) for i in range(40)}
    texts |= {300 + i: texts[i] for i in range(0, 120, 3)} | {500: "", 501: "T1"}
    df = make(list(texts.items()))
    got = {r.doc_id: r.score for r in lm_score.lm_scores(df, df["doc_id"] % 5 != 1).collect()}
    want = brute_scores(texts, [i for i in texts if i % 5 != 1])
    assert got.keys() == want.keys()
    assert [(i, got[i], want[i]) for i in want if abs(got[i] - want[i]) > 1e-6 * abs(want[i])] == []
    # what was learned twice is likelier than what was learned once
    twice = [want[i] / len(texts[i].split()) for i in range(0, 120, 3) if i % 5 != 1 and (300 + i) % 5 != 1]
    once = [want[i] / len(texts[i].split()) for i in range(120) if i % 3 and i % 5 != 1]
    assert min(twice) > max(once)
