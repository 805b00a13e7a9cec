from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import language_id, lm_score, sharding, toxicity
from corpusmill.llm.queries import QUERIES, SHARDS

from .conftest import ODD


def tokens(t):
    return [*(t or "").encode().lower().split(), b"\n"]


def brute_base(docs, held_out):
    c = Counter(x for i, t in docs if not held_out(i) for x in tokens(t))
    total, distinct = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in tokens(t))) for i, t in docs}


def close(got, want):
    assert {i: g[:3] for i, g in got.items()} == {i: w[:3] for i, w in want.items()}
    assert all(math.isclose(got[i][3], want[i][3], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def columns(rows):
    return {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows}


def test_lm_query_base_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op5_lm_score"](spark, sf).collect()
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    close(columns(got), brute_base(docs, held_out))
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("size", [4 << 20, 3000])
def test_lm_odd_rows(make, monkeypatch, size):
    """Also with many segments."""
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", size)
    docs = list({i: (i, t) for i, t in [*ODD, *((50 + i, f"The a{i % 5} b{i}\u00a0c É {'the ' * i}") for i in range(40))]}.values())
    df = make(docs)
    got = lm_score.lm_scores(df, df["doc_id"] % 5 != 1).collect()
    close(columns(got), brute_base(docs, lambda i: i % 5 == 1))
    none = lm_score.lm_scores(df, df["doc_id"] < 0).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in none} == {(0, 0, 0.0)}
    assert lm_score.lm_scores(df.limit(0), df["doc_id"] > 0).collect() == []


def test_filter_levels():
    """All counts are read back within their level, but for few false positives, and unknown keys are seldom found."""
    rng = np.random.default_rng(5)
    keys, counts = np.unique(rng.zipf(1.3, 60_000) % 30_000, return_counts=True)
    keys = lm_score.mix(keys.astype(np.uint64))
    model = lm_score.LogFrequencyBloom({1: (keys, lm_score.levels(counts)), 2: (keys[:100], lm_score.levels(counts[:100]))})
    got = model.level(keys, 1)
    assert (got >= lm_score.levels(counts)).all() and (got == lm_score.levels(counts)).mean() > 0.97
    assert (model.level(lm_score.mix(np.arange(50_000, 90_000, dtype=np.uint64)), 1) > 0).mean() < 0.02
    assert model.level(keys, 3).max() == 0


def test_a_full_filter_still_answers():
    """With every bit set each key has the highest level; probing ends."""
    model = lm_score.LogFrequencyBloom({1: (np.arange(10, dtype=np.uint64), np.arange(1, 11))})
    model.bits[:] = 255
    assert (model.level(np.arange(1000, dtype=np.uint64), 1) == 10).all()


@pytest.mark.parametrize("width", [4, 8])
def test_planes(width):
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(0, 1 << (8 * width - 1), n).astype(np.uint64))
        assert (lm_score.from_sorted_planes(lm_score.sorted_planes(x, width), width) == x).all()
        assert (lm_score.from_planes(lm_score.planes(x, width), width) == x).all()


def test_placement(spark, make):
    table = sharding.lookup_table([f"s{i}" for i in range(7)], 997)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table([f"s{i}" for i in range(6)], 997)
    assert sum(a == b for a, b in zip(table, fewer, strict=True) if a < 6) > 0.8 * sum(a < 6 for a in table)
    heavy = Counter(sharding.lookup_table(["a", "b"], 997, {"a": 3}))
    assert abs(heavy[0] - 3 * heavy[1]) <= 4
    full = sharding.lookup_table(SHARDS)
    got = sharding.place(make([*ODD, (None, "x")]), SHARDS).collect()
    for r in got:
        slot = zlib.crc32(("null" if r.doc_id is None else str(r.doc_id)).encode()) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, SHARDS[full[slot]])
    assert len(got) == len(ODD) + 1
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def test_language_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_language_id"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and len(held) > 150
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_odd_rows(make):
    docs = [(i, f"the house and water number {w} there", "en") for i, w in enumerate(["one", "two", "three"] * 10)] + [(100 + i, f"das haus und wasser nummer {w} dort", "de") for i, w in enumerate(["eins", "zwei"] * 10)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !?", "de"), (903, "Das Haus", None), (904, "THE WATER " * 30_000, None), (905, "語語", None)]
    model = language_id.fit_languages(make(docs + odd))
    got = {r.doc_id: r for r in language_id.predict(make(odd + [(904, "the", None)]), model).collect() if r.doc_id != 904 or r.score}
    assert [got[i].lang_pred for i in range(900, 905)] == ["und", "und", "und", "de", "en"]
    assert got[900].score == 0 and got[905].lang_pred in ("de", "en") and got[905].rejected
    empty = language_id.fit_languages(make(docs).limit(0))
    assert {r.lang_pred for r in language_id.predict(make(odd), empty).collect()} == {"und"}
    assert language_id.predict(make(odd).limit(0), model).collect() == []


def test_kneser_ney_sums_to_one():
    """Over all letters that can follow, in each language."""
    words = ["abab", "abba", "ba", "b", "aab"]
    order = 3
    parts = language_id.kneser_ney(words, np.array([5, 1, 2, 1, 3]), order)
    model = language_id.LanguageModels(["x"], 3, [language_id.merged([p[0]], 0.0) for p in parts], [language_id.merged([p[1]], 1.0) for p in parts])
    # the chances of all words of up to 12 letters: what is missing is that of longer ones
    total, frontier = 0.0, [""]
    for _ in range(9):
        total += (2 ** model.word_scores([w for w in frontier if w])).sum() if any(frontier) else 0
        frontier = [w + c for w in frontier for c in "ab"]
    assert 0.8 < total <= 1.0001


def test_automata_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    import random

    rng = random.Random(6)
    terms, stems = ["abc", "abcde", "edcba", "aabbccddee", "bcdebcdebc"], ["ddd"]
    trie = toxicity.FuzzyTrie(terms, stems)
    for _ in range(6000):
        w = list(rng.choice(terms)) if rng.random() < 0.7 else rng.choices("abcde", k=rng.randint(0, 11))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w[i : i + rng.randint(0, 1)] = rng.choices("abcdex", k=rng.randint(0, 1))
        w = "".join(w)
        near = [distance(w, t) for t in terms if distance(w, t) <= toxicity.edits_allowed(t)]
        want = toxicity.STEM if w.startswith("ddd") else 0 if not near else toxicity.EXACT if min(near) == 0 else toxicity.FUZZY
        assert trie.match(w) == want, w


def test_context_parts_quotation_from_abuse():
    trie = toxicity.FuzzyTrie(["idiot"], [])
    x = toxicity.features(pa.array(["you are an idiot", 'he said "idiot" to them', "an idi0t", "", None, "fine"]), trie, 6)
    assert x[0, 0] > 0 and x[0, 4] > 0 and x[1, 0] == 0 and x[1, 3] > 0 and x[2, 2] > 0
    assert not x[3:].any()


ABUSE = ["you are an idiot and your \"work\" is bad", "you idiot, that's the dogs' bowl", 'you are an "idiot"', "the dogs' idiot' bowl", 'an idiot. he said "fine"', '"well" idiot "well"', "l'idiot"]
QUOTATION = ['he said "idiot" to them', 'he said "you idiot"', "they wrote „idiot“ there", "« un idiot »", "‘idiot’", "he called them an idiot", '("idiot")']


@pytest.mark.parametrize("text", ABUSE[:6])
def test_abuse_is_not_taken_for_quotation(text):
    x = toxicity.features(pa.array([text]), toxicity.FuzzyTrie(["idiot"], []), 6)
    assert x[0, 0] > 0 and x[0, 3] == 0


@pytest.mark.parametrize("text", QUOTATION)
def test_quotation_is_told_by_its_marks(text):
    x = toxicity.features(pa.array([text]), toxicity.FuzzyTrie(["idiot"], []), 6)
    assert x[0, 0] == 0 and x[0, 3] > 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_toxicity(text, model):
    """A text's score, word by word, by edit distances and a search for marks around each hit."""
    words = (text or "").lower().split()
    n, marks = len(words), toxicity.CLOSING
    core = lambda w: w.strip(toxicity.PUNCTUATION)
    counts, spots = {"exact": 0, "stem": 0, "fuzzy": 0, "quoted": 0, "addressed": 0}, []
    for i, w in enumerate(words):
        c = core(w)
        if any(c.startswith(s) for s in model.stems):
            kind = "stem"
        else:
            near = [edit_distance(c, t) for t in model.words if edit_distance(c, t) <= (0 if len(t) < 5 else 1 if len(t) < 10 else 2)]
            if not near:
                continue
            kind = "fuzzy" if min(near) else "exact"
        lo = i
        while lo > 0 and i - lo < model.window and words[lo - 1].rstrip(toxicity.QUOTES + ")]}")[-1:] not in {*".!?…"}:
            lo -= 1
        hi = i
        while hi + 1 < n and hi - i < model.window and words[hi].rstrip(toxicity.QUOTES + ")]}")[-1:] not in {*".!?…"}:
            hi += 1
        # the nearest word at or before the hit that opens, whose closing mark comes first at or after it
        span = set()
        for j in range(i, lo - 1, -1):
            lead = words[j][: words[j].find(core(words[j]))] if core(words[j]) else words[j]
            lead = [x for x in lead if x in marks]
            if lead:
                close = marks[lead[-1]]
                ends = [t for t in range(j, hi + 1) if any(x in close for x in (words[t][words[t].rfind(core(words[t])) + len(core(words[t])) :] if core(words[t]) else ""))]
                again = [t for t in range(i + 1, hi + 1) if any(x in marks for x in (words[t][: words[t].find(core(words[t]))] if core(words[t]) else words[t]))]
                if ends and ends[0] >= i and not any(t <= ends[0] and t > i for t in again):
                    span = set(range(j, ends[0] + 1))
                break
        outside = {core(words[t]) for t in range(lo, hi + 1) if t not in span}
        address = bool(outside & toxicity.ADDRESS)
        if not address and (span or outside & toxicity.REPORTING):
            counts["quoted"] += 1
            continue
        counts[kind] += 1
        counts["addressed"] += address
        spots.append(i)
    densest = max((sum(1 for y in spots if 0 <= y - x <= 4 * model.window) for x in spots), default=0)
    x = [math.log1p(v) for v in (*counts.values(), densest)] + [float(bool(spots)), min(1.0, 50 * len(spots) / n) if n else 0.0]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights)) + model.bias)))


def test_toxicity_scores_and_lexicon_against_brute_force(spark, make):
    import random
    from collections import defaultdict

    rng = random.Random(11)
    plain = [f"w{i}" for i in range(120)] + ["you", "said", "your."]
    bad = ["idiot", "blockhead", "numbskulls", "fooa", "foob", "fooc"]

    def text(toxic):
        words = rng.choices(plain, k=rng.randint(5, 40))
        for _ in range(rng.randint(1, 4) if toxic else rng.random() < 0.1):
            w = rng.choice(bad)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice("xyz") + w[at + 1 :]
            words.insert(rng.randrange(len(words)), rng.choice([w, w, f'"{w}"', f"'{w}", f"«{w}", f"{w}».", f"{w}!"]))
        return " ".join(words)

    docs = [(i, text(i % 3 == 0)) for i in range(400)] + [(900, None), (901, ""), (902, " ")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(make(docs), labels, lift=5.0)
    contexts = {(w, p, i % 3 == 0) for i, t in docs if i < 400 for words in [[w.strip(toxicity.PUNCTUATION) for w in t.lower().split()]] for p, w in zip(["", *words], words) if 3 <= len(w) <= 40}
    good, ill = Counter(w for w, _, y in contexts if not y), Counter(w for w, _, y in contexts if y)
    total = max(1, sum(ill.values())), max(1, sum(good.values()))
    listed = lambda b, g: b >= 5 and b / total[0] >= 5.0 * (g + 0.5) / total[1]
    assert sorted(model.words) == sorted(w for w in ill if listed(ill[w], good[w])) and model.words
    stems = defaultdict(lambda: [0, 0, 0])
    for w in {*good, *ill}:
        for k in range(4, min(8, len(w)) + 1) if len(w) >= 4 else ():
            stems[w[:k]] = [a + b for a, b in zip(stems[w[:k]], (ill[w], good[w], w in ill))]
    assert sorted(model.stems) == sorted(s for s, (b, g, forms) in stems.items() if forms >= 3 and listed(b, g))
    got = {r.doc_id: r.score for r in model.score(make(docs)).collect()}
    want = {i: brute_toxicity(t, model) for i, t in docs}
    assert [(i, got[i], want[i]) for i in got if abs(got[i] - want[i]) > 1e-9] == []


def test_language_models_against_brute_force(make):
    """Interpolated Kneser-Ney in dictionaries of strings; languages of few rows are learned, too."""
    import random
    from collections import defaultdict

    rng = random.Random(12)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "éfgha"}
    docs = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(1, 7))) for _ in range(12)), lang) for i, lang in enumerate(["aa", "bb"] * 9 + ["cc"])]
    docs += [(1000 + i, "zz zzz", f"rare{i:03}") for i in range(300)]
    model = language_id.fit_languages(make(docs))
    assert len(model.languages) == 303
    alphabet = len({c for _, t, _ in docs for c in t if c != " "}) + 2

    def learned(lang):
        words = Counter(w for _, t, x in docs if x == lang for w in t.split())
        tables = []
        for n in range(1, 6):
            raw, before = Counter(), defaultdict(set)
            for w, c in words.items():
                full = "^" + w + "$"
                for e in range(max(1, n - 1), len(full)):
                    g = full[e - n + 1 : e + 1]
                    if n == 5 or e - n + 1 == 0:
                        raw[g] += c
                    else:
                        before[g].add(full[e - n])
            number = {g: raw[g] + len(before[g]) for g in {*raw, *before}}
            ones, twos = (sum(v == k for v in number.values()) for k in (1, 2))
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            mass, types = Counter(), Counter()
            for g, v in number.items():
                mass[g[:-1]] += v
                types[g[:-1]] += 1
            tables.append((number, d, mass, types))
        return tables

    def bits(word, tables):
        full, out = "^" + word + "$", 0.0
        for e in range(1, len(full)):
            p = 1 / alphabet
            for n, (number, d, mass, types) in enumerate(tables, 1):
                if e - n + 1 < 0:
                    continue
                g = full[e - n + 1 : e + 1]
                if mass[g[:-1]]:
                    p = max(number.get(g, 0) - d, 0) / mass[g[:-1]] + min(1.0, d * types[g[:-1]] / mass[g[:-1]]) * p
            out += math.log2(p)
        return out

    tables = {lang: learned(lang) for lang in ("aa", "bb", "cc")}
    asked = [w for _, t, _ in docs[:19] for w in t.split()] + ["ace", "fgé", "q"]
    got = model.word_scores(asked)
    for lang, t in tables.items():
        want = [bits(w, t) for w in asked]
        assert np.allclose(got[:, model.languages.index(lang)], want, rtol=1e-4), lang
    rows = [(9000 + i, " ".join(rng.choices(asked[:-1], k=6))) for i in range(50)] + [(9100, None), (9101, "1 2")]
    entropy = {i: {lang: -sum(bits(w, t) for w in x.split()) for lang, t in tables.items()} for i, x in rows[:50]}
    for r in language_id.predict(make(rows), model).collect():
        if r.doc_id < 9100:
            best = min(entropy[r.doc_id], key=lambda x: (entropy[r.doc_id][x], x))
            assert r.lang_pred == best
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_placement_query_against_a_loop(spark, sf):
    """The table filled turn by turn with a set of taken slots, and every document looked up in it."""
    import xxhash

    size, claimed = sharding.TABLE_SIZE, {}

    def order(name):
        offset, step = xxhash.xxh64_intdigest(name, 1), xxhash.xxh64_intdigest(name, 2) % (size - 1) + 1
        return ((offset + j * step) % size for j in range(size))

    preferences = {s: order(s) for s in SHARDS}
    while len(claimed) < size:
        for s in SHARDS:
            if len(claimed) < size:
                claimed[next(x for x in preferences[s] if x not in claimed)] = s
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, zlib.crc32(str(i).encode()) % size, claimed[zlib.crc32(str(i).encode()) % size]) for i in ids)
    assert sorted(map(tuple, QUERIES["op6_sharding"](spark, sf).collect())) == want


def test_placement_odd_keys(spark):
    keys = spark.createDataFrame([("",), (None,), ("null",), ("x" * 100_000,), ("",)], "slot string")
    got = sharding.place(keys, SHARDS, "slot").collect()
    assert [c for c in got[0].asDict()] == ["key", "slot", "shard"]
    assert got[0] == got[4] and got[1].shard == got[2].shard
    assert sharding.place(keys.limit(0), SHARDS, "slot").collect() == []


def test_toxicity_query_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op8_toxicity"](spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    caught = [r for r in held if r.predicted]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(labels[r.doc_id] for r in caught) / len(caught) > 0.98
    assert sum(labels[r.doc_id] for r in caught) / sum(labels[r.doc_id] for r in held) > 0.85


def test_toxicity_odd_rows(spark, make):
    rng = np.random.default_rng(7)
    plain = [" ".join(f"w{int(x)}" for x in rng.integers(0, 300, 40)) for _ in range(200)]
    docs = [(i, f"{t[:60]} idiot {t[60:]} you idiot" if i % 4 == 0 else t) for i, t in enumerate(plain)]
    odd = [(900, None), (901, ""), (902, "you idiott!"), (903, 'he said "idiot"'), (904, "w1 " * 50_000), (905, "you idiot")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(0, 1, 0), (5000, 0, 1), (7, 0, None), (900, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(make(docs + odd), labels)
    assert "idiot" in model.words
    got = {r.doc_id: r.score for r in model.score(make(odd)).collect()}
    assert got[905] > 0.7 > got[903] and got[902] > got[900] == got[901] == got[904]
    kept = toxicity.keep_civil(make(docs + odd), labels)
    assert kept.columns == make(docs).columns and {r.doc_id for r in kept.collect()} >= {i for i in range(200) if i % 4} | {900, 901, 903, 904}
    nothing = toxicity.fit_toxicity(make(docs), labels.limit(0))
    assert {r.score for r in nothing.score(make(odd)).collect()} == {0.5}
    assert model.score(make(odd).limit(0)).collect() == []
