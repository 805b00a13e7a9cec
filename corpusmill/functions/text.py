"""Text functions as columns: normalising, sentences, tokens, search terms, phrases, and predicates on sentences.

All but ``nfkc`` are built-in expressions that stay in the JVM. Normalising to NFKC has no built-in; it is done once,
when text enters the corpus (``sources``), and skips batches of plain ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.functions import fixed as K

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for each row; an alias could be inlined into a lambda and computed for each element."""
    return F.transform(F.array(value), body).getItem(0)


def strings() -> Column:
    return F.array().cast("array<string>")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC form of each text."""
    return text.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def strip(c: Text) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def normalize(c: Text) -> Column:
    """Blanks and line ends of a text that is in NFKC form."""
    return strip(F.regexp_replace(F.replace(col(c), F.lit("\r"), F.lit("\n")), r"[ \t\x{3000}]+", " "))


def all_matches(c: Text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), group)


def split_sentences(c: Text) -> Column:
    """The sentences of a text, in order."""
    not_abbreviated = "".join(rf"(?<!{a}\.)" for a in K.ABBREVIATIONS)
    at = rf"(?<=[{K.MARKS}])(?![{K.CLOSERS_AFTER_MARK}])\s*|(?<=\.){not_abbreviated}\s+(?=[A-Z0-9])|\n+"
    pieces = F.filter(F.transform(F.split(normalize(c), at), strip), lambda s: F.length(s) >= 4)
    leads = rf"^[{K.CLOSERS_LEADING}]"

    def join(done: Column, s: Column) -> Column:
        last = F.size(done)
        onto = F.concat(F.slice(done, 1, last - 1), F.array(F.concat(F.element_at(done, -1), s)))
        return F.when((last > 0) & s.rlike(leads), onto).otherwise(F.concat(done, F.array(s)))

    # few texts have a piece that belongs to the one before it
    joined = F.transform(F.array(pieces), lambda p: F.when(F.exists(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda s: s.rlike(leads)), F.aggregate(p, strings(), join)).otherwise(p))
    return joined.getItem(0)


def tokenize(c: Text) -> Column:
    """Words, and all else by character, lower-cased."""
    return all_matches(F.lower(normalize(c)), K.WORD)


def detokenize(tokens: Text) -> Column:
    """Joins tokens; blanks go between Latin words and after Western punctuation only."""
    latin = rf"^(?:{K.LATIN})$"
    seed = F.struct(F.lit("").alias("s"), F.lit(False).alias("latin"), F.lit("").alias("last"))

    def add(a: Column, t: Column) -> Column:
        spaced = t.rlike(latin) & (a["latin"] | a["last"].isin(*",.;:!?"))
        return F.struct(F.concat(a["s"], F.when(spaced & (a["s"] != ""), " ").otherwise(""), t).alias("s"), t.rlike(latin).alias("latin"), t.alias("last"))

    return F.aggregate(F.filter(col(tokens), lambda t: ~t.isin("<s>", "</s>")), seed, add, lambda a: a["s"])


def _weak_pair(pair: Column) -> Column:
    return pair.rlike(f"^[{K.STOP_KANA}]{{2}}$")


def terms(c: Text) -> Column:
    """Search terms, repeats included: Latin words, CJK pairs and runs; the letters and digits of a text without any."""
    return let(F.lower(normalize(c)), _terms)


def _terms(low: Column) -> Column:
    latin = F.filter(all_matches(low, K.LATIN), lambda w: F.length(w) >= 2)

    def pairs(run: Column) -> Column:
        some = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2))), lambda p: ~_weak_pair(p))
        return F.when(F.length(run) > 1, some).when(run.rlike(f"^[{K.STOP_KANA}]$"), strings()).otherwise(F.array(run))

    cjk = F.flatten(F.transform(all_matches(low, K.CJK_RUN), pairs))
    runs = F.filter(all_matches(low, K.KANJI_KATAKANA_RUN), lambda r: F.length(r).between(2, 12))
    some = F.when(low.rlike(r"[\x{3000}-\x{D7AF}]"), F.concat(latin, cjk, runs)).otherwise(latin)
    return let(some, lambda t: F.when(F.size(t) > 0, t).otherwise(all_matches(low, r"[\p{L}\p{N}]")))


def term_weight(t: Column) -> Column:
    kana = t.rlike(r"^[\x{3040}-\x{30FF}]{1,2}$")
    return F.when(kana, 0.4).when(t.isin(*K.STOP_WORDS), 0.3).otherwise(1.0)


def is_phrase(t: Column) -> Column:
    return t.rlike(f"^(?:{K.PHRASE})$") & ~t.isin(*K.STOP_WORDS)


def phrases(c: Text) -> Column:
    """Runs of kanji or katakana of 2 to 12, and Latin words of 3 letters or more, in order."""
    found = all_matches(F.lower(normalize(c)), K.PHRASE_RUN)
    latin = lambda w: w.rlike(r"^[\x00-\x7F]+$")
    return F.filter(found, lambda w: F.when(latin(w), (F.length(w) >= 3) & ~w.isin(*K.STOP_WORDS)).otherwise(F.length(w).between(2, 12)))


def keywords(c: Text, limit: int = 6) -> Column:
    """The longest distinct topic words; ties as they occur, CJK before Latin."""
    text = normalize(c)
    runs = F.filter(all_matches(text, K.KANJI_KATAKANA_RUN), lambda r: F.length(r).between(2, 12))
    latin = F.filter(all_matches(F.lower(text), K.LATIN), lambda w: (F.length(w) >= 3) & ~w.isin(*K.STOP_WORDS) & ~w.rlike("^[0-9]+$"))
    found = F.array_distinct(F.concat(runs, latin))
    ranked = F.transform(found, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(ranked), 1, limit), lambda r: r["w"])


def strong_terms(c: Text) -> Column:
    """The distinct informative terms of a normalised sentence, sorted."""
    low = F.lower(col(c))
    latin = F.filter(all_matches(low, K.LATIN), lambda w: (F.length(w) >= 2) & ~w.isin(*K.STOP_WORDS))

    def pairs(run: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
        some = F.filter(some, lambda p: ~_weak_pair(p) & ~p.rlike(r"^[\x{3040}-\x{30FF}]{2}$"))
        return F.when(F.length(run) > 1, some).when(run.rlike(rf"^[{K.STOP_KANA}]$|^[\x{{3040}}-\x{{30FF}}]$"), strings()).otherwise(F.array(run))

    cjk = F.flatten(F.transform(all_matches(low, K.CJK_RUN), pairs))
    runs = F.filter(all_matches(low, K.KANJI_KATAKANA_RUN), lambda r: F.length(r).between(2, 12))
    some = F.when(low.rlike(r"[\x{3000}-\x{D7AF}]"), F.concat(latin, cjk, runs)).otherwise(latin)
    return F.array_sort(F.array_distinct(some))


def content_key(c: Text) -> Column:
    """Equal for sentences with the same informative terms; null for fewer than four."""
    return let(strong_terms(c), lambda s: F.when(F.size(s) >= 4, F.array_join(s, "\x01")))


def content_key_of_terms(bag: Text) -> Column:
    """The other key, from a bag of search terms of weight one."""
    some = F.array_sort(F.array_distinct(F.filter(col(bag), lambda t: term_weight(t) >= 1.0)))
    return F.when(F.size(some) >= 4, F.array_join(some, "\x01"))


def share(c: Text, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)) / F.greatest(F.length(col(c)), F.lit(1))


def is_junk(c: Text) -> Column:
    t = col(c)
    n = F.length(t)
    distinct = F.size(F.array_distinct(F.split(t, "")))
    repeats = F.when(t.rlike(r"^[\x00-\x7F]*$"), distinct < F.least(F.lit(8.0), n / 6)).otherwise(distinct < n / 4)
    return (
        (n < 4)
        | (share(t, r"[\p{L}\p{N}]") < 0.55)
        | (share(t, r"\p{Nd}") > 0.4)
        | (F.regexp_count(t, F.lit(K.JUNK_CHARACTERS)) > 2)
        | ((n >= 12) & repeats)
    )


def sentence_quality(c: Text, has_fact: Column | None = None) -> Column:
    t = col(c)
    n = F.length(t)
    q = F.lit(0.3) + F.when(n.between(20, 160), 0.2).when((n < 12) | (n > 300), -0.15).otherwise(0.0)
    q = q + F.when(t.rlike(K.QUALITY_DEFINITION), 0.15).otherwise(0.0) + F.when(t.rlike(r"\p{Nd}"), 0.1).otherwise(0.0)
    q = q + F.least(F.regexp_count(t, F.lit(K.QUALITY_PHRASE)), F.lit(3)) * 0.08
    if has_fact is not None:
        q = q + F.when(has_fact, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))


def good_prose(c: Text, least: int = 40) -> Column:
    t = strip(c)
    n = F.length(t)
    marks = F.regexp_count(t, F.lit("[。！？.!?]"))
    ja, en = share(t, r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"), share(t, "[A-Za-z]")
    bad = (
        (n < least)
        | (F.regexp_count(t, F.lit(r"\x{FFFD}")) > n * 0.002)
        | (marks < F.greatest(F.lit(1), F.floor(n / 200)))
        | (share(t, r"\p{Nd}") > 0.25)
        | ((ja < 0.15) & (en < 0.40))
        | ((ja >= 0.15) & (n > 120) & (F.instr(t, "、") == 0) & (marks < 2))
    )
    return ~bad


def clean_field(c: Text) -> Column:
    t = strip(F.replace(F.coalesce(col(c), F.lit("")), F.lit("�"), F.lit("")))
    return F.when(F.lower(t).isin(*K.MISSING_FIELD), "").otherwise(t)


def is_question(c: Text) -> Column:
    t = normalize(c)
    tails = "|".join(K.QUESTION_TAILS)
    return (t != "") & (t.rlike(f"(?:[?？]|{tails})$") | F.split(F.lower(t), " ").getItem(0).isin(*K.QUESTION_WORDS))


def question_type(c: Text) -> Column:
    out = reduce(lambda w, p: w.when(col(c).rlike(f"(?i){p[1]}"), p[0]), K.QUESTION_TYPES, F)
    return out.otherwise(F.when(is_question(c), "definition").otherwise("none"))


def is_chatty(c: Text) -> Column:
    return F.lower(strip(c)).rlike(K.CHAT) | ~F.exists(keywords(c, 3), is_phrase)


def same_utterance(a: Text, b: Text) -> Column:
    plain = lambda x: F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{N}]", "")
    return plain(a) == plain(b)


def cjk_share(c: Text) -> Column:
    return share(c, r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]")


def is_redirect(c: Text) -> Column:
    head = F.lower(F.ltrim(F.substring(col(c), 1, 40)))
    return head.startswith("#redirect") | head.startswith("#転送")


def repeat_ratio(c: Text) -> Column:
    """The larger share of repeats among phrases (three at least) and character trigrams (six at least)."""
    grams = let(
        F.regexp_replace(col(c), r"\s+", ""),
        lambda p: F.when(F.length(p) >= 8, F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))).otherwise(strings()),
    )
    repeats = lambda a, least: let(a, lambda x: F.when(F.size(x) >= least, 1 - F.size(F.array_distinct(x)) / F.size(x)).otherwise(0.0))
    return F.greatest(repeats(phrases(c), 3), repeats(grams, 6))


def term_overuse(c: Text) -> Column:
    """How much one content word of a short text is used too often."""
    words = all_matches(c, r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]+|[\x{30A0}-\x{30FF}]{2,}")

    def of(w: Column) -> Column:
        top = F.array_max(F.transform(F.array_distinct(w), lambda x: F.size(F.filter(w, lambda y: y == x))))
        return F.when((F.size(w) < 5) | (top < 4) | (top / F.size(w) < 0.25), 0.0).otherwise(F.least(F.lit(1.0), (top - 3) / 3))

    return let(words, of)


def rerank_bonus(kind: Column, c: Text, subject: Column) -> Column:
    """How well a sentence fits the type of a question, 0 to 1."""
    t = col(c)
    head = F.substr(t, F.lit(1), F.length(subject) + 4)
    after = F.exists(F.array(*map(F.lit, ("とは", "は", "が", "、", "(", "（"))), lambda p: F.instr(F.regexp_replace(t, r"\s+", ""), F.concat(F.regexp_replace(subject, r"\s+", ""), p)) > 0)
    named = F.when(subject.isNotNull() & (subject != ""), F.when(F.instr(head, subject) > 0, 0.6).otherwise(0.0) + F.when(after, 0.4).otherwise(0.0)).otherwise(0.0)
    flag = lambda p, x: F.when(t.rlike(p), x).otherwise(0.0)
    return F.least(
        F.lit(1.0),
        F.when(kind == "definition", named + flag(K.BONUS_DEFINITION, 0.2))
        .when(kind == "when", flag(K.BONUS_YEAR, 1.0))
        .when(kind == "where", flag(K.BONUS_PLACE, 1.0))
        .when(kind == "howmany", F.when(t.rlike(K.BONUS_NUMBER), 1.0).otherwise(flag(r"\p{Nd}", 0.3)))
        .when(kind == "who", flag(K.BONUS_WHO, 0.8))
        .when(kind == "why", flag(K.BONUS_WHY, 0.8))
        .otherwise(0.0),
    )


def shorten(c: Text, limit: int) -> Column:
    """At most ``limit`` characters, or up to 40 more where a sentence ends there."""
    t = col(c)
    ended = F.regexp_extract(F.substring(t, 1, limit + 40), r"(?s)^.*[。！？.!?\n]", 0)
    return F.when(F.length(t) <= limit, t).when(F.length(ended) > 20, strip(ended)).otherwise(F.regexp_replace(F.substring(t, 1, limit), r"\s+$", ""))


def clean_operand(c: Text) -> Column:
    return F.regexp_replace(col(c), r"^[ 、,。.:：「」『』()（）]+|[ 、,。.:：「」『』()（）]+$", "")


def subject_key(c: Text) -> Column:
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit(""))


def clean_reply(c: Text) -> Column:
    """A reply without marks of formatting, cut before its first list item (or with two items, if it says nothing else)."""
    item = r"(?:[0-9]+[.)]|[-*・])"
    plain = F.regexp_replace(F.regexp_replace(col(c), r"\*+|__+|`+", ""), r"(?m)^\s*#{1,6}\s*", "")

    def cut(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(rf"\n\s*{item}\s*"))
        lead, rest = strip(F.substr(t, F.lit(1), at - 1)), F.substr(t, at)
        items = F.transform(F.filter(F.split(rest, "\n"), lambda x: strip(x) != ""), lambda x: strip(F.regexp_replace(x, rf"^\s*{item}\s*", "")))
        items = F.slice(F.filter(items, lambda x: F.length(x) >= 6), 1, 2)
        more = F.when(F.size(items) > 0, strip(F.concat(lead, F.lit(" "), F.array_join(items, " ")))).otherwise(lead)
        return F.when(at == 0, t).when(lead.rlike(K.HOLLOW) | (F.length(lead) < 25), more).otherwise(lead)

    short = let(plain, cut)
    tidy = strip(F.regexp_replace(F.regexp_replace(short, r"[ \t]+", " "), r"\n{2,}", "\n"))
    return F.when(tidy != "", tidy).otherwise(strip(c))


def clean_page_text(c: Text) -> Column:
    """Page text without menu lines."""
    lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(col(c), r"[ \t\x{3000}]+", " "), r"\n\s*\n+", "\n"), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= 20) | x.rlike("[。.!?！？]$")), "\n")


def character_grams(c: Text) -> Column:
    """Character pairs that neither start nor end with punctuation; the whole text if there are none."""

    def of(p: Column) -> Column:
        pairs = F.when(F.length(p) >= 2, F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substr(p, i, F.lit(2)))).otherwise(strings())
        kept = F.filter(pairs, lambda x: ~x.rlike("[、。，．,.!?！？「」『』()（）・]"))
        return let(kept, lambda k: F.when((F.size(k) == 0) & (p != ""), F.array(p)).otherwise(k))

    return let(F.regexp_replace(F.lower(col(c)), r"\s+", ""), of)


def key_match(key: Column, body: Column) -> Column:
    """Whether three characters in a row of ``key`` (all of a shorter one) occur in ``body``."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - 2, F.lit(1))), lambda i: F.substr(key, i, F.lit(3)))
    return F.exists(runs, lambda g: F.instr(body, g) > 0)


def host_of(source: Text) -> Column:
    """The host of a web source, else the source itself."""
    s = col(source)
    return F.when(s.startswith("http") & (F.size(F.split(s, "/")) >= 3), F.try_element_at(F.split(s, "/"), F.lit(3))).otherwise(s)


def source_name(source: Text) -> Column:
    """Host and the start of the last part of the path."""
    s = col(source)
    return F.when(s.startswith("http"), F.concat(F.try_element_at(F.split(s, "/"), F.lit(3)), F.lit("/"), F.substring(F.element_at(F.split(F.regexp_replace(s, "/+$", ""), "/"), -1), 1, 40))).otherwise(s)
