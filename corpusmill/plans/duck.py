"""Pieces of DuckDB SQL that the twins of several queries share."""

from __future__ import annotations

import re

from corpusmill.functions import fixed as K
from corpusmill.plans import golden
from corpusmill.plans.golden import quoted


def pattern(p: str) -> str:
    """A quoted RE2 pattern; word boundaries, which RE2 knows for ASCII only, are written out."""
    edge = r"[^\p{L}\p{N}_]"
    p = re.sub(r"\\b(?=[\w(])", lambda _: f"(?:^|{edge})", p)
    p = re.sub(r"\\b", lambda _: f"(?:{edge}|$)", p)
    return quoted(p)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normalize(x: str) -> str:
    return strip(rf"regexp_replace(replace({x}, chr(13), chr(10)), '[ \t\x{{3000}}]+', ' ', 'g')")


def matches(x: str, p: str) -> str:
    return f"regexp_extract_all({x}, {quoted(p)})"


def test(x: str, p: str) -> str:
    return f"regexp_matches({x}, {pattern(p)})"


def count(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(p)}))"


def words(items: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in items) + ")"


STOPS = words(K.STOP_WORDS)
KANA_PAIR = r"^[\x{3040}-\x{30FF}]{2}$"
WEAK_PAIR = f"^[{K.STOP_KANA}]{{2}}$"


def _pairs(run: str, keep: str) -> str:
    return f"list_filter(list_transform(range(1, length({run})), lambda i: substr({run}, i, 2)), lambda p: {keep})"


def terms(text: str) -> str:
    """The expression for a bag of search terms."""
    low = f"lower({normalize(text)})"
    latin = f"list_filter({matches(low, K.LATIN)}, lambda w: length(w) >= 2)"
    keep = f"NOT regexp_matches(p, '{WEAK_PAIR}')"
    cjk = f"flatten(list_transform({matches(low, K.CJK_RUN)}, lambda r: CASE WHEN length(r) > 1 THEN {_pairs('r', keep)} WHEN regexp_matches(r, '^[{K.STOP_KANA}]$') THEN [] ELSE [r] END))"
    runs = f"list_filter({matches(low, K.KANJI_KATAKANA_RUN)}, lambda r: length(r) BETWEEN 2 AND 12)"
    some = f"({latin} || {cjk} || {runs})"
    return rf"CASE WHEN len({some}) > 0 THEN {some} ELSE regexp_extract_all({low}, '[\p{{L}}\p{{N}}]') END"


def weight(t: str) -> str:
    return rf"CASE WHEN regexp_matches({t}, '^[\x{{3040}}-\x{{30FF}}]{{1,2}}$') THEN 0.4 WHEN {t} IN {STOPS} THEN 0.3 ELSE 1.0 END"


def is_phrase(t: str) -> str:
    return f"(regexp_matches({t}, {quoted('^(?:' + K.PHRASE + ')$')}) AND {t} NOT IN {STOPS})"


def phrases(text: str) -> str:
    low = f"lower({normalize(text)})"
    return rf"list_filter({matches(low, K.PHRASE_RUN)}, lambda w: CASE WHEN regexp_matches(w, '^[\x00-\x7F]+$') THEN length(w) >= 3 AND w NOT IN {STOPS} ELSE length(w) BETWEEN 2 AND 12 END)"


def strong(text: str) -> str:
    low = f"lower({text})"
    latin = f"list_filter({matches(low, K.LATIN)}, lambda w: length(w) >= 2 AND w NOT IN {STOPS})"
    keep = f"NOT regexp_matches(p, '{WEAK_PAIR}') AND NOT regexp_matches(p, '{KANA_PAIR}')"
    cjk = rf"flatten(list_transform({matches(low, K.CJK_RUN)}, lambda r: CASE WHEN length(r) > 1 THEN {_pairs('r', keep)} WHEN regexp_matches(r, '^[\x{{3040}}-\x{{30FF}}]$') OR regexp_matches(r, '^[{K.STOP_KANA}]$') THEN [] ELSE [r] END))"
    runs = f"list_filter({matches(low, K.KANJI_KATAKANA_RUN)}, lambda r: length(r) BETWEEN 2 AND 12)"
    return f"list_sort(list_distinct({latin} || {cjk} || {runs}))"


def content_key(text: str) -> str:
    return f"CASE WHEN len({strong(text)}) >= 4 THEN array_to_string({strong(text)}, chr(1)) END"


def junk(x: str) -> str:
    distinct = f"len(list_distinct(string_split({x}, '')))"
    return rf"""(length({x}) < 4 OR {count(x, r'[\p{L}\p{N}]')} / length({x}) < 0.55 OR {count(x, r'\p{Nd}')} / length({x}) > 0.4
      OR {count(x, K.JUNK_CHARACTERS)} > 2
      OR (length({x}) >= 12 AND CASE WHEN regexp_matches({x}, '^[\x00-\x7F]*$') THEN {distinct} < least(8.0, length({x}) / 6) ELSE {distinct} < length({x}) / 4 END))"""


def quality(x: str, has_fact: str | None = None) -> str:
    fact = f" + CASE WHEN {has_fact} THEN 0.15 ELSE 0 END" if has_fact else ""
    return rf"""greatest(0.0, least(1.0, 0.3 + CASE WHEN length({x}) BETWEEN 20 AND 160 THEN 0.2 WHEN length({x}) < 12 OR length({x}) > 300 THEN -0.15 ELSE 0 END
      + CASE WHEN {test(x, K.QUALITY_DEFINITION)} THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches({x}, '\p{{Nd}}') THEN 0.1 ELSE 0 END
      + 0.08 * least({count(x, K.QUALITY_PHRASE)}, 3){fact}))"""


def question(x: str) -> str:
    t = normalize(x)
    tails = "|".join(K.QUESTION_TAILS)
    return f"({t} <> '' AND (regexp_matches({t}, '(?:[?？]|{tails})$') OR string_split(lower({t}), ' ')[1] IN {words(K.QUESTION_WORDS)}))"


def question_type(x: str) -> str:
    whens = " ".join(f"WHEN {test(x, '(?i)' + p)} THEN '{n}'" for n, p in K.QUESTION_TYPES)
    return f"CASE {whens} WHEN {question(x)} THEN 'definition' ELSE 'none' END"


def keywords(x: str, limit: int = 6) -> str:
    """As a list; the stable order by length is kept by a rank in the sort key."""
    text = normalize(x)
    runs = f"list_filter({matches(text, K.KANJI_KATAKANA_RUN)}, lambda r: length(r) BETWEEN 2 AND 12)"
    latin = f"list_filter({matches(f'lower({text})', K.LATIN)}, lambda w: length(w) >= 3 AND w NOT IN {STOPS} AND NOT regexp_matches(w, '^[0-9]+$'))"
    both = f"({runs} || {latin})"
    ranked = f"list_sort(list_filter(list_transform({both}, lambda w, i: {{'n': -length(w), 'i': i, 'w': w}}), lambda s: list_position({both}, s.w) = s.i))"
    return f"list_transform({ranked}[1:{limit}], lambda s: s.w)"


def sentences(of: str = "documents", also: list[str] | None = golden.TEXTS, where: str = "TRUE") -> str:
    """CTEs that end in ``sentences`` (doc_id, pos, source, text)."""
    more = f" UNION ALL SELECT i, t, 'golden' FROM ({golden.values(also)}) g(i, t)" if also else ""
    abbreviated = "|".join(K.ABBREVIATIONS)
    marked = f"regexp_replace(t, '([{K.MARKS}])', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, chr(1) || '([{K.CLOSERS_AFTER_MARK}])', '\\1', 'g')"
    marked = f"regexp_replace({marked}, '\\.(\\s+[A-Z0-9])', '.' || chr(1) || '\\1', 'g')"
    marked = f"regexp_replace({marked}, '((?:{abbreviated})\\.)' || chr(1), '\\1', 'g')"
    marked = f"regexp_replace({marked}, '\\n+', chr(1), 'g')"
    return f"""
texts AS (SELECT doc_id, text, source FROM {of} WHERE {where}{more}),
cut AS (SELECT doc_id, source, string_split({marked}, chr(1)) AS p FROM (SELECT doc_id, source, {normalize('text')} AS t FROM texts)),
pieces AS (SELECT doc_id, source, i, {strip('s')} AS s FROM (SELECT doc_id, source, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM cut)),
led AS (
  SELECT doc_id, source, i, s, CASE WHEN regexp_matches(s, '^[{K.CLOSERS_LEADING}]') AND row_number() OVER (PARTITION BY doc_id ORDER BY i) > 1 THEN 0 ELSE 1 END AS starts
  FROM pieces WHERE length(s) >= 4
),
grouped AS (SELECT doc_id, source, i, s, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM led),
sentences AS (SELECT doc_id, CAST(g - 1 AS BIGINT) AS pos, source, string_agg(s, '' ORDER BY i) AS text FROM grouped GROUP BY doc_id, source, g)"""
