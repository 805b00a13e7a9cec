from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import pii
from corpusmill.llm.queries import QUERIES

from .conftest import ODD

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """The formats as they are written, by the regular expressions themselves."""
    text = text or ""
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.@@+-  01239()é%_\n"), max_size=60))
def test_base_spans_equal_the_formats(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "a.b@c.de", "x@y", "@z.com", "1.2.3.4", "256.1.1.1", "+1 (988) 555-2485", "+49", ".", " ", "0", "@", "é", "-"]), max_size=8))
def test_base_spans_of_joined_parts(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@" * 200_000, "+1" + " " * 200_000, "1." * 100_000, "a@" * 100_000):
        pii.base_spans(text)
        pii.further_spans(text, [])


def test_many_candidates_take_linear_time():
    import time

    text = "".join(f"call 0{i % 900 + 100}-555-{i % 9000 + 1000} " for i in range(50_000))
    t = time.time()
    spans = pii.further_spans(text, [])
    assert len(spans) == 50_000 and time.time() - t < 3
    for text in ("a" * 300_000, "ab1" * 100_000, "1-" * 150_000, "::" * 150_000, "one " * 80_000, "token=" * 50_000, "1 " * 150_000, "DE12 " * 60_000, "a at " * 60_000, "((" * 100_000):
        t = time.time()
        pii.further_spans(text, pii.base_spans(text))
        assert time.time() - t < 3, text[:6]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["555-123-4567", "a [at] b [dot] com", "::1", "fe80::1:2", "1[.]2[.]3[.]4", "4111.1111.1111.1112", "token = \"ab12cd34ef56ab12\"", "x@y.com", "+1 (988) 555-2485", "123-45-6789", " ", ".", "DE89 3704 0044 0532 0130 00", "five five five one two three four", "é"]), max_size=8))
def test_further_spans_against_brute_force(parts):
    """Of the wide patterns' matches, by start and length, those that overlap nothing taken before."""
    text = " ".join(parts)
    base, taken = pii.base_spans(text), []
    taken = [(s, e) for _, s, e in base]
    want = []
    for kind, s, e in sorted(pii.wider_matches(text), key=lambda x: (x[1], -x[2], x[0])):
        if all(e <= a or s >= b for a, b in taken):
            taken.append((s, e))
            want.append((kind, s, e))
    assert pii.further_spans(text, base) == want

def test_query_base_columns(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want, r = brute(d.text), got[d.doc_id]
        plain = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in range(4))
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert {*filter(None, plain.split(","))} <= {*r.spans.split(",")}


PLANTED = [
    ("phone", "call me: {} now", lambda r: f"{r.randint(200, 999)}-555-{r.randint(1000, 9999)}"),
    ("phone", "my mobile is {} today", lambda r: f"0{r.randint(150, 179)} {r.randint(1000, 9999)} {r.randint(1000, 9999)}"),
    ("phone", "phone {} please", lambda r: " ".join(r.choice(pii.DIGITS.split("|")) for _ in range(9))),
    ("email", "mail {} soon", lambda r: f"joe{r.randint(1, 99)} [at] example [dot] com"),
    ("email", "contact {} soon", lambda r: f"ann{r.randint(1, 99)} @ site.org"),
    ("ip", "server address {} is up", lambda r: f"2001:db8::{r.randrange(4096, 65535):x}:{r.randrange(4096, 65535):x}"),
    ("ip", "host {} was seen", lambda r: ".".join(str(r.randint(11, 250)) for _ in range(4)).replace(".", "[.]")),
    ("account", "iban {} for it", lambda r: "DE89 3704 0044 0532 0130 00"),
    ("secret", 'token = "{}" there', lambda r: f"{r.getrandbits(128):032x}"),
    ("secret", "the api_key: {} works", lambda r: "".join(r.choices("abcdefghijkLMNOPQRS0123456789", k=24)) + "7a"),
]
HARMLESS = [
    lambda r: f"version {r.randint(1, 9)}{r.randint(10, 99)}.{r.randint(100, 999)}.{r.randint(1000, 9999)} of it",
    lambda r: f"on {r.randint(10, 28)}-{r.randint(10, 12)}-{r.randint(1990, 2024)} they met",
    lambda r: f"order {r.randint(10**7, 10**9)} was sent",
    lambda r: f"1 2 {r.randint(10, 99)} {r.randint(100, 999)} {r.randint(1000, 9999)} 7 8",
    lambda r: f"at {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)} sharp",
    lambda r: f"commit {r.getrandbits(160):040x} in it",
    lambda r: f"pages {r.randint(100, 999)}-{r.randint(1000, 9999)} there",
    lambda r: f"see part{r.randint(100, 999)}-of-the-long-name{r.randint(10, 99)} there",
]


def planted(n, seed):
    """Documents of words with planted spans and harmless look-alikes, and the spans."""
    import random

    r, docs, spans = random.Random(seed), [], set()
    for i in range(n):
        text = " ".join(r.choices(["the", "house", "was", "red", "over", "there", "and", "so"], k=r.randint(5, 40)))
        for _ in range(r.randint(0, 2)):
            kind, frame, make = r.choice(PLANTED)
            body = make(r)
            at = len(text) + 1 + frame.index("{}")
            text += " " + frame.format(body)
            spans.add((i, kind, at, at + len(body)))
            text += " " + " ".join(r.choices(["then", "a", "long", "walk", "home"], k=6))
        for _ in range(r.randint(0, 2)):
            text += " " + r.choice(HARMLESS)(r) + " " + " ".join(r.choices(["then", "a", "long", "walk", "home"], k=6))
        docs.append((i, text))
    return docs, spans


def test_planted_spans_are_found_and_look_alikes_left(make):
    docs, want = planted(1500, 3)
    got = {(r.doc_id, f.kind, f.start, f.end) for r in pii.personal_data(make(docs)).collect() for f in r.found if not f.base}
    hit = len(got & want)
    print("precision", hit / len(got), "recall", hit / len(want), sorted((got ^ want))[:10])
    assert hit / len(got) > 0.9 and hit / len(want) > 0.9


def test_spans_are_base_spans_and_accepted_patterns(make):
    """The spans column against the scanners, the votes and the accepted set, document by document."""
    docs, _ = planted(300, 4)
    rows = pii.scanned(make(docs))
    ok = set(pii.accepted(rows))
    got = {r.doc_id: r for r in pii.personal_data(make(docs)).collect()}
    for i, text in docs:
        base = pii.base_spans(text)
        more = [x for x in pii.further_spans(text, base) if pii.pattern_of(x[0], pii.votes(text, x)) in ok]
        assert got[i].spans == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(base + more))
        assert got[i].n_spans == len(base) + len(more)


def test_odd_rows_and_further_spans(make):
    docs = [*ODD, (20, "call me: 555-123-4567 now"), (21, "mail joe [at] example [dot] com please"), (22, "version 555.123.4567")]
    docs += [(100 + i, f"write to a{i}@b.com or call +1 (988) 555-24{i:02}, card 4111 1111 1111 1111, ip 10.0.0.{i}") for i in range(30)]
    got = {r.doc_id: r for r in pii.personal_data(make(docs)).collect()}
    assert len(got) == len({i for i, _ in docs}) and got[1].spans == "" and got[6].n_email == 0
    assert got[20].spans == "phone:9:21" and got[20].n_phone == 0
    assert got[21].spans.startswith("email:5:") and got[22].spans == ""
    assert [f.kind for f in got[105].found] == ["email", "ip", "card", "phone"] and all(f.base for f in got[105].found)
    assert pii.personal_data(make(docs).limit(0)).collect() == []


def test_reliabilities_follow_agreement():
    good, bad, mixed = (pii.pattern_of(3, v) for v in ((1, 1, 0, 1, 0, 0), (-1, -1, -1, 0, -1, 0), (1, 1, 0, 0, 0, 0)))
    p = pii.estimate({good: 500}, {good: 50, bad: 300, mixed: 20})
    assert p[good] >= p[mixed] > 0.5 > 0.05 > p[bad]
    assert pii.votes_of(good) == (3, (1, 1, 0, 1, 0, 0))
