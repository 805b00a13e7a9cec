"""Personal data by weak supervision.

Base spans (e-mail, IP, card and phone numbers by fixed formats) always count. Further candidates come from wide
patterns: addresses that are spaced, bracketed or written out, IPv6, numbers in other groupings or spelled out, numbers
of cards that fail their checksum, account and identity numbers, credentials. Most of what these patterns match is
harmless, so labelers vote on each candidate: a checksum or strict format, its shape, gazetteers (endings, prefixes,
country codes), cue words around it, words that speak against it, and whether it stands in a row of numbers.

Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability for each kind, without
labels; base spans take part as sure examples, at most as many as there are candidates of their kind. A logistic
classifier trained on the posteriors then decides on spans. It sees the kind and the votes only.

Texts are scanned once: spans and vote patterns go to a small table, whose patterns (at most 3^6 for each kind) are
counted on the executors; what the classifier accepts is a set of patterns, applied to that table.

Defined results: null and empty texts have no spans; a further candidate that overlaps a base span or an earlier one
(the longer, of those that start together) is left out; repeated rows are scanned each; an empty table gives an empty
result; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, text_chunks

#: The first four have base formats.
KINDS = ("email", "ip", "card", "phone", "account", "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Runs of digits are read once: a match that fails from the run's first digit fails from its others too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

DIGITS = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
#: Wider patterns: kind, what a text must hold for the pattern to be tried, pattern (its group 1, if any, is the span).
WIDER = [
    (0, "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?@ ?[A-Za-z0-9-]{1,63}(?: ?\. ?[A-Za-z0-9-]{1,63}){1,8}")),
    (0, "at", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[\[(] ?at ?[\])]|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]|(?<= )dot(?= )) ?[A-Za-z0-9-]{1,63}){1,8}")),
    (1, ":", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?=:)|(?=::))(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")),
    (1, ".", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}(?![0-9]|\.[0-9])")),
    (2, "", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:([ ./_-])[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9A-Za-z]|[.-][0-9])")),
    (2, "", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{13,19}(?![0-9A-Za-z]|[.-][0-9])")),
    (3, "", re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}\)?(?:[ ./-]\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z]|[./-][0-9])")),
    (3, "", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{7,12}(?![0-9A-Za-z]|[.-][0-9])")),
    (3, "e", re.compile(rf"\b(?:{DIGITS})(?:[ -](?:{DIGITS})){{6,14}}\b", re.I)),
    (4, "-", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])")),
    (4, "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (5, "", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,40}[0-9])(?=[0-9+/_-]{0,40}[A-Za-z])[A-Za-z0-9+/_-]{16,256}={0,2}(?![A-Za-z0-9+/_=-])")),
]
#: A value that is set, with or without quotes around it.
ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:token|secret|passwor[dt]|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|credential|contraseña|mot de passe|kennwort)s?[\"']? {0,2}[:=] {0,2}[\"']?([^\s\"'<>]{6,256})")
ASSIGNED_WORDS = ("token", "secret", "pass", "pwd", "key", "auth", "credential", "contraseña", "kennwort")
HAS_DIGIT = re.compile(r"[0-9]")
#: Gazetteers.
ENDINGS = {"com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "uk", "io", "eu", "it", "nl", "ch", "at", "us", "ca", "jp", "cn", "biz", "dev", "app"}
COUNTRIES = {"DE", "FR", "ES", "IT", "NL", "BE", "AT", "CH", "GB", "IE", "PT", "PL", "SE", "DK", "NO", "FI", "LU", "CZ"}
SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live", "pk_live", "xox", "eyJ", "AIza", "glpat-")
CUES = {
    "email": {"mail", "email", "e-mail", "contact", "write", "kontakt", "correo", "courriel", "schreiben", "escribe", "reach"},
    "ip": {"ip", "ipv4", "ipv6", "address", "server", "host", "login", "from", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte", "kreditkarte"},
    "phone": {"call", "phone", "tel", "telephone", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone", "appeler", "handy", "móvil", "portable", "dial", "sms", "whatsapp"},
    "account": {"iban", "account", "konto", "compte", "cuenta", "ssn", "security", "social", "bank", "passport", "ausweis"},
    "secret": {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "credentials", "kennwort", "passwort", "contraseña"},
}
AGAINST = {
    "version", "isbn", "issn", "order", "invoice", "total", "figure", "table", "page", "pages", "chapter", "section", "no", "id", "sha", "sha256", "md5", "commit", "checksum", "hash", "revision", "score", "date",
    "year", "pp", "vol", "doi", "part", "item", "sku", "uuid", "www", "http", "https",
}
WORD = re.compile(r"[^\W\d_][\w-]*")
#: Labelers: checksum or strict format, shape, gazetteer, cue words, words against, a row of numbers.
LABELERS = 6
#: How much each is believed before any text is seen: a checksum, and what stands around, say more than the looks of it.
BELIEF = np.array([2.0, 1.0, 1.0, 2.0, 3.0, 3.0])
#: The first three look at the same characters, so they share one witness's weight; no log-ratio is beyond MOST.
WITNESS = np.array([0.4, 0.4, 0.4, 1.0, 1.0, 1.0])
MOST = 4.0

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start: leftmost matches that do not overlap within a kind, less those that fail its test."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, done := m.end()))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def wider_matches(text: str) -> Iterator[Span]:
    digits = HAS_DIGIT.search(text) is not None
    for kind, needed, pattern in WIDER:
        # most patterns need a digit
        if needed in text and (digits or kind == 0 or needed == "e"):
            for m in pattern.finditer(text):
                s, e = m.span()
                if kind == 3 and needed != "e" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                    continue
                if kind == 5 and min(sum(c.isdigit() for c in m[0]), sum(c.isalpha() for c in m[0])) < 3:
                    continue
                yield kind, s, e
    low = text.lower()
    if any(w in low for w in ASSIGNED_WORDS):
        for m in ASSIGNED.finditer(text):
            yield 5, *m.span(1)


def further_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates of the wider patterns that overlap neither base spans nor each other, by their starts."""
    taken = sorted((s, e) for _, s, e in base)
    out: list[Span] = []
    at, busy, end = 0, 0, 0  # the next base span, where those before it end, where the last candidate ends
    for kind, s, e in sorted(wider_matches(text), key=lambda x: (x[1], -x[2], x[0])):
        while at < len(taken) and taken[at][0] <= s:
            busy = max(busy, taken[at][1])
            at += 1
        if s >= max(busy, end) and (at == len(taken) or taken[at][0] >= e):
            out.append((kind, s, e))
            end = e
    return out


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2


def iban_holds(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def own_votes(kind: int, body: str) -> tuple[int, int, int]:
    """Votes on the candidate itself: strict format, shape, gazetteer."""
    digits = "".join(c for c in body if c.isdigit() and c.isascii())
    if kind == 0:
        parts = [p for p in re.split(r"\s*(?:\.|[\[(]? ?dot ?[\])]?)\s*|[\s\[\]()]+", body.lower()) if p]
        marked = "@" in body or "[" in body or "(" in body
        return 1 if marked else -1, 1 if 6 <= len(body) <= 100 and body.count(" ") <= 4 else -1, 1 if parts and parts[-1] in ENDINGS else -1
    if kind == 1:
        if ":" in body:
            try:
                ipaddress.IPv6Address(body)
            except ValueError:
                return -1, -1, 0
            return 1, 1 if body.count(":") > 3 or "::" in body and len(body) > 6 else -1, 1 if body.lower().startswith(("2", "fe80", "fc", "fd")) else 0
        numbers = [int(x) for x in re.findall(r"[0-9]+", body)]
        return 1 if max(numbers) <= 255 else -1, 1 if "[" in body or "(" in body else 0, -1 if numbers[0] in (0, 127, 255) or max(numbers) < 10 else 0
    if kind == 2:
        return (1 if luhn(digits) else -1), (1 if len(set(digits)) > 3 else -1), (1 if digits[0] in "3456" else -1)
    if kind == 3:
        if not digits:
            return 1, 1, 0
        groups = re.findall(r"[0-9]+", body)
        grouped = len(groups) in (3, 4) and len(groups[-1]) in (3, 4)
        date = len(groups) == 3 and {len(g) for g in groups} <= {2, 4} and len(digits) in (6, 8)
        return (1 if grouped and not date else -1), (1 if 9 <= len(digits) <= 15 and not date else -1), (1 if body.startswith(("(", "0")) else -1 if len(set(digits)) < 3 else 0)
    if kind == 4:
        if body[0].isdigit():
            return (-1 if body[:3] in ("000", "666") or body[0] == "9" or body[4:6] == "00" else 1), 1, 0
        return (1 if iban_holds(body) else -1), (1 if 15 <= len(body.replace(" ", "")) <= 34 else -1), (1 if body[:2] in COUNTRIES else -1)
    mixed = sum(kind_of(x) != kind_of(y) for x, y in zip(body, body[1:], strict=False) if x.isalnum() and y.isalnum()) >= 0.2 * len(body)
    whole = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body) is not None and len(body) in (32, 40, 48, 56, 64, 96, 128)
    return (1 if whole or mixed and len(body) >= 20 and entropy(body) > 3.5 else -1 if len(body) < 12 or not mixed else 0), (1 if mixed and len(body) >= 16 else -1), (1 if body.startswith(SECRET_STARTS) else 0)


def votes(text: str, span: Span) -> tuple[int, ...]:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 none."""
    kind, s, e = span
    before = {w.lower() for w in WORD.findall(text[max(0, s - 48) : s])[-4:]}
    after = {w.lower() for w in WORD.findall(text[e : e + 30])[:2]}
    cues = CUES[KINDS[kind]]
    cue = 1 if before & cues or after & cues else 0
    against = -1 if before & AGAINST and not cue else 0
    # numbers on both sides are a row of a table
    row = -1 if kind in (2, 3, 4) and re.search(r"[0-9][ ,;\t]*$", text[max(0, s - 4) : s]) and re.match(r"[ ,;\t]*[0-9]", text[e : e + 4]) else 0
    return (*own_votes(kind, text[s:e]), cue, against, row)


def pattern_of(kind: int, vote: tuple[int, ...]) -> int:
    out = kind
    for v in vote:
        out = out * 3 + v + 1
    return out


def votes_of(pattern: int) -> tuple[int, tuple[int, ...]]:
    vote = []
    for _ in range(LABELERS):
        vote.append(pattern % 3 - 1)
        pattern //= 3
    return pattern, tuple(reversed(vote))


def estimate(sure: dict[int, int], candidates: dict[int, int], rounds: int = 40) -> dict[int, float]:
    """P(personal data) of each pattern, by expectation-maximisation of the labelers' reliabilities in each kind.

    ``sure`` counts the patterns of base spans, ``candidates`` those to be judged.
    """
    out = {}
    for kind in {votes_of(k)[0] for k in candidates}:
        keys, anchors = ([k for k in table if votes_of(k)[0] == kind] for table in (candidates, sure))
        n, a = np.array([candidates[k] for k in keys], float), np.array([sure[k] for k in anchors], float)
        a *= min(1.0, n.sum() / max(1.0, a.sum()))
        onehot = lambda ks: np.stack([np.array([votes_of(k)[1] for k in ks]).reshape(-1, LABELERS) == v for v in (-1, 0, 1)], axis=2).astype(float)
        v, known = onehot(keys), onehot(anchors)
        total = (v[:, :, 2] - v[:, :, 0]) @ (BELIEF * WITNESS) * 1.5
        p = np.clip(0.4 + 0.2 * total, 0.02, 0.98)  # a weighed majority to begin with
        # belief that labelers are better than chance, worth a twentieth of the candidates
        own = (1 + 0.05 * n.sum()) * BELIEF[:, None]
        belief1, belief0 = own * np.array([0.2, 1.0, 1.8]), own * np.array([1.8, 1.0, 0.2])
        for _ in range(rounds):
            w1, w0 = n * p, n * (1 - p)
            t1 = np.einsum("i,ijk->jk", w1, v) + np.einsum("i,ijk->jk", a, known) + belief1
            t0 = np.einsum("i,ijk->jk", w0, v) + belief0
            ratio = np.log(t1 / t1.sum(axis=1, keepdims=True) / (t0 / t0.sum(axis=1, keepdims=True)))
            # a vote for never counts against, nor the reverse
            ratio[:, 2], ratio[:, 0], ratio[:, 1] = np.maximum(ratio[:, 2], 0), np.minimum(ratio[:, 0], 0), 0
            ratio = np.clip(ratio, -MOST, MOST) * WITNESS[:, None]
            # even odds before any vote: odds that are learned, too, drift until one class takes all
            z = np.einsum("ijk,jk->i", v, ratio)
            p = np.clip(1 / (1 + np.exp(-z)), 1e-4, 1 - 1e-4)
        out |= dict(zip(keys, p.tolist(), strict=True))
    return out


def design(patterns: list[int]) -> np.ndarray:
    """Features of patterns: the kind, each vote for and each against, and how many speak for it."""
    out = []
    for kind, v in map(votes_of, patterns):
        out.append([*(float(kind == k) for k in range(len(KINDS))), *(float(x > 0) for x in v), *(float(x < 0) for x in v), float(sum(v))])
    return np.array(out).reshape(len(patterns), len(KINDS) + 2 * LABELERS + 1)


def train(counts: dict[int, int], posteriors: dict[int, float], rounds: int = 200) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the posteriors, patterns weighed by their counts, kinds alike."""
    keys = list(counts)
    x = design(keys)
    if not keys:
        return np.zeros(x.shape[1])
    n, y, w = np.array([counts[k] for k in keys], float), np.array([posteriors[k] for k in keys]), np.zeros(x.shape[1])
    kinds = x[:, : len(KINDS)]
    n /= kinds @ (kinds.T @ n)
    n /= n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (n * (p - y)) + 1e-3 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, counts and digest of base spans, and found: all spans and candidates by kind, then start, with their vote patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"]
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32())]))
        types = [pa.int64()] * 4 + [pa.string(), kind]
        for part in text_chunks(batches, "text"):
            columns: list[list] = [[] for _ in names]
            for text in part.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = further_spans(text, base) if text else []
                counts = Counter(k for k, _, _ in base)
                plain = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(base))
                spans = [{"kind": x[0], "start": x[1], "end": x[2], "base": own, "pattern": pattern_of(x[0], votes(text, x))} for x, own in sorted([(x, True) for x in base] + [(x, False) for x in more])]
                for column, x in zip(columns, [*(counts[k] for k in range(4)), hashlib.sha256(plain.encode()).hexdigest(), spans], strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<kind:int,start:bigint,end:bigint,base:boolean,pattern:int>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def accepted(rows: DataFrame, threshold: float = 0.5) -> list[int]:
    """The vote patterns that the trained classifier takes for personal data; at most 3^6 for each kind reach the driver."""
    each = rows.select(F.explode("found").alias("x")).groupBy("x.base", "x.pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    sure, candidates = ({r.pattern: r.n for r in sorted(each, key=lambda r: r.pattern) if r.base == own} for own in (True, False))
    weights = train(candidates, estimate(sure, candidates))
    keys = list(candidates)
    z = design(keys) @ weights
    return [k for k, x in zip(keys, z.tolist(), strict=True) if 1 / (1 + math.exp(-x)) >= threshold]


def personal_data(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans, n_spans, n_secret, found (array<struct<kind,start,end,base>>)."""
    rows = materialize(scanned(docs, id_col, text_col), "pii-spans")
    patterns = accepted(rows, threshold)
    names = F.array(*map(F.lit, KINDS))
    kept = F.filter("found", lambda x: x["base"] | x["pattern"].isin(patterns))
    found = F.transform(kept, lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    made = rows.withColumn("found", found)
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    secrets = F.size(F.filter("found", lambda x: x["kind"] == "secret")).cast("long")
    return made.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.size("found").cast("long").alias("n_spans"), secrets.alias("n_secret"), "found")
