"""Queries that SQL cannot express, against loops over the same tables."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from corpusmill.functions import fixed as K
from corpusmill.plans import registry, text_queries
from corpusmill.plans.corpus_queries import numbered
from corpusmill.sources import markup

registry.load()


def documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_normalization_of_all_documents(spark, sf):
    got = sorted((r.doc_id, r.text) for r in registry.QUERIES["nfkc_normalize"](spark, sf).collect() if r.text is not None)
    texts = [*documents(spark, sf).items(), *text_queries._NFC]
    plain = spark.createDataFrame([(i, unicodedata.normalize("NFKC", t)) for i, t in texts if t is not None], "i long, t string")
    assert got == sorted((r.i, hashlib.md5(r.v.encode()).hexdigest()) for r in plain.select("i", text_queries.T.normalize("t").alias("v")).collect())


def test_pages_of_the_table(spark, sf):
    """Visible words by a plain removal of tags, for pages without blocks that are left out."""
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in registry.QUERIES["html_extract"](spark, sf).collect()}
    assert got.keys() == rows.keys()
    for i, html in rows.items():
        assert got[i].n_links == len(re.findall(r"<a\s[^>]*href=[\"'][^\"']+", html or "", re.I))
        title = re.search(r"<title[^>]*>(.*?)</title>", html or "", re.S | re.I)
        assert got[i].title == markup.html.unescape(title[1] if title else "").strip()


def test_term_vectors_and_sketches(spark, sf):
    """Sums of neighbours' vectors, and the sides of the planes on which they lie."""
    from corpusmill.operators import models, ngrams

    pairs = ngrams.cooccurrence(numbered(spark, sf)).collect()
    want: dict = {}
    for r in pairs:
        own = want.setdefault(r.term, [0] * K.DIMENSIONS)
        for d, s in models.index_entries(r.neighbour):
            own[d] += s * r.weight
    got: dict = {}
    for r in registry.QUERIES["term_vectors"](spark, sf).collect():
        got.setdefault(r.term, [0] * K.DIMENSIONS)[r.dim] = r.x
    assert got.keys() == want.keys() and all(all(abs(a - b) < 1e-6 for a, b in zip(got[t], want[t])) for t in want)
    planes = models.planes()
    for r in registry.QUERIES["term_sketches"](spark, sf).collect():
        v = want[r.term]
        bits = "".join("1" if sum(v[d] for d in plus) - sum(v[d] for d in minus) > 0 else "0" for plus, minus in planes)
        assert r.sketch % (1 << 64) == int(bits, 2)


def test_quotations(spark, sf):
    """Quotations within 40 characters of each other answer one another."""
    got = [(r.doc_id, r.i, r.user, r.bot) for r in registry.QUERIES["quote_pairs"](spark, sf).collect()]
    from corpusmill.plans import dialog_queries, golden

    want = []
    for doc, text in [*golden.rows(dialog_queries._QUOTES), *documents(spark, sf).items()]:
        found = [(m.start(), m.end(), m[1].strip()) for m in re.finditer("「([^「」]{2,80})」", text or "")]
        n = 0
        for (_, end, a), (start, _, b) in zip(found, found[1:]):
            if start - end <= 40 and a != b and n < 200:
                want.append((doc, n, a, b))
                n += 1
    assert sorted(got) == sorted(want) and want
