from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import packing
from corpusmill.llm.queries import tokenizer_path

from .conftest import ODD


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(pieces, docs, reference, length):
    """An exact round trip: the pieces give every document's ids once, and sequences have no gaps."""
    ids = {i: reference(t) for i, t in docs}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        piece = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.length == len(piece) > 0 and p.ids_crc32 == zlib.crc32(piece.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        of_doc[p.doc_id].append((p.start, p.length))
        of_sequence[p.sequence_id].append((p.offset, p.length))
    for spans, total in [(of_doc[i], len(x)) for i, x in ids.items()] + [(s, None) for s in of_sequence.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert total in (None, at)
    sizes = sorted(sum(n for _, n in s) for s in of_sequence.values())
    assert all(s <= length and (s == length or s & (s - 1) == 0) for s in sizes)
    assert sum(s < length for s in sizes) <= 11
    assert sorted(of_sequence) == list(range(len(of_sequence)))


def test_query_round_trip(spark, sf, reference):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    from corpusmill.llm.queries import QUERIES

    check(QUERIES["op10_packing"](spark, sf).collect(), docs, reference, 2048)


def test_odd_rows(make, reference):
    docs = [r for r in ODD if r[0] != 6] + [(6, "long words " * 5000), (9, "a  b\n\n c \n d   e\t<|endoftext|> x "), (10, "  x 　y")]
    docs = list({i: (i, t) for i, t in docs}.values())
    check(packing.pack(make(docs), tokenizer_path(), 64, block_rows=3).collect(), docs, reference, 64)
    assert packing.pack(make(docs).limit(0), tokenizer_path()).collect() == []


def test_repeated_rows_are_each_packed(make):
    assert sum(p.length for p in packing.pack(make([(1, "a b c")] * 5), tokenizer_path(), 64).collect()) == 20


def window_shares(pieces):
    got = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        got[p.sequence_id][p.source] += p.length
    return got


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_query_holds_the_mixture_in_every_window(spark, folder):
    """Each full window has each source's tokens to within two of its target."""
    from corpusmill.llm.queries import QUERIES

    got = window_shares(QUERIES["op10_packing"](spark, f"/root/testdata/{folder}").collect())
    totals = defaultdict(int)
    for window in got.values():
        for s, n in window.items():
            totals[s] += n
    whole = sum(totals.values())
    full = [w for w in got.values() if sum(w.values()) == 2048]
    assert len(full) >= whole // 2048
    assert max(abs(w[s] - 2048 * t / whole) for w in full for s, t in totals.items()) <= 2


def test_given_mixture_is_held_while_sources_last(make, reference):
    docs = [(i, "word " * (5 + i * 37 % 90), "en", "abc"[min(2, i % 7)]) for i in range(400)]
    docs += [(1000 + i, "tiny", "en", f"t{i}") for i in range(30)]
    pieces = packing.pack(make(docs), tokenizer_path(), 512, {"b": 0.5, "none": 0.2, "a": 0.1}, block_rows=50).collect()
    check(pieces, [r[:2] for r in docs], reference, 512)
    got = window_shares(pieces)
    last = {s: max(p.sequence_id for p in pieces if p.source == s) for s in "abc"}
    first_end = min(last.values())
    assert first_end > 5
    # "none" is not there, so the rest has 0.4
    for w in range(first_end):
        assert abs(got[w]["b"] - 512 * 0.5) <= 2 and abs(got[w]["a"] - 512 * 0.1) <= 2
    assert len({s for w in got.values() for s in w}) == 33


@pytest.mark.parametrize("seed", range(6))
def test_lanes_against_a_loop(seed):
    """Each lane's tokens come once and in order, windows are full, and deficits stay under two tokens."""
    from fractions import Fraction

    rng = np.random.default_rng(seed)
    totals = [int(x) for x in rng.integers(100, 3000, 4)]
    shares = [Fraction(int(x), 100) for x in rng.integers(5, 60, 4)] if seed % 2 else [Fraction(t, sum(totals)) for t in totals]
    lanes = packing.Lanes(totals, shares, 64)
    filled = defaultdict(list)
    for k, total in enumerate(totals):
        at = 0
        while at < total:
            n = min(total - at, int(rng.integers(1, 200)))
            end = 0
            for start, stop, window, offset in lanes.cuts(k, at, n):
                assert start == end
                end = stop
                filled[window].append((offset, stop - start, k))
            assert end == n
            at += n
    for w in range(lanes.windows):
        spans, at = sorted(filled[w]), 0
        for offset, n, _ in spans:
            assert offset == at
            at += n
        assert at == (64 if (w + 1) * 64 <= sum(totals) else sum(totals) % 64)
    own = sum(n for w in range(5) for _, n, k in filled[w] if k == 0)
    assert abs(own - 5 * 64 * float(shares[0] / sum(shares))) < 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z'sté1 .\n\t 　語😀\x1c\x85"), max_size=30), min_size=1, max_size=6))
def test_ids_equal_those_of_the_tokenizer_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.encoder(tokenizer_path()).batch(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [[*t.encode(s, add_special_tokens=False).ids, packing.END_ID] for s in texts]
