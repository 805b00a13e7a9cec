"""Packing documents into sequences of a fixed length under a target mixture of sources.

Deficit round-robin over one queue (lane) for each source: every window hands each lane its quantum, its share of the
window in tokens, and a lane then gives as many tokens as its deficit holds, cutting documents where the quantum ends.
What rounding leaves is carried to the next window, over windows and partitions alike. The deficits have a closed form:
after w windows the first k lanes have given floor(G_k(w)) tokens, G_k(w) being their exact share of w windows, so a
lane's tokens in a window are within two of its quantum and every window is full. A document that starts at token b of
its lane is therefore placed by integer arithmetic on b alone; only b needs running sums, which are distributed. When a
lane ends, those that are left share its part.

At most ``length`` sources can have a quantum of a token or more, so the lanes have a fixed bound; the sources below
that share one lane, in which their documents stand in hash order.

The last tokens, fewer than a window, are cut into powers of two, so no sequence needs any padding.

Token ids are those of the ``tokenizers`` file. As that library takes over ten times the CPU, its vocabulary is run by
tiktoken's BPE; tests hold the ids against ``tokenizers``.

Defined results: null text is empty and has only the end id; null sources are a source of their own; documents are
ordered by a hash of doc_id, then doc_id, and rows that repeat a doc_id are each packed, once; shares of sources that
the table lacks go to the others; shares of less than a token a window are raised to one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, text_chunks

END_ID = 1
#: GPT-2's split into pieces, as the tokenizer's file asks for (a fixed value of that public format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NULL_SOURCE = "\x00null"
#: Of a running sum: rows that are summed in one task, and sums of blocks.
BLOCK_ROWS, BLOCK_SUMS = 256, 1024


class Encoder:
    """Ids of texts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # byte-level BPE writes bytes as printable characters: the printable ones of Latin-1 as they are, the others from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in own]
        to_byte = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items() if all(c in to_byte for c in token) and token != "<|endoftext|>"}
        self.encode = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: ids are kept in two bytes where they fit
        self.kind, self.width = ("H", "<u2") if max(ranks.values()) < 1 << 16 else ("I", "<u4")

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, END_ID last."""
        return [np.frombuffer(array(self.kind, [*self.encode(t or ""), END_ID]), self.width) for t in texts.to_pylist()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row (a number of its own for each row), doc_id, source, n (tokens) and ids (two or four bytes each, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part in text_chunks(batches, "text", 4 << 20):
            ids = encode.batch(part.column("text"))
            columns = [part.column("row"), part.column("doc_id"), part.column("source"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "source", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NULL_SOURCE)).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, source string, n long, ids binary")


def running_sum(rows: DataFrame, group: list[str], block: Column, order: list[str], value: str, out: str, levels: int = 2) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the group's earlier rows in order of ``block``, then ``order``.

    A running sum in each block, and one over the sums of blocks, which is made likewise over blocks of blocks: no task
    sees a whole group. ``block`` numbers from 0 and should give about ``BLOCK_ROWS`` rows a block.
    """
    name = f"__block{levels}"
    rows = rows.withColumn(name, block)
    # summed with a map-side aggregation: one row for each block
    sums = rows.groupBy(*group, name).agg(F.sum(value).alias(f"__sum{levels}"))
    if levels:
        before = running_sum(sums, group, F.floor(F.col(name) / BLOCK_SUMS), [name], f"__sum{levels}", f"__before{levels}", levels - 1)
    else:
        over = Window.partitionBy(*group).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.withColumn("__before0", F.coalesce(F.sum("__sum0").over(over), F.lit(0)))
    inner = Window.partitionBy(*group, name).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("__within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = within.join(before.select(*group, name, f"__before{levels}"), [*group, name])
    return joined.withColumn(out, F.col(f"__before{levels}") + F.col("__within")).drop(name, f"__before{levels}", "__within")


class Lanes:
    """How many tokens each lane has given after each window."""

    def __init__(self, totals: list[int], shares: list[Fraction], length: int):
        self.totals, self.length, self.total = totals, length, sum(totals)
        #: windows, the last one maybe short
        self.windows = -(-self.total // length)
        self.phases: list[tuple[int, list[int], list[int]]] = []
        self.starts: list[Fraction] = []
        at, given = Fraction(0), [Fraction(0)] * len(totals)
        while any(g < t for g, t in zip(given, totals, strict=True)):
            live = [s if g < t else Fraction(0) for g, t, s in zip(given, totals, shares, strict=True)]
            rate = [x / sum(live) for x in live]
            # the first k lanes have given base[k] + slope[k] * (tokens given in all), in this phase
            base, slope = [Fraction(0)], [Fraction(0)]
            for g, r in zip(given, rate, strict=True):
                base.append(base[-1] + g - r * at)
                slope.append(slope[-1] + r)
            unit = math.lcm(*(x.denominator for x in base + slope))
            self.phases.append((unit, [int(x * unit) for x in base], [int(x * unit) for x in slope]))
            self.starts.append(at)
            step = min((t - g) / r for g, t, r in zip(given, totals, rate, strict=True) if r)
            at, given = at + step, [g + r * step for g, r in zip(given, rate, strict=True)]

    def edges(self, lane: int, window: int) -> tuple[int, int]:
        """Tokens that the lanes before this one, and it included, give in the windows before ``window``."""
        x = min(window * self.length, self.total)
        unit, base, slope = self.phases[0 if len(self.phases) == 1 else bisect_right(self.starts, x) - 1]
        return (base[lane] + slope[lane] * x) // unit, (base[lane + 1] + slope[lane + 1] * x) // unit

    def given(self, lane: int, window: int) -> int:
        low, high = self.edges(lane, window)
        return high - low

    def cuts(self, lane: int, before: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, window, offset in it) of the pieces of n tokens that stand at token ``before`` of their lane."""
        w = bisect_right(range(self.windows), before, key=lambda w: self.given(lane, w)) - 1
        at, (low, high) = before, self.edges(lane, w)
        while at < before + n:
            next_low, next_high = self.edges(lane, w + 1)
            end = min(before + n, next_high - next_low)
            if end > at:
                yield at - before, end - before, w, next_low - low + at - (high - low)
                at = end
            low, high, w = next_low, next_high, w + 1


def lanes_of(sizes: DataFrame, mixture: dict[str, float], length: int) -> tuple[dict[str, int], list[int], Lanes]:
    """The lane of each source that has one (others: the last), the rows of each lane, and the lanes.

    ``sizes`` has source, total (tokens) and rows. Sources without a share in ``mixture`` divide what it leaves as the
    corpus has them. At most ``length`` and as many rows as the mixture has reach the driver.
    """
    named = {r.source: r for r in sizes.where(F.col("source").isin(list(mixture))).collect()} if mixture else {}
    rest = sizes.where(~F.col("source").isin(list(named))) if named else sizes
    whole = rest.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    least = Fraction(1, length)
    share = {s: max(least, Fraction(mixture[s]).limit_denominator(1_000_000)) for s in named}
    left = max(least, Fraction(1) - sum(share.values())) if whole.total else Fraction(0)
    # a quantum of a token or more: sum of quanta is at most ``length``, so as many sources
    large = rest.where(F.col("total") * F.lit(float(left * length)) >= F.lit(float(whole.total))).orderBy("source").collect() if whole.total else []
    small = [whole.total - sum(r.total for r in large), whole.rows - sum(r.rows for r in large)]
    if small[0] and left * length * small[0] < whole.total and large:
        least_one = min(large, key=lambda r: (r.total, r.source))
        large.remove(least_one)
        small = [small[0] + least_one.total, small[1] + least_one.rows]
    lanes = [(s, named[s].total, named[s].rows, share[s]) for s in sorted(named)] + [(r.source, r.total, r.rows, left * r.total / whole.total) for r in large]
    if small[0] or not lanes:
        lanes.append((None, small[0], small[1], left * small[0] / whole.total if whole.total else Fraction(1)))
    return {s: i for i, (s, *_) in enumerate(lanes) if s is not None}, [x[2] for x in lanes], Lanes([x[1] for x in lanes], [x[3] for x in lanes], length)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, mixture: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``mixture`` gives sources their share of each window; without it, or for sources that it lacks, shares are as the
    corpus has them, so that all queues end together.
    """
    tokens = materialize(tokenized(docs, tokenizer, id_col, text_col, source_col), "packing-tokens")
    sizes = materialize(tokens.groupBy("source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")), "packing-sources")
    number, rows, lanes = lanes_of(sizes, mixture or {}, length)

    # at most as many as have a token a window, and those of the mixture
    known = docs.sparkSession.createDataFrame(list(number.items()), "source string, lane int")
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-n // block_rows))) for n in rows]), F.col("lane") + 1)
    plan = tokens.select("row", "doc_id", "source", "n").join(F.broadcast(known), "source", "left").select("row", "doc_id", "n", F.coalesce("lane", F.lit(len(rows) - 1)).alias("lane"), F.xxhash64("doc_id").alias("h"))
    planned = running_sum(plan, ["lane"], F.pmod("h", blocks), ["h", "doc_id", "row"], "n", "before").select("row", "lane", "before")

    # the last window's tokens, in parts of a power of two
    whole, tail, ends = lanes.total // length, lanes.total % length, [0]
    for bit in reversed(range(length.bit_length())):
        if tail >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    joined = tokens.select("row", "doc_id", "source", "n", "ids").join(planned.hint("merge"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        for batch in batches:
            out: list[tuple] = []
            for doc, source, n, ids, lane, before in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "n", "ids", "lane", "before")), strict=True):
                wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                for start, end, window, offset in lanes.cuts(lane, before, n):
                    if window < whole:
                        out.append((doc, start, end - start, zlib.crc32(wide[start:end]), n, window, offset, source))
                        continue
                    for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                        a, b = max(start, start + lo - offset), min(end, start + hi - offset)
                        if a < b:
                            out.append((doc, a, b - a, zlib.crc32(wide[a:b]), n, whole + i, offset + a - start - lo, source))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if c == "source" else pa.int64()) for c, x in zip(names, columns, strict=True)], names)

    out = joined.select("doc_id", "source", "n", "ids", "lane", "before").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
    return out.withColumn("source", F.when(F.col("source") != NULL_SOURCE, F.col("source")))
