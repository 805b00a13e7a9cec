"""Language-model scores from a log-frequency Bloom filter.

The filter holds the quantised counts of all training n-grams of orders 1 to 3: an n-gram of level q is entered once for
each level from 1 to q, and is read back by probing level after level until one misses (or the filter's highest level
is reached). Every n-gram that was counted is entered. The filter lies in segments of the key space, as many as the
corpus needs, each sized for its own entries, so no machine holds the whole filter.

Texts are read in chunks. A chunk sends each segment its distinct keys, with how often they stand in its training texts;
the segment adds the counts up, fills its part of the filter, and answers with the keys' levels by membership probes (and
with the tokens' exact counts, for the base score). The answers go back to the chunk, where a text becomes a histogram
of its tokens' combinations of levels. From the histograms of all training texts, each token without its own share of
the counts, expectation-maximisation fits the interpolation weights (deleted interpolation): one for each level of the
context, so that contexts seen often are trusted more. The score is the text's log10 probability under that model.

base_score is exact: it uses the exact counts of tokens, told apart by 64-bit hashes.

Defined results: null text is empty and has one token, the end; without training rows N and V are 0; rows that repeat a
doc_id are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, text_chunks

#: No word holds a blank.
END = "\n"
SEED = 42
END_HASH = np.uint64(xxhash.xxh64_intdigest(END, SEED))
BITS_PER_ENTRY = 12
PROBES = 6
#: Counts are quantised by powers of this; the highest level is open (counts over 10^10).
BASE = 1.5
LEVELS = 64
#: Bytes of text for each segment of the key space, and that ask the segments together.
SEGMENT_BYTES = 4 << 20
CHUNK = 3 << 20
#: Steps of a power of ten in which the lower order's probability is told apart when weights are fitted.
STEPS = 8
ROUNDS = 40


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For all texts in turn: where each one's tokens begin (one bound more), codes, and the distinct tokens; the end has code 0."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.values.dictionary_encode()
    distinct = [END, *flat.dictionary.to_pylist()]
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    bounds = split.offsets.to_numpy().astype(np.int64)
    empty = np.array([w == "" for w in distinct])
    keep = ~empty[codes] if len(codes) else np.empty(0, bool)
    before = np.concatenate(([0], np.cumsum(keep)))[bounds]
    n = len(texts)
    out = np.zeros(before[-1] + n, np.int64)
    place = np.arange(before[-1]) + np.repeat(np.arange(n), np.diff(before))
    out[place] = codes[keep]
    return before + np.arange(n + 1), out, distinct


def hashes(tokens: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(t, SEED) for t in tokens], np.uint64)


def unigram_keys(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(0x9E3779B97F4A7C15))


def bigram_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(before) + h)


def trigram_keys(bigrams: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of the keys of the two tokens before, and the token."""
    return mix(mix(bigrams ^ np.uint64(0xC2B2AE3D27D4EB4F)) + h)


def previous(values: np.ndarray, bounds: np.ndarray, first: np.uint64 | int) -> np.ndarray:
    """The value of the token before each one; a text's first token has ``first``."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[bounds[:-1]] = first
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS - 1, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9)).astype(np.int64)


def expected(level: np.ndarray) -> np.ndarray:
    """The middle count of each level's range; 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** (level * 1.0) - 1e-9) - 1)
    return np.where(level > 0, np.sqrt(low * high), 0.0)


COUNT = expected(np.arange(LEVELS))


class LogFrequencyBloom:
    """A segment's bits, with room for the entries of (keys, levels) by order, and the highest level entered."""

    def __init__(self, entries: dict[int, tuple[np.ndarray, np.ndarray]], bits_per_entry: int = BITS_PER_ENTRY):
        n = sum(int(top.sum()) for _, top in entries.values())
        flags = np.zeros(max(64, -(-n * bits_per_entry // 64) * 64), np.uint8)
        self.part, self.highest = len(flags), {o: int(top.max(initial=0)) for o, (_, top) in entries.items()}
        for o, (keys, top) in entries.items():
            for q in range(1, self.highest[o] + 1):
                keys, top = (keys, top) if q == 1 else (keys[top >= q], top[top >= q])
                step = self.step(keys, o, q)
                for probe in range(PROBES):
                    flags[self.spot(step, probe)] = 1
        self.bits = np.packbits(flags, bitorder="little")

    @staticmethod
    def step(keys: np.ndarray, order: int, level: int) -> np.ndarray:
        """What an entry's probes are made of."""
        return mix(keys + np.uint64((0xD1B54A32D192ED03 * level + (order << 33)) % (1 << 64)))

    def spot(self, step: np.ndarray, probe: int) -> np.ndarray:
        return (((step & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * ((step >> np.uint64(32)) | np.uint64(1))) % np.uint64(self.part)).astype(np.int64)

    def level(self, keys: np.ndarray, order: int) -> np.ndarray:
        """The level of each key, 0 for none: never under the entered one, seldom over it."""
        out = np.zeros(len(keys), np.uint8)
        live = np.arange(len(keys))
        for q in range(1, self.highest.get(order, 0) + 1):
            step = self.step(keys[live], order, q)
            for probe in range(PROBES):
                at = self.spot(step, probe)
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                live, step = live[hit], step[hit]
            if not len(live):
                break
            out[live] = q
        return out


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers byte by byte: all first bytes, then all second ones, so that the high ones, mostly zero, compress well."""
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def sorted_planes(keys: np.ndarray, width: int) -> bytes:
    """Of rising numbers: the steps between them."""
    return planes(np.diff(keys.astype(f"<u{width}"), prepend=np.zeros(1, f"<u{width}")), width)


def from_sorted_planes(data: bytes, width: int) -> np.ndarray:
    return np.cumsum(from_planes(data, width), dtype=f"<u{width}")


def packed_texts(texts: pa.Array) -> bytes:
    """A chunk's texts, compressed, so that they are stored and exchanged small."""
    batch, sink = pa.RecordBatch.from_arrays([texts], ["text"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_texts(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_next_batch().column(0)


def squeezed(data: bytes) -> bytes:
    """Compressed, after its length: levels are mostly one."""
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True) if data else b""


#: Bytes by which a segment tells its keys apart: all of a token's hash, since its count must be exact, half of other keys.
WIDTH = {1: 8, 2: 4, 3: 4}


def short_keys(keys: np.ndarray, order: int, segment_bits: int) -> np.ndarray:
    """Keys in the order of their segments, as the chunk and the segment sort them."""
    if WIDTH[order] == 8 or not segment_bits:
        return keys if WIDTH[order] == 8 else keys & np.uint64(0xFFFFFFFF)
    return (keys >> np.uint64(64 - segment_bits) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def segments_of(short: np.ndarray, order: int, segment_bits: int) -> np.ndarray:
    if not segment_bits:
        return np.zeros(len(short), np.int64)
    return (short >> np.uint64(64 - segment_bits if WIDTH[order] == 8 else 32)).astype(np.int64)


def chunk_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], dict[int, np.ndarray], dict[int, np.ndarray]]:
    """``tokens_of`` texts, with the keys by order and the token that each key ends at.

    Keys of order 1 are those of the distinct tokens; a text's first token has a pair with the end, but no triple.
    """
    bounds, codes, distinct = tokens_of(texts)
    h = hashes(distinct)
    own = h[codes]
    pairs = bigram_keys(previous(own, bounds, END_HASH), own)
    inner = np.ones(len(codes), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    return bounds, codes, distinct, {1: unigram_keys(h), 2: pairs, 3: trigram_keys(pairs[at - 1], own[at])}, {1: codes, 2: np.arange(len(codes)), 3: at}


def ask(chunks: DataFrame, segment_bits: int) -> DataFrame:
    """What each chunk sends to each segment: distinct keys of each order, and how often they stand in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bounds, codes, _, keys, where = chunk_keys(unpacked_texts(batch.column("texts")[i].as_py()))
                learn = np.repeat(batch.column("learn")[i].values.to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                rows: dict[int, list] = {}
                for o, own in keys.items():
                    short = short_keys(own, o, segment_bits)
                    short, back = np.unique(short, return_inverse=True)
                    # of order 1 the keys are those of distinct tokens, of the others those of places
                    counts = (np.bincount(back[codes], learn, len(short)) if o == 1 else np.bincount(back, learn[where[o]], len(short))).astype(np.int64)
                    segments = segments_of(short, o, segment_bits)
                    cuts = np.flatnonzero(np.diff(segments)) + 1
                    for k, c, first in zip(np.split(short, cuts), np.split(counts, cuts), segments[np.concatenate(([0], cuts))].tolist() if len(segments) else [], strict=False):
                        row = rows.setdefault(first, [b""] * 6)
                        row[2 * o - 2], row[2 * o - 1] = sorted_planes(k, WIDTH[o]), planes(c, 4)
                columns = list(zip(*rows.values(), strict=True))
                names = [f"{x}{o}" for o in WIDTH for x in ("keys", "counts")]
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([batch.column("chunk")[i].as_py()] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["segment", "chunk", *names])

    return chunks.select("chunk", "texts", "learn").mapInArrow(run, "segment long, chunk long, " + ", ".join(f"keys{o} binary, counts{o} binary" for o in WIDTH))


def answer(asked: DataFrame) -> DataFrame:
    """For each chunk and segment the levels of the keys and the tokens' counts; rows without a chunk have a segment's total and distinct tokens."""
    bits_per_entry = BITS_PER_ENTRY

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        found, entries, summed = {}, {}, {}
        for o, width in WIDTH.items():
            keys = [from_sorted_planes(x, width) for x in table.column(f"keys{o}").to_pylist()]
            counts = np.concatenate([from_planes(x, 4) for x in table.column(f"counts{o}").to_pylist()])
            sizes = [len(k) for k in keys]
            distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, counts, len(distinct)).astype(np.int64)
            seen = total > 0
            entries[o] = (distinct[seen].astype(np.uint64), levels(total[seen]))
            summed[o] = (distinct.astype(np.uint64), back, np.cumsum(sizes)[:-1], total)
        model = LogFrequencyBloom(entries, bits_per_entry)
        for o, (distinct, back, cuts, total) in summed.items():
            found[f"levels{o}"] = [squeezed(x.tobytes()) for x in np.split(model.level(distinct, o)[back], cuts)]
            if o == 1:
                found["exact"] = [planes(np.minimum(x, 0xFFFFFFFF), 4) for x in np.split(total[back], cuts)]
                stats = int(total.sum()), int((total > 0).sum())
        nothing = [None]
        out = {"chunk": pa.array(table.column("chunk").to_pylist() + nothing, pa.int64()), "segment": pa.array(table.column("segment").to_pylist() + nothing, pa.int64())}
        out |= {c: pa.array(found[c] + nothing, pa.binary()) for c in ("exact", "levels1", "levels2", "levels3")}
        out |= {c: pa.array([None] * n + [x], pa.int64()) for c, x in zip(("total", "tokens"), stats, strict=True)}
        pa.default_memory_pool().release_unused()
        return pa.table(out)

    return asked.groupBy("segment").applyInArrow(run, "chunk long, segment long, exact binary, levels1 binary, levels2 binary, levels3 binary, total long, tokens long")


def packed_levels(level1: np.ndarray, context2: np.ndarray, level2: np.ndarray, context3: np.ndarray, level3: np.ndarray) -> np.ndarray:
    """The combination of levels of a token: of itself, of the token before, of their pair, of the pair before, of the triple."""
    out = level1.astype(np.int64)
    for x in (context2, level2, context3, level3):
        out = out << 6 | x
    return out


def histograms(chunk: pa.Table, replies: pa.Table, segment_bits: int) -> pa.Table:
    """For each text of a chunk: tokens, the known ones, the sum of log10(2 c + 1), and its combinations of levels with their numbers."""
    rows, ids, learn = (chunk.column(c).combine_chunks().flatten() for c in ("rows", "ids", "learn"))
    texts = unpacked_texts(chunk.column("texts")[0].as_py())
    bounds, codes, _, keys, where = chunk_keys(texts)
    replies, level, n = replies.sort_by("segment"), {}, len(texts)
    for o, own in keys.items():
        got = np.frombuffer(b"".join(map(unsqueezed, replies.column(f"levels{o}").to_pylist())), np.uint8)
        back = np.unique(short_keys(own, o, segment_bits), return_inverse=True)[1]
        level[o] = got[back]
        if o == 1:
            exact = np.concatenate([from_planes(x, 4) for x in replies.column("exact").to_pylist()])[back]
    doc = np.repeat(np.arange(n), np.diff(bounds))
    level1 = level[1][codes]
    # a text's first token follows an end
    context2 = previous(level1, bounds, level[1][0])
    context3, level3 = np.zeros(len(codes), np.uint8), np.zeros(len(codes), np.uint8)
    context3[where[3]], level3[where[3]] = level[2][where[3] - 1], level[3]
    combos, back = np.unique(packed_levels(level1, context2, level[2], context3, level3), return_inverse=True)
    pairs, times = np.unique(doc * len(combos) + back, return_counts=True)
    cuts = np.searchsorted(pairs // len(combos), np.arange(n + 1))
    own = combos[pairs % len(combos)]
    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (own, times)]
    known = np.bincount(doc, (exact > 0)[codes], n).astype(np.int64)
    logs = np.bincount(doc, np.log10(2.0 * exact + 1)[codes], n)
    pa.default_memory_pool().release_unused()
    return pa.table({"row": rows, "doc_id": ids, "learn": learn, "n_tokens": pa.array(np.diff(bounds), pa.int64()), "n_known": pa.array(known), "logs": pa.array(logs), "combos": lists[0], "times": lists[1]})


def levels_in(combos: np.ndarray) -> list[np.ndarray]:
    combos = combos.astype(np.int64)
    return [combos >> s & 63 for s in (24, 18, 12, 6, 0)]


def share(level: np.ndarray, context: np.ndarray, leave_out: int = 0) -> np.ndarray:
    """The n-gram's share of its context's count; 0 where the context has none."""
    own, of = np.maximum(COUNT[level] - leave_out, 0), np.maximum(COUNT[context] - leave_out, 0)
    return np.where(of > 0, np.minimum(own / np.maximum(of, 1e-9), 1.0), 0.0)


def fit_weights(context: np.ndarray, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each level of the context the weight of the higher order's probability: expectation-maximisation.

    Contexts with next to no evidence keep the weight of about one observation for the lower order.
    """
    weights = np.full(LEVELS, 0.5)
    size = np.bincount(context, n, LEVELS)
    for _ in range(ROUNDS):
        w = weights[context]
        part = w * high / (w * high + (1 - w) * low)
        weights = np.bincount(context, n * part, LEVELS) / (size + 1.0)
    weights[0] = 0.0
    return weights


def unigrams(level: np.ndarray, denominator: float, leave_out: int = 0) -> np.ndarray:
    return (np.maximum(COUNT[level] - leave_out, 0) + 0.5) / denominator


def fit(scored: DataFrame, denominator: float) -> tuple[np.ndarray, np.ndarray]:
    """The weights of pairs and of triples, from all training texts, each token without its own share of the counts.

    What reaches the driver is bounded by the number of levels: 64^3 sums for pairs; for triples 64^2 times the steps
    of the lower order's probability.
    """
    each = scored.where("learn").select(F.explode(F.arrays_zip("combos", "times")).alias("x")).groupBy(F.col("x.combos").alias("combo")).agg(F.sum("x.times").alias("n"))
    each = materialize(each, "lm-combinations")

    def collected(key: Column) -> tuple[np.ndarray, np.ndarray]:
        got = each.groupBy(key.alias("k")).agg(F.sum("n").alias("n")).orderBy("k").toPandas()
        return got["k"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(float)

    key, n = collected(F.shiftright("combo", 12))
    level1, context, level2 = key >> 12 & 63, key >> 6 & 63, key & 63
    pairs = fit_weights(context, share(level2, context, 1), unigrams(level1, denominator, 1), n)

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l1, c2, l2, c3, l3 = levels_in(batch.column("combo").to_numpy(zero_copy_only=False))
            q = pairs[c2] * share(l2, c2, 1) + (1 - pairs[c2]) * unigrams(l1, denominator, 1)
            step = np.clip(np.round(-np.log10(q) * STEPS), 0, 1023).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step << 12 | c3 << 6 | l3), batch.column("n")], ["combo", "n"])

    each = materialize(each.mapInArrow(lower, "combo long, n long"), "lm-triples")
    key, n = collected(F.col("combo"))
    context, level3, low = key >> 6 & 63, key & 63, 10.0 ** (-(key >> 12) / STEPS)
    return pairs, fit_weights(context, share(level3, context, 1), low, n)


def log_probability(combos: np.ndarray, pairs: np.ndarray, triples: np.ndarray, denominator: float) -> np.ndarray:
    """log10 probability of a token with these levels."""
    l1, c2, l2, c3, l3 = levels_in(combos)
    low = pairs[c2] * share(l2, c2) + (1 - pairs[c2]) * unigrams(l1, denominator)
    return np.log10(triples[c3] * share(l3, c3) + (1 - triples[c3]) * low)


def lm_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` is a condition on ``docs`` that tells which rows the counts come from.
    """

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text", CHUNK):
            whole = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(c)])) for c in ("row", "doc_id", "learn")]
            size = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            yield pa.RecordBatch.from_arrays([part.column("row")[:1], *whole, pa.array([packed_texts(part.column("text"))], pa.binary()), pa.array([size], pa.int64())], ["chunk", "rows", "ids", "learn", "texts", "size"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    chunks = materialize(rows.mapInArrow(hold, "chunk long, rows array<long>, ids array<long>, learn array<boolean>, texts binary, size long"), "lm-chunks", "zstd")
    size, n = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    segment_bits = max(0, math.ceil(math.log2(max(1, size / SEGMENT_BYTES))))
    # partitions grow with the corpus, so a task's share does not
    by_segment, by_chunk = 1 << segment_bits, max(1, n)
    replies = materialize(answer(ask(chunks, segment_bits).repartition(by_segment, "segment")), "lm-replies")
    stats = replies.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    total, distinct = int(stats[0]), int(stats[1])
    denominator = total + 0.5 * (distinct + 1)

    own = chunks.drop("size").repartition(by_chunk, "chunk").groupBy("chunk")
    theirs = replies.where("chunk is not null").drop("total", "tokens").repartition(by_chunk, "chunk").groupBy("chunk")
    scored = own.cogroup(theirs).applyInArrow(lambda a, b: histograms(a, b, segment_bits), "row long, doc_id long, learn boolean, n_tokens long, n_known long, logs double, combos array<int>, times array<int>")
    scored = materialize(scored, "lm-scored", "zstd")
    pairs, triples = fit(scored, denominator) if total else (np.zeros(LEVELS), np.zeros(LEVELS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            combos, times = batch.column("combos"), batch.column("times")
            logs = log_probability(combos.values.to_numpy(), pairs, triples, denominator) * times.values.to_numpy()
            sums = np.concatenate(([0.0], np.cumsum(logs)))
            at = combos.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "logs")), pa.array(sums[at[1:]] - sums[at[:-1]])], ["doc_id", "n_tokens", "n_known", "logs", "score"])

    made = scored.select("doc_id", "n_tokens", "n_known", "logs", "combos", "times").mapInArrow(score, "doc_id long, n_tokens long, n_known long, logs double, score double")
    return made.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(math.log10(2 * denominator))).alias("base_score"), "score")
