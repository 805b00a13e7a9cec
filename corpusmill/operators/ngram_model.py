"""Probabilities of held-out tokens without exchanging n-grams as text.

A task counts the three-token events of its sentences in arrays, in codes of its own, and sends each part of the
hash space one compressed block. Parts go by an event's middle token: what a held-out token asks of both orders then
lies in one part, and only continuation counts are added up over parts. Tokens are told apart by 64-bit hashes, n-grams
within a part by 64-bit hashes of these (any two of 10^7 in a part agree with a chance of 3e-6). A token's events lie in
one part: of the most frequent token's distinct events, 24 bytes each must fit in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.operators.corpus import PER_DOCUMENT, running_sum
from corpusmill.operators.ngrams import SPECIALS, START, STOP
from corpusmill.operators.store import stored

#: Tokens that a task counts at a time; held-out rows that are broadcast.
FLUSH, BROADCAST = 1 << 22, 2_000_000
#: The code of no token: before a sentence, and where a sentence is too short for an event of three.
_NONE = np.uint64(0)
#: The pattern as Java reads it: blanks are those of ASCII.
_WORD = re.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", K.WORD).replace(r"\s", r" \t\n\x0b\f\r"))
_COUNTS = ["c1", "total1", "types1", "c2", "total2", "types2"]
SCHEMA = ", ".join(["kind int, seq long, i int, tok string, h long", *(f"{c} long" for c in _COUNTS), "cont long"])


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode(), 42) or 1


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


def _packed(**columns) -> bytes:
    batch = pa.RecordBatch.from_pydict({n: c if isinstance(c, pa.Array) else pa.array(c) for n, c in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def holdout_rows(rows: DataFrame, every: int = 40) -> DataFrame:
    """seq, text and held_out of each ``every``-th sentence in order of arrival; only numbers are exchanged for it."""
    rows = stored(rows.select("seq", "text").withColumn("row", F.monotonically_increasing_id()), "sentences", "zstd")
    block = F.floor(F.col("seq") / (256 * PER_DOCUMENT))
    held = running_sum(rows.select("seq", "row"), block, ["seq", "row"], F.lit(1), "number").where(F.col("number") % every == 0)
    held = stored(held.select("row", F.lit(True).alias("held")), "held-rows")
    held = F.broadcast(held) if held.count() <= BROADCAST else held.hint("merge")
    return rows.join(held, "row", "left").select("seq", "text", F.coalesce("held", F.lit(False)).alias("held_out"))


def _sequences(lists: pa.Array, words: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sentences' codes between start and end, each one's place in its sentence, and its sentence's length."""
    sizes = np.diff(lists.offsets.to_numpy()) + 2
    ends = np.cumsum(sizes)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, words.dtype)
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    length = np.repeat(sizes, sizes)
    first, last = place == 0, place == length - 1
    flat[first], flat[last], flat[~(first | last)] = start, stop, words
    return flat, place, length


def _tokenized(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the tokens t of its lower-cased texts."""
    found = list(map(_WORD.findall, batch.column("text").to_pylist()))
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(found)), pa.string()))
    return pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("held_out"), lists], ["seq", "held_out", "t"])


def _codes(lists: pa.ListArray) -> tuple[np.ndarray, list[str]]:
    found = lists.flatten().dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def _blocks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, part: list[int], words: list[bytes], payload: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array(words, pa.binary()), pa.array(payload, pa.binary())], ["part", "kind", "words", "payload"])

        def learned(lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
            codes, names = _codes(lists)
            hashes = np.array([0, _hash(START), _hash(STOP), *map(_hash, names)], np.uint64)
            ids, place, length = _sequences(lists, codes.astype(np.int64) + 3, 1, 2)
            if (length == 2).any():  # a sentence without tokens: its end is a token, too
                yield rows(2, [0], [hashes[2:3].tobytes()], [b""])
            at = np.flatnonzero((place >= 1) & (length >= 3))
            before = np.where((place[at] >= 2) & (length[at] >= 4), ids[at - 2], 0)
            part = (hashes % np.uint64(parts)).astype(np.int64)
            n = len(hashes)
            bits = max(1, int(n - 1).bit_length())
            if 3 * bits > 63:
                raise ValueError("more distinct tokens in a block than codes")
            keys, counts = np.unique((ids[at - 1] << 2 * bits) | (before << bits) | ids[at], return_counts=True)
            middle, low = keys >> 2 * bits, (1 << bits) - 1
            own = part[middle]
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(parts + 1))
            for p in range(parts):
                mine = order[cuts[p] : cuts[p + 1]]
                if not len(mine):
                    continue
                k, c = keys[mine], counts[mine]
                used = np.zeros(n, bool)
                columns = [k >> 2 * bits, (k >> bits) & low, k & low]
                for x in columns:
                    used[x] = True
                kept = np.flatnonzero(used)
                small = np.cumsum(used) - 1
                b, a, t = (small[x].astype(np.int32) for x in columns)
                payload = _packed(b=np.diff(b, prepend=np.int32(0)), a=np.diff(a, prepend=np.int32(0)), t=t, n=c.astype(np.int32))
                yield rows(0, [p], [hashes[kept].tobytes()], [payload])

        def asked(seqs: np.ndarray, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
            codes, names = _codes(lists)
            hashes = np.array([0, _hash(START), _hash(STOP), *map(_hash, names)], np.uint64)
            said = pa.array(["", START, STOP, *names])
            ids, place, length = _sequences(lists, codes.astype(np.int64) + 3, 1, 2)
            seq = np.repeat(seqs, np.diff(lists.offsets.to_numpy()) + 2)
            at = np.flatnonzero(place >= 1)
            part = (hashes[ids[at - 1]] % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part).tolist():
                x = at[part == p]
                a = np.where(place[x] >= 2, hashes[ids[x - 2]], _NONE)
                yield rows(1, [p], [b""], [_packed(seq=seq[x], i=place[x].astype(np.int32), tok=said.take(pa.array(ids[x])), a=a, b=hashes[ids[x - 1]], t=hashes[ids[x]])])

        held, size = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            for flag in (False, True):
                some = table.filter(pa.compute.equal(table.column("held_out"), flag)).combine_chunks()
                if some.num_rows:
                    lists = some.column("t").combine_chunks()
                    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                    yield from asked(some.column("seq").to_numpy(), lists) if flag else learned(lists)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch := _tokenized(batch))
            size += len(batch.column("t").values)
            if size >= FLUSH:
                yield from flushed()
                held, size = [], 0
        if held:
            yield from flushed()

    return run


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each is first, and the sum of its weights."""
    found, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return found, first, np.bincount(back.ravel(), weights, len(found)).astype(np.int64)


def _looked_up(keys: np.ndarray, *columns: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whether each of ``keys`` is among the sorted keys of ``columns``' first, and each column's value there (0: none)."""
    known = columns[0][0]
    if not len(known):
        return np.zeros(len(keys), bool), [np.zeros(len(keys), np.int64) for _ in columns]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    seen = known[at] == keys
    return seen, [np.where(seen, v[at], 0) for _, v in columns]


def _counted(table: pa.Table) -> pa.Table:
    """What held-out tokens of one part ask for, and the part's continuation counts."""
    kinds = table.column("kind").to_pylist()
    learned, asked, lone = [[], [], [], []], [], []
    for kind, words, payload in zip(kinds, table.column("words"), table.column("payload"), strict=True):
        if kind == 2:
            lone.append(np.frombuffer(words.as_py(), np.uint64))
        elif kind == 1:
            asked.append(_unpacked(payload.as_py()))
        else:
            hashes, rows = np.frombuffer(words.as_py(), np.uint64), _unpacked(payload.as_py())
            of = lambda n: rows.column(n).to_numpy()  # noqa: B023, E731
            for out, codes in zip(learned, (np.cumsum(of("a")), np.cumsum(of("b")), of("t")), strict=False):
                out.append(hashes[codes])  # noqa: B023
            learned[3].append(of("n").astype(np.int64))
    a, b, t, n = (np.concatenate(x) if x else np.zeros(0, np.uint64 if i < 3 else np.int64) for i, x in enumerate(learned))
    three, first, c3 = _summed(_mix(a, b, t), n)
    a, b, t = a[first], b[first], t[first]
    whole = a != _NONE
    heads2, _, total2 = _summed(_mix(a[whole], b[whole]), c3[whole])
    types2 = _summed(_mix(a[whole], b[whole]), np.ones(int(whole.sum())))[2]
    two, first, c2 = _summed(_mix(b, t), c3)
    b, t = b[first], t[first]
    heads1, _, total1 = _summed(b, c2)
    types1 = _summed(b, np.ones(len(b)))[2]
    ends, _, cont = _summed(np.concatenate([t, *lone]), np.concatenate([np.ones(len(t)), *(np.zeros(len(x)) for x in lone)]))
    columns: dict[str, list] = {f: [] for f in ("kind", "seq", "i", "tok", "h", *_COUNTS, "cont")}

    def put(size: int, **values) -> None:
        for name, out in columns.items():
            kind = {"kind": pa.int32(), "i": pa.int32(), "tok": pa.string()}.get(name, pa.int64())
            v = values.get(name)
            out.append(pa.nulls(size, kind) if v is None else v.cast(kind) if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, kind))

    put(len(ends), kind=np.ones(len(ends), np.int32), h=ends.view(np.int64), cont=cont)
    for rows in asked:
        rows = rows.combine_chunks()
        x, y, z = (rows.column(c).to_numpy() for c in ("a", "b", "t"))
        seen1, (all1, kinds1) = _looked_up(y, (heads1, total1), (heads1, types1))
        seen2, (all2, kinds2) = _looked_up(_mix(x, y), (heads2, total2), (heads2, types2))
        seen2 &= x != _NONE
        got1, got2 = _looked_up(_mix(y, z), (two, c2))[1][0], _looked_up(_mix(x, y, z), (three, c3))[1][0]
        null = lambda v, seen: pa.array(v, pa.int64(), mask=~seen)
        put(len(x), kind=np.zeros(len(x), np.int32), seq=rows.column("seq").combine_chunks(), i=rows.column("i").combine_chunks(), tok=rows.column("tok").combine_chunks(), h=z.view(np.int64), c1=got1, total1=null(all1, seen1), types1=kinds1, c2=got2, total2=null(all2, seen2), types2=kinds2)
    return pa.table({f: pa.chunked_array([c for o in v for c in (o.chunks if isinstance(o, pa.ChunkedArray) else [o])]) for f, v in columns.items()})


def held_counts(rows: DataFrame) -> DataFrame:
    """seq, i, tok of each token of held-out ``rows`` (seq, text, held_out), the end included, and the others' counts for it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = rows.select("seq", "held_out", F.lower("text").alias("text"))
    made = low.mapInArrow(_blocks(parts), "part int, kind int, words binary, payload binary")
    made = stored(made.groupBy("part").applyInArrow(_counted, SCHEMA), "held-counts")
    cont = made.where("kind = 1").groupBy("h").agg(F.sum("cont").alias("cont"))
    sums = cont.agg(F.coalesce(F.sum("cont"), F.lit(0)).alias("cont_total"), (F.count(F.lit(1)) + SPECIALS).alias("v"))
    return made.where("kind = 0").drop("cont", "kind").join(cont, "h", "left").join(F.broadcast(sums), F.lit(True)).drop("h")


def probability(orders: int = 3, discount: float = K.DISCOUNT) -> Column:
    """Interpolated absolute discounting over the columns of :func:`held_counts`; unseen contexts are passed over."""
    p = (F.coalesce("cont", F.lit(0)) + 1.0) / (F.col("cont_total") + F.col("v"))
    for n in range(1, orders):
        c, total, types = (F.col(f"{x}{n}") for x in ("c", "total", "types"))
        better = F.greatest(c - discount, F.lit(0.0)) / total + discount * types / total * p
        p = F.when(total.isNotNull(), better).otherwise(p)
    return p
