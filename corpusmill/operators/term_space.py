"""Random-indexing vectors and sketches of all phrases without exchanging pairs of phrases.

A task adds up its terms' vectors in arrays and sends each part of the terms one compressed block; the parts add those up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators.models import PLANES, index_entries, planes
from corpusmill.operators.ngram_model import _packed, _unpacked

#: Phrases that a task adds up at a time, and terms whose vectors are dense at once.
FLUSH, DENSE = 1 << 21, 1 << 14


def _neighbours(lists: pa.ListArray, codes: np.ndarray, window: int = K.WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """term, neighbour and weight of each pair of places, by term; direct neighbours count 2."""
    sentence = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    term, other, weight = [], [], []
    for d in range(1, window + 1):
        at = np.flatnonzero(sentence[d:] == sentence[:-d])
        a, b = codes[at], codes[at + d]
        term += [a, b]
        other += [b, a]
        weight.append(np.full(2 * len(at), 2 if d == 1 else 1, np.int64))
    term, other, weight = np.concatenate(term), np.concatenate(other), np.concatenate(weight)
    order = np.argsort(term, kind="stable")
    return term[order], other[order], weight[order]


def _blocks(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            lists = pa.concat_arrays(held)
            found = lists.flatten().dictionary_encode()
            names = found.dictionary.to_pylist()
            part = np.array([xxhash.xxh64_intdigest(t.encode(), 7) % parts for t in names])
            by_part = np.argsort(part, kind="stable")  # a part's terms follow each other
            place = np.empty(len(names), np.int64)
            place[by_part] = np.arange(len(names))
            own = np.array([index_entries(names[i]) for i in by_part]).reshape(len(names), K.NONZERO, 2)
            term, other, weight = _neighbours(lists, place[found.indices.to_numpy(zero_copy_only=False)])
            part, names = part[by_part], [names[i] for i in by_part]
            for p in np.unique(part).tolist():
                lo, hi = np.searchsorted(part, [p, p + 1]).tolist()
                for at in range(lo, hi, DENSE):
                    end = min(at + DENSE, hi)
                    x, y = np.searchsorted(term, [at, end])
                    cells, sums, touched = (end - at) * K.DIMENSIONS, 0, 0
                    for j in range(K.NONZERO):
                        cell = (term[x:y] - at) * K.DIMENSIONS + own[other[x:y], j, 0]
                        sums = sums + np.bincount(cell, weight[x:y] * own[other[x:y], j, 1], cells)
                        touched = touched + np.bincount(cell, minlength=cells)
                    hit = np.flatnonzero(touched)
                    n = np.bincount(hit // K.DIMENSIONS, minlength=end - at).astype(np.int32)
                    payload = _packed(dim=pa.array((hit % K.DIMENSIONS).astype(np.uint8)), x=pa.array(sums[hit].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(term=pa.array(names[at:end], pa.string()), n=n)], pa.binary()), pa.array([payload], pa.binary())], ["part", "terms", "payload"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column("p"))
                size += len(batch.column("p").flatten())
            if size >= FLUSH:
                yield from summed(held)
                held, size = [], 0
        if size:
            yield from summed(held)

    return run


def _added(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A part's terms, the sorted cells (term and dimension) of their vectors, and the sums there."""
    names, codes, dims, sums = [], [], [], []
    for terms, payload in zip(table.column("terms"), table.column("payload"), strict=True):
        t, rows = _unpacked(terms.as_py()), _unpacked(payload.as_py())
        names.append(t.column("term").combine_chunks())
        codes.append(t.column("n").to_numpy())
        dims.append(rows.column("dim").to_numpy())
        sums.append(rows.column("x").to_numpy())
    found = pa.concat_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in names]).dictionary_encode()
    code = np.repeat(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(codes))
    cell, first = code * K.DIMENSIONS + np.concatenate(dims), np.concatenate(sums)
    cells, back = np.unique(cell, return_inverse=True)
    return found.dictionary, cells, np.bincount(back.ravel(), first, len(cells)).astype(np.int64)


def _vectors(table: pa.Table) -> pa.Table:
    names, cells, x = _added(table)
    return pa.table({"term": names.take(pa.array(cells // K.DIMENSIONS)), "dim": cells % K.DIMENSIONS, "x": x})


def _sketches(table: pa.Table) -> pa.Table:
    names, cells, x = _added(table)
    sides = np.zeros((K.DIMENSIONS, PLANES))
    for j, (plus, minus) in enumerate(planes()):
        sides[plus, j], sides[minus, j] = 1, -1
    bit = np.uint64(1) << np.arange(PLANES - 1, -1, -1, dtype=np.uint64)
    out = []
    for at in range(0, len(names), DENSE):
        end = min(at + DENSE, len(names))
        lo, hi = np.searchsorted(cells, [at * K.DIMENSIONS, end * K.DIMENSIONS])
        dense = np.zeros((end - at) * K.DIMENSIONS)
        dense[cells[lo:hi] - at * K.DIMENSIONS] = x[lo:hi]  # whole numbers, so sums are exact
        out.append(((dense.reshape(-1, K.DIMENSIONS) @ sides > 0) * bit).sum(axis=1, dtype=np.uint64).view(np.int64))
    return pa.table({"term": names, "sketch": np.concatenate(out)})


def _of(rows: DataFrame, made: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    phrases = rows.select(T.phrases("text").alias("p")).where("size(p) >= 2")
    return phrases.mapInArrow(_blocks(parts), "part int, terms binary, payload binary").groupBy("part").applyInArrow(made, schema)


def vectors(rows: DataFrame) -> DataFrame:
    """term, dim, x as :func:`models.term_vectors` of the phrases of ``rows`` (text) and their neighbours."""
    return _of(rows, _vectors, "term string, dim long, x long")


def sketches(rows: DataFrame) -> DataFrame:
    """term and its 64-bit sketch as :func:`models.sketches` of those vectors."""
    return _of(rows, _sketches, "term string, sketch long")
