"""Near copies by the similarity of their word shingles, found by SimHash and banded min-hashes and verified on the shingles.

Two texts link when the Jaccard similarity of their sets of five-word shingles is at least 4/5; a component keeps its
least doc_id. Candidates are the members of a component of operator 4 (SimHash, covering LSH), and, as most pairs at 0.8 have
fingerprints further apart than its four bits, those that share one of ``BANDS`` bands of ``ROWS`` min-hashes: a pair at 0.8 is missed with a chance of
(1 - 0.8^5)^32 = 3e-6, one at 0.9 with 2e-13. No pair links unverified: the sets of a bucket's texts are compared in
whole numbers. Buckets of the same texts (copies agree in many bands) are verified once, and what was reached is never
compared again, so a dense bucket takes few passes. A bucket's sets lie in one task, 8 bytes a distinct shingle.

Words are cut at ASCII blanks with A-Z lowered, as for SimHash; shingles are told apart by 64-bit hashes.

Defined results: null, empty and blank texts have no shingle and are copies of one another; fewer words than a shingle
make one shingle; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, one_each, text_chunks
from corpusmill.llm.lm_score import hashes, mix, tokens_of
from corpusmill.llm.simhash import components, simhash_components

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
#: Min-hashes of so many shingles at a time.
BLOCK = 512
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
FACTORS, SHIFTS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted 64-bit hashes."""
    bounds, codes, distinct = tokens_of(texts)
    words = hashes(distinct)[codes]
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), (bounds[1:] - 1).tolist(), strict=True):  # the end is no word
        own = words[lo:hi]
        k = min(shingle, len(own))
        made = np.zeros(max(0, len(own) - k + 1) if k else 0, np.uint64)
        for i in range(k):
            made = mix(made + own[i : i + len(made)])
        out.append(np.unique(made))
    return out


def digest(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band; texts without shingles have key 0 in all."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[at : at + BLOCK, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T if len(shingles) else ():
        keys = mix(keys + row)
    return keys.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, node (the digest of its shingles), the keys of its bands, and ``more`` columns of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            sets = shingle_sets(part.column("text"))
            keys = [band_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([digest(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), *map(part.column, more)], ["doc_id", "node", "keys", *more])

    schema = ", ".join(["doc_id long, node long, keys array<long>", *(f"{c} long" for c in more)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more).mapInArrow(run, schema)


def buckets(rows: DataFrame) -> DataFrame:
    """(bucket, node) of buckets of two nodes or more; a bucket is named by its nodes, so equal ones fall together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)  # the bucket that is still open: band, key, node

        def named(found: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((np.diff(found[0]) != 0) | (np.diff(found[1]) != 0)) + 1
            many = [x for x in np.split(found[2], cuts) if len(x) > 1]
            if many:
                names = np.array([digest(x) for x in many], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(x) for x in many])), pa.array(np.concatenate(many))], ["bucket", "node"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "key", "node")])], axis=1)
            open_at = int(np.argmax((held[0] == held[0, -1]) & (held[1] == held[1, -1])))
            yield from named(held[:, :open_at])
            held = held[:, open_at:]
        yield from named(held)

    each = rows.select("node", F.posexplode("keys").alias("band", "key")).select("band", "key", "node")
    return each.repartition("band", "key").sortWithinPartitions("band", "key", "node").mapInArrow(run, "bucket long, node long")


def similar_stars(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> np.ndarray:
    """For each set the least index of its connected part, linking sets of at least this similarity."""
    root, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    flat, ends = np.concatenate(sets), np.cumsum(size)
    left = np.arange(len(sets))
    while len(left):
        first, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            own = sets[queue.pop()]
            small, large = np.minimum(size[left], len(own)), np.maximum(size[left], len(own))
            near = small * least[1] >= large * least[0]  # others cannot be similar enough
            if len(own) and near.any():
                asked = left[near]
                values = np.concatenate([sets[i] for i in asked.tolist()]) if len(asked) < len(sets) else flat
                stops = np.cumsum(size[asked]) if len(asked) < len(sets) else ends
                hits = np.concatenate(([0], np.cumsum(own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values)))
                common = np.diff(np.concatenate(([0], hits[stops])))
                near[near] = common * sum(least) >= (size[asked] + len(own)) * least[0]
            if near.any():
                found = left[near]
                root[found] = first
                queue.extend(found.tolist())
                left = left[~near]
    return root


def verified(members: DataFrame) -> DataFrame:
    """Links (a, b) from rows (bucket, node, shingles) sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            root = similar_stars(sets) if nodes else np.empty(0, int)
            linked = np.flatnonzero(root != np.arange(len(root)))
            if len(linked):
                own = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[root[linked]]), pa.array(own[linked])], ["a", "b"])

        for batch in batches:
            for b, node, s in zip(batch.column("bucket").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles"), strict=True):
                if b != bucket:
                    yield from links()
                    bucket, nodes, sets = b, [], []
                nodes.append(node)
                sets.append(np.frombuffer(s.as_py(), np.uint64))
        yield from links()

    return members.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long")


def shingles_of(docs: DataFrame) -> DataFrame:
    """node and its shingles of (doc_id, text), 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            sets = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, node (the digest of its shingles), component_id (the least doc_id reachable)."""
    rows = materialize(sketches(docs, id_col, text_col), "shingle-sketches")
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("doc_id", "keys")).alias("x")).select("node", "x.doc_id", "x.keys"), "shingle-nodes")
    # candidates: SimHash components, and the bands for pairs whose fingerprints lie further apart
    prints = materialize(simhash_components(docs, id_col=id_col, text_col=text_col), "shingle-simhash").select("doc_id", "component_id").distinct()
    near = nodes.select("node", "doc_id").join(prints.hint("merge"), "doc_id").select(F.col("component_id").alias("bucket"), "node")
    many = near.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    near = near.join(many, "bucket", "left_semi")
    members = materialize(buckets(nodes).unionByName(near.select(F.xxhash64(F.lit("simhash"), "bucket").alias("bucket"), "node")).distinct(), "shingle-buckets")
    asked = nodes.join(members.select("node").distinct().hint("merge"), "node", "left_semi").select(F.col("doc_id").alias("__asked"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(asked.hint("merge"), F.col("doc_id") == F.col("__asked"), "left_semi")
    sets = materialize(shingles_of(texts).dropDuplicates(["node"]), "shingle-sets")
    links = verified(members.join(sets.hint("merge"), "node")).distinct()
    linked = components(links)
    least = nodes.join(linked, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = materialize(least, "shingle-components")
    named = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = least.join(named.hint("merge"), "component").select("node", "component_id")
    return rows.select("doc_id", "node").join(labels.hint("merge"), "node").select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one row of each component, with all their columns; rows may repeat a doc_id."""
    found = materialize(shingle_components(docs, id_col, text_col).withColumn("kept", F.col("doc_id") == F.col("component_id")), "shingle-dedup")
    named = found.select("node", F.col("component_id").alias("group")).distinct()

    def grouped(many: DataFrame, row: str) -> DataFrame:
        own = sketches(many, id_col, text_col, row).join(named.hint("merge"), "node")
        return own.withColumns({"kept": F.col("doc_id") == F.col("group"), "worse": F.lit(0)})

    return one_each(docs, found, grouped, id_col)
