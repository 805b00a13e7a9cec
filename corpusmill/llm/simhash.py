"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints link when they differ in at most ``radius`` bits. The masks of a covering family guarantee that every such
pair agrees under some mask: each bit position i gets a vector f(i) of radius+1 bits, and for every non-zero vector v
the mask keeps the positions where f(i).v is odd. The f(i) of at most ``radius`` differing positions never span the
whole space, so some v is orthogonal to all of them, and its mask hides every difference.

Only distinct fingerprints are hashed, so copies cost nothing. A bucket hands out a star for each connected part, never
its pairs. A bucket of more than ``bucket_cap`` fingerprints is split by a second covering family over the bits that
the first mask hid, which keeps every link; the parts then agree in so many bits that their size has a fixed bound.
Links become components by alternating stars over the distributed link table.

Defined results: null and empty texts, and texts of blanks, have fingerprint zero and link like others; fewer words
than a shingle make one shingle; repeated rows and ties share a fingerprint and so a component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, one_each, text_chunks

SEED = 42
#: Hashes are added up in blocks of so many.
BLOCK = 4096


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in more than half of the shingles' XXH64."""
    words = text.lower().split() if text else []  # bytes: A-Z and the ASCII blanks only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    ends = ends[k - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, and ``more`` columns of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp, pa.int64()), *map(part.column, more)], ["doc_id", "fp", *more])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in more)]))


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """The covering family's masks over the given bit positions, as unsigned 64-bit numbers."""
    vectors = range(1, 1 << (radius + 1))
    of = {p: vectors[i % len(vectors)] for i, p in enumerate(positions)}
    return [sum(1 << p for p, f in of.items() if (f & v).bit_count() & 1) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value the least index of its connected part, linking values that differ in at most ``radius`` bits.

    Values that were reached are never compared again, so a dense bucket takes few passes; memory is linear.
    """
    root = np.arange(len(values))
    left = np.arange(len(values))
    while len(left):
        first, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(values[left] ^ values[queue.pop()]) <= radius
            if near.any():
                found = left[near]
                root[found] = first
                queue.extend(found.tolist())
                left = left[~near]
    return root


def bucket_links(buckets: DataFrame, radius: int, cap: int) -> DataFrame:
    """Links from rows (mask, key, fp, node) sorted by bucket: (a, b, fp, mask, key).

    Rows with b null are the members of buckets over ``cap``, handed on as they are for a finer split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the bucket that is still open, as columns mask, key, fp, node
        n, over = 0, None

        def out(a: np.ndarray, b: np.ndarray | None, rows: np.ndarray) -> pa.RecordBatch:
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(rows[2]), pa.array(rows[0].astype(np.int32)), pa.array(rows[1])], ["a", "b", "fp", "mask", "key"])

        def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of whole buckets, each at most ``cap`` rows."""
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            bounds = np.concatenate(([0], change, [rows.shape[1]]))
            sizes = np.diff(bounds)
            firsts, seconds = [], []
            at = bounds[:-1][sizes == 2]
            near = at[np.bitwise_count((rows[2, at] ^ rows[2, at + 1]).view(np.uint64)) <= radius]
            firsts.append(near), seconds.append(near + 1)
            for i in np.flatnonzero(sizes > 2).tolist():
                lo, hi = bounds[i], bounds[i + 1]
                root = stars(rows[2, lo:hi].view(np.uint64), radius)
                linked = np.flatnonzero(root != np.arange(hi - lo))
                firsts.append(lo + root[linked]), seconds.append(lo + linked)
            a, b = np.concatenate(firsts), np.concatenate(seconds)
            if len(a):
                yield out(rows[3, a], rows[3, b], rows[:, a])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "fp", "node")])
            if not rows.shape[1]:
                continue
            if over is not None:
                same = (rows[0] == over[0]) & (rows[1] == over[1])
                stay = int(np.argmin(same)) if not same.all() else rows.shape[1]
                if stay:
                    yield out(rows[3, :stay], None, rows[:, :stay])
                if stay == rows.shape[1]:
                    continue
                rows, over = rows[:, stay:], None
            if held:
                rows = np.concatenate([*held, rows], axis=1)
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            open_at = int(np.argmax(last))
            sizes = np.diff(np.concatenate(([0], np.flatnonzero((np.diff(rows[0, :open_at]) != 0) | (np.diff(rows[1, :open_at]) != 0)) + 1, [open_at]))) if open_at else np.empty(0, int)
            if (sizes > cap).any():
                big = np.repeat(sizes > cap, sizes)
                yield out(rows[3, :open_at][big], None, rows[:, :open_at][:, big])
                if (~big).any():
                    yield from links(rows[:, :open_at][:, ~big])
            elif open_at:
                yield from links(rows[:, :open_at])
            rest = rows[:, open_at:]
            held, n = [rest], rest.shape[1]
            if n > cap:
                yield out(rest[3], None, rest)
                over, held, n = (rest[0, 0], rest[1, 0]), [], 0
        if n:
            yield from links(held[0])

    return buckets.mapInArrow(run, "a long, b long, fp long, mask int, key long")


def masked(rows: DataFrame, masks: list[int], prefix: int = 0) -> DataFrame:
    """One row for each mask: (mask, key, fp, node), sorted so that a bucket's rows follow each other."""
    numbered = F.array(*[F.struct(F.lit(prefix + i).alias("mask"), F.lit(signed(m)).alias("bits")) for i, m in enumerate(masks)])
    out = rows.select("fp", "node", F.explode(numbered).alias("m")).select(F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.bits")).alias("key"), "fp", "node")
    return out.repartition("mask", "key").sortWithinPartitions("mask", "key")


def fingerprint_links(nodes: DataFrame, radius: int = 4, bucket_cap: int = 1 << 16) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of (node, fp) rows within ``radius`` bits."""
    masks = covering_masks(radius, list(range(64)))
    found = materialize(bucket_links(masked(nodes, masks), radius, bucket_cap), "simhash-links")
    links = found.where("b is not null").select("a", "b")
    hot = found.where("b is null").select("fp", F.col("a").alias("node"), "mask")
    for i in [r.mask for r in hot.select("mask").distinct().collect()]:  # at most one for each mask of the family
        finer = covering_masks(radius, [p for p in range(64) if not masks[i] >> p & 1])
        part = hot.where(F.col("mask") == i).select("fp", "node")
        # what agrees under mask i and the finer mask differs in the few bits that both hide
        again = masked(part, [masks[i] | m for m in finer])
        links = links.unionByName(bucket_links(again, radius, 1 << 62).where("b is not null").select("a", "b"))
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node of each linked node's component, by alternating large and small stars.

    A node's least neighbour comes from a map-side aggregation and a join that Spark may split where it is skewed, so
    a hub's links never meet in one task. Each round is written to the shared folder. Rounds go on until one changes
    nothing, which takes of the order of log(n)^2 of them: each makes every node point at a lesser one, or at the least.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()

    pairs, before = materialize(links.where("a != b").distinct(), "cc"), None
    while True:
        pairs = materialize(star(star(pairs, True), False), "cc")
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = (now.n, now.h)


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, bucket_cap: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable)."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    linked = components(fingerprint_links(nodes, radius, bucket_cap))
    labels = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labels.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one row of each component, with all their columns; rows may repeat a doc_id."""
    found = materialize(simhash_components(docs, shingle, radius, id_col=id_col, text_col=text_col).withColumn("kept", F.col("doc_id") == F.col("component_id")), "simhash-dedup")
    named = found.select(F.col("fingerprint").alias("__fp"), F.col("component_id").alias("group")).distinct()

    def grouped(many: DataFrame, row: str) -> DataFrame:
        own = fingerprints(many, shingle, id_col, text_col, row).withColumn("__fp", F.lower(F.lpad(F.hex("fp"), 16, "0")))
        return own.join(named.hint("merge"), "__fp").select(row, "group", (F.col("doc_id") == F.col("group")).alias("kept"), F.lit(0).alias("worse"))

    return one_each(docs, found, grouped, id_col)
