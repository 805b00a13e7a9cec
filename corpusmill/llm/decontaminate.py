"""Benchmark decontamination by winnowing, with DataFrame functions only.

From every text and item the hashes of its k-grams of words are taken, and of each w consecutive hashes the least one
is kept as a fingerprint. A window of L words has L-k+1 = w such hashes, so any shared span of L words shares a
fingerprint: none is missed. Fingerprints of documents are met with those of the benchmark, and each hit is extended to
the windows of L words around it, which are compared as text; hash collisions cannot give false hits.

A document is winnowed only if any of its k-grams is a fingerprint of the benchmark; the others cannot share a span.

The benchmark's fingerprints are counted. Up to ``literal_limit`` they become a set inside the scan, so that clean
documents are never shuffled; more are joined by hash, behind a Bloom filter of at most 1 MB that keeps most hashes of
clean documents out of the exchange. Rows are the same either way.

Defined results: null text has no words, neither has an empty one; such items have no window; an item of fewer words
than a window is one window as a whole; repeated items count each under its own id; an item_id on several rows
counts once; rows that repeat a doc_id are judged each by its own text; an empty benchmark marks nothing; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import LOWER, UPPER, by_row, let, materialize
from corpusmill.llm.url_filter import MOST_BITS, bloom

#: ASCII but letters and digits; all else belongs to words.
SEPARATORS = "".join(map(chr, range(0x80))).translate(dict.fromkeys([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]))


def words_of(text: Column) -> Column:
    """The lower-cased words, in order; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def grams(words: Column, k: int) -> Column:
    """Hashes of every k consecutive words; empty if there are fewer."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def winnowed(hashes: Column, w: int) -> Column:
    """The distinct least hashes of every w consecutive ones; of fewer, the least of all."""
    if w == 1:
        return F.array_distinct(hashes)
    least = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes) - (w - 1), F.lit(1))), lambda i: F.array_min(F.slice(hashes, i, w)))
    return F.when(F.size(hashes) > 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def spans(words: Column, n: Column | int) -> Column:
    """The runs of n consecutive words with their starts: array<struct<start,window>>."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.struct((i - 1).alias("start"), F.array_join(F.slice(words, i, n), " ").alias("window")))


def benchmark_windows(benchmark: DataFrame, length: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n (words in the window), window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    items = materialize(items.withColumn("n", F.least(F.size("w"), F.lit(length))), "benchmark-words")
    return items.select("item_id", "n", F.explode(spans(F.col("w"), F.col("n"))).alias("s")).select("item_id", "n", F.col("s.window").alias("window")).distinct()


def _around(words: Column, k: int, n: int, hits: Column) -> Column:
    """The windows of n words that hold one of the k-grams at these places: array<struct<start,n,window>>."""
    w = n - k + 1
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(F.greatest(p - (w - 1), F.lit(1)), F.least(p, F.size(words) - (n - 1))))))
    found = F.transform(starts, lambda i: F.struct((i - 1).cast("long").alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("window")))
    return F.when((F.size(hits) > 0) & (F.size(words) >= n), found).otherwise(F.array().cast("array<struct<start:bigint,n:int,window:string>>"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, length: int = 10, k: int = 5, literal_limit: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = materialize(benchmark_windows(benchmark, length, item_col, item_text_col), "benchmark-windows")
    sizes = sorted(r.n for r in windows.select("n").distinct().collect())  # at most ``length`` of them
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def prints(n: int) -> DataFrame:
        kk = min(k, n)
        split = windows.where(F.col("n") == n).select(F.split("window", " ").alias("w"))
        return split.select(F.explode(winnowed(grams(F.col("w"), kk), n - kk + 1)).alias("fp")).distinct()

    known = {n: materialize(prints(n), "benchmark-prints") for n in sizes}
    counts = {n: f.count() for n, f in known.items()}
    small = sum(counts.values()) <= literal_limit
    chosen = {n: [r.fp for r in f.collect()] for n, f in known.items()} if small else {}
    if not small:
        base = _join_prints(materialize(base.withColumn("row", F.monotonically_increasing_id()), "decontaminate-texts"), known, counts, k)

    def places(hashes: Column, n: int) -> Column:
        """Where the document's winnowed fingerprints that the benchmark has stand."""
        kk = min(k, n)
        nowhere = F.array().cast("array<int>")
        if small:
            listed = lambda x: x.isin(chosen[n])
            shared = F.when(F.exists(hashes, listed), F.exists(winnowed(hashes, n - kk + 1), listed)).otherwise(F.lit(False))
            # the set is asked again for the places, in constant time each: more places than the winnowed ones do no harm
            return F.when(shared, F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda p: listed(F.element_at(hashes, p)))).otherwise(nowhere)
        got = F.col("wanted")[n]
        return F.when(got.isNotNull(), F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda p: F.array_contains(got, F.element_at(hashes, p)))).otherwise(nowhere)

    def row(words: Column) -> Column:
        found = F.array().cast("array<struct<start:bigint,n:int,window:string>>")
        for n in sizes:
            kk = min(k, n)
            found = F.concat(found, let(grams(words, kk), lambda h: let(places(h, n), lambda hits: _around(words, kk, n, hits))))  # noqa: B023
        return F.struct(F.size(words).cast("long").alias("n_words"), found.alias("candidates"))

    numbered = base if "row" in base.columns else base.withColumn("row", F.monotonically_increasing_id())
    scanned = materialize(numbered.select("row", "doc_id", let(words_of(F.col("text")), row).alias("r")), "decontaminate-scan")
    candidates = scanned.where(F.size("r.candidates") > 0).select("row", F.explode("r.candidates").alias("c")).select("row", "c.start", "c.n", "c.window")
    # distinct windows first: a passage that many items hold is one row here
    distinct_windows = windows.groupBy("n", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hits = materialize(candidates.join(distinct_windows, ["n", "window"]).select("row", "start", "n", "items"), "decontaminate-hits")
    # a word is hit if a window starts in the ``length`` words up to it: each start adds what the one before it leaves open
    spanned = hits.groupBy("row", "start").agg(F.max("n").alias("n"))
    covered = spanned.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("s"))
    n_hit = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
        lambda a: a["n"],
    )
    items = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = covered.select("row", n_hit.alias("n_hit")).join(items, "row")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return (
        scanned.select("row", "doc_id", F.col("r.n_words").alias("n_words"))
        .join(found, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def _join_prints(base: DataFrame, known: dict[int, DataFrame], counts: dict[int, int], k: int) -> DataFrame:
    """``base`` with ``wanted``: for each window length, the row's fingerprints that the benchmark has, found by a shuffled join."""
    words = words_of(F.col("text"))
    filters = {n: bloom(f.select(F.col("fp").alias("key")), counts[n], max(1e-3, 2 ** (-MOST_BITS / len(known) / 1.4427 / max(1, counts[n]) + 0.01)), n) for n, f in known.items()}

    def shown_for(n: int) -> Column:
        kk = min(k, n)
        maybe = filters[n]
        passed = lambda h: F.filter(winnowed(h, n - kk + 1), maybe.has) if maybe else winnowed(h, n - kk + 1)
        return F.struct(F.lit(n).alias("n"), let(words, lambda w: let(grams(w, kk), passed)).alias("fps"))

    shown = [shown_for(n) for n in known]
    if not shown:
        return base.withColumn("wanted", F.lit(None).cast("map<int,array<bigint>>"))
    mine = base.select("row", F.explode(F.array(*shown)).alias("s")).select("row", "s.n", F.explode("s.fps").alias("fp"))
    listed = None
    for n, f in known.items():
        part = f.select(F.lit(n).alias("n"), "fp")
        listed = part if listed is None else listed.unionByName(part)
    got = mine.join(listed.hint("merge"), ["n", "fp"]).groupBy("row", "n").agg(F.collect_set("fp").alias("fps"))
    wanted = materialize(got.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("n", "fps"))).alias("wanted")), "decontaminate-wanted")
    return base.join(wanted, "row", "left")


def keep_clean(docs: DataFrame, benchmark: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that share no window with the benchmark, with all their columns; rows may repeat a doc_id."""

    def judged(rows: DataFrame, ids: str) -> DataFrame:
        return contamination(rows, benchmark, length, id_col=ids, text_col=text_col).select("doc_id", (~F.col("contaminated")).alias("kept"))

    return by_row(docs, materialize(judged(docs, id_col), "decontaminate-verdicts"), lambda many, row: judged(many, row).where("kept").select(F.col("doc_id").alias(row)), id_col)
