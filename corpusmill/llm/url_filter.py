"""URL filtering by a cascade of Bloom filters, with DataFrame functions only.

The first filter holds the listed keys. Of the corpus's complete key universe, the keys that pass it without being
listed go into the second filter, the listed ones that pass the second into the third, and so on until a level has no
false positive. The first level that misses a key then tells exactly whether it is listed, for every key of the
universe, without a join. The filters travel as literals inside the plan. A list too long for ``MOST_BITS`` is cut into
parts by a hash of the key, each with a cascade of its own, and the urls are asked for one part after another; the
method and the rows are the same.

Rules name a host and the start of a path, and fit the host and its subdomains. A url's candidate keys are its host's
suffixes with its path's prefixes of the lengths that rules have; the longest listed one wins.

Defined results: null urls and urls without ``://`` have an empty host and path and no rule; ties in length go to the
longer host; of rules with the same host and path, block wins; rules without a host, or with a verdict other than block
and allow, fit nothing, and a null path is an empty one; repeated rows are judged each; an empty table gives an empty
result; without rules all urls get the default verdict; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import let, lower_ascii, materialize

MOST_BITS = 1 << 23


@dataclass
class BloomLevel:
    bits: int
    probes: int
    seed: int
    words: list[int]

    def positions(self, key: Column) -> list[Column]:
        h = F.xxhash64(key, F.lit(self.seed))
        first, step = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
        return [(first + step * i) % self.bits for i in range(self.probes)]

    def has(self, key: Column) -> Column:
        # a constant that is parsed once, when the plan is made, and bound once for all probes
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")

        def probed(bound: Column) -> Column:
            out = F.lit(True)
            for p in self.positions(key):
                out = out & (F.getbit(F.element_at(bound, (p / 64).cast("int") + 1), (p % 64).cast("int")) == 1)
            return out

        return let(words, probed)


def bits_for(n: int, rate: float) -> int:
    return 64 * max(1, math.ceil(n * 1.4427 * math.log2(1 / rate) / 64))


def bloom(keys: DataFrame, n: int, rate: float, seed: int) -> BloomLevel:
    """The filter of the distinct ``key`` column."""
    bits = bits_for(n, rate)
    level = BloomLevel(bits, max(1, round(math.log2(1 / rate))), seed, [])
    spots = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    rows = spots.select((F.col("p") / 64).cast("int").alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()  # bits / 64 numbers
    found = {r.w: r.b for r in rows}
    level.words = [found.get(i, 0) for i in range(bits // 64)]
    return level


def first_rate(listed: int, universe: int) -> float:
    """The first level's rate of false positives; those after it have one half."""
    return min(0.5, max(1e-9, listed * math.sqrt(0.5) / max(1, universe)))


class Cascade:
    """Exact membership of the universe's keys in a list."""

    def __init__(self, levels: list[BloomLevel]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """From two frames with distinct ``key``; the universe may hold the listed keys, too."""
        listed = materialize(listed.select("key"), "cascade-listed")
        n, universe_n = listed.count(), universe.count()
        if not n:
            return cls([])
        rate = first_rate(n, universe_n)
        levels, into, others = [], listed, universe.select("key").join(listed, "key", "left_anti")
        while n:
            level = bloom(into, n, rate, len(levels))
            levels.append(level)
            wrong = materialize(others.where(level.has(F.col("key"))), "cascade-level")
            into, others, rate, n = wrong, into, 0.5, wrong.count()
        return cls(levels)

    def has(self, key: Column) -> Column:
        """Whether the key is listed: the first level that misses it decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys a url could be listed by, longest first: array<struct<size,host_size,key>>."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    made = F.array().cast("array<struct<size:int,host_size:int,key:string>>")
    for n in lengths:
        start = F.substring(path, 1, n)
        of = F.transform(suffixes, lambda s: F.struct((F.length(s) + F.length(start)).alias("size"), F.length(s).alias("host_size"), F.concat(s, start).alias("key")))  # noqa: B023
        made = F.concat(made, F.when((F.length(path) >= n) & (host != ""), of).otherwise(F.array().cast("array<struct<size:int,host_size:int,key:string>>")))
    return F.sort_array(made, asc=False)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each url: id, host, path, rule, verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``); what no rule fits gets ``default``.
    """
    path = F.coalesce("path", F.lit(""))
    made = rules.where("host is not null and verdict in ('block', 'allow')").select(F.concat(lower_ascii(F.col("host")), path).alias("key"), F.length(path).alias("n"), "verdict")
    # the greater word is block
    listed = materialize(made.groupBy("key").agg(F.max("n").alias("n"), F.max("verdict").alias("verdict")), "url-rules")
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())  # as many as rules have path lengths
    host, path = url_parts(F.col(url_col))
    urls = materialize(pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path")), "urls")
    made = urls.withColumn("made", candidates(F.col("host"), F.col("path"), lengths))
    universe = materialize(made.select(F.explode("made.key").alias("key")).distinct(), "url-universe")

    n, universe_n = listed.count(), universe.count()
    # a level after the first has about half the bits of the one before it
    parts = max(1, -(-3 * bits_for(n, first_rate(n, universe_n)) // MOST_BITS)) if n else 1
    part_of = lambda key: F.pmod(F.xxhash64(key, F.lit(parts)), F.lit(parts))
    if parts > 1:
        made = made.withColumn("fits", F.array().cast("array<struct<size:int,host_size:int,key:string,verdict:string>>"))
    for i in range(parts):
        own, asked = (x.where(part_of(F.col("key")) == i) if parts > 1 else x for x in (listed, universe))
        block, allow = (Cascade.build(own.where(F.col("verdict") == v), asked) for v in ("block", "allow"))
        judged = F.transform("made", lambda c: F.struct(c["size"].alias("size"), c["host_size"].alias("host_size"), c["key"].alias("key"), F.when(block.has(c["key"]), "block").when(allow.has(c["key"]), "allow").alias("verdict")))  # noqa: B023
        fits = F.filter(judged, lambda c: c["verdict"].isNotNull())
        if parts > 1:
            mine = F.filter(fits, lambda c: part_of(c["key"]) == i)  # noqa: B023
            made = materialize(made.withColumn("fits", F.concat("fits", mine)), "url-part")
    best = F.try_element_at(F.sort_array(F.col("fits"), asc=False) if parts > 1 else fits, F.lit(1))
    judged = made.select(id_col, "host", "path", best.alias("best"))
    return judged.select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
