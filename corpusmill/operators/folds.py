"""Running states over each key's events, in order, without gathering a key's whole log anywhere.

The steps must compose: a block of events becomes one function of the state before it, and a key's blocks are then
applied one after another. A block holds the events whose order numbers share a quotient, so its size is bounded by
``BLOCK`` where order numbers do not repeat; a key with n events has at most n / ``BLOCK`` block states, or as many as
its events span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536


def folded(log: DataFrame, key: str, order: str, values: list[str], same: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], start: Column, block: int = BLOCK) -> DataFrame:
    """``key`` and ``state``: ``start`` after all events of the key.

    ``same`` is the function that changes nothing, as a struct; ``step(f, event)`` is f followed by the event's own
    function; ``out(f, state)`` applies f.
    """
    events = log.withColumn("_block", F.floor(F.col(order) / block))
    lists = events.groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *values))).alias("e"))
    functions = lists.select(key, "_block", F.aggregate("e", same, step).alias("f"))
    chains = functions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", "f"))).alias("fs"))
    return chains.select(key, F.aggregate("fs", start, lambda a, x: out(x["f"], a)).alias("state"))


def affine(cap: float | None = None) -> tuple[Column, Callable[[Column, float | Column, Column], Column], Callable[[Column, Column], Column]]:
    """States moved by x -> min(cap, a x + b): the identity, the step for (f, a, b), and the application."""
    high = F.lit(float("inf") if cap is None else cap)
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("inf")).alias("c"))

    def step(f: Column, a: float | Column, b: Column) -> Column:
        return F.struct((f["a"] * a).alias("a"), (f["b"] * a + b).alias("b"), F.least(high, f["c"] * a + b).alias("c"))

    return same, step, lambda f, x: F.least(f["c"], f["a"] * x + f["b"])


def clamps() -> tuple[Column, Callable[[Column, Column, Column, Column], Column], Callable[[Column, Column], Column]]:
    """States moved by x -> max(low, min(high, x + d)): the identity, the step for (f, d, low, high), and the application."""
    same = F.struct(F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))

    def step(f: Column, d: Column, low: Column, high: Column) -> Column:
        clip = lambda x: F.greatest(low, F.least(high, x))
        return F.struct((f["d"] + d).alias("d"), clip(f["low"] + d).alias("low"), clip(f["high"] + d).alias("high"))

    return same, step, lambda f, x: F.greatest(f["low"], F.least(f["high"], x + f["d"]))
