"""What adapts to yield and feedback: source health, strategies, intervals, interests, frontier, trends, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import folds
from corpusmill.operators.store import stored


def means(log: DataFrame, key: str, order: str, value: str, keep: float) -> DataFrame:
    """``key`` and ``state``, the exponential mean of each key's values in order; the first that is not zero starts it (none is negative)."""
    same, step, put = folds.affine()
    firsts = log.where(F.col(value) != 0).groupBy(key).agg(F.min(order).alias("_first"))
    rows = log.join(firsts, key).where(F.col(order) >= F.col("_first"))
    first = F.col(order) == F.col("_first")
    moves = rows.select(key, order, F.when(first, 0.0).otherwise(keep).alias("a"), (F.col(value) * F.when(first, 1.0).otherwise(1 - keep)).cast("double").alias("b"))
    return folds.folded(moves, key, order, ["a", "b"], same, lambda f, e: step(f, e["a"], e["b"]), put, F.lit(0.0))


def surprise_value(mean: Column) -> Column:
    """How much a source teaches, by how surprising it is."""
    return F.when(mean.isNull(), 0.5).when(mean < 1, 0.2).when(mean > 6, 0.3).when(mean.between(2, 5), 1.0).otherwise(0.7)


def source_health(log: DataFrame) -> DataFrame:
    """source, tries, ok, latency, value, score of visits (source, seq, ok, learned, new_terms, latency, surprise)."""
    gain, novelty = F.least(F.col("learned"), F.lit(400)) / 100, F.least(F.col("new_terms"), F.lit(2000)) / 200
    rows = log.groupBy("source").agg(F.count(F.lit(1)).alias("tries"), F.sum(F.col("ok").cast("int")).alias("ok"), F.sum(gain).alias("gain"), F.sum(novelty).alias("novelty"))
    for c in ("latency", "surprise"):
        rows = rows.join(means(log.select("source", "seq", c), "source", "seq", c, 0.8).withColumnRenamed("state", c), "source", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("latency", "surprise")})
    value = surprise_value(F.col("surprise"))
    score = (F.col("ok") + 1) / (F.col("tries") + 2) * (F.col("gain") / F.col("tries") + F.col("novelty") / F.col("tries") + 0.5) * (0.5 + value)
    return rows.select("source", "tries", "ok", F.round("latency", 6).alias("latency"), value.alias("value"), F.round(score, 6).alias("score"))


def strategy_scores(log: DataFrame) -> DataFrame:
    """strategy, tries, gain, ucb: mean gain and a bonus for what was seldom tried."""
    each = log.groupBy("strategy").agg(F.count(F.lit(1)).alias("tries"), F.sum(F.least(F.col("learned"), F.lit(400.0)) / 100).alias("gain"))
    total = each.agg((F.sum("tries") + 1).alias("total"))  # one row
    ucb = F.col("gain") / F.col("tries") + F.sqrt(2 * F.log("total") / F.col("tries"))
    return each.join(F.broadcast(total), F.lit(True)).select("strategy", "tries", F.round("gain", 6).alias("gain"), F.round(ucb, 6).alias("ucb"))


def adaptive_interval(gain: Column, base: float, partition: list[str], order: str) -> Column:
    """The next interval, by the mean gain of the last five cycles."""
    mean = F.avg(gain).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(-4, 0))
    return F.when(mean >= 100, base * 0.25).when(mean >= 20, base * 0.5).when(mean == 0, F.least(F.lit(600.0), F.lit(base * 4))).otherwise(base)


def interests(log: DataFrame) -> DataFrame:
    """topic and interest: min(5, old * 0.9 + weight), folded in order."""
    same, step, put = folds.affine(5.0)
    state = folds.folded(log, "topic", "seq", ["weight"], same, lambda f, e: step(f, 0.9, e["weight"]), put, F.lit(0.0))
    return state.select("topic", F.round("state", 6).alias("interest"))


def frontier(links: DataFrame, seen: DataFrame, most: int = 500, depth: int = 3) -> DataFrame:
    """The best unseen links by interest less depth."""
    rows = links.withColumn("priority", F.round(F.col("interest") - 0.3 * F.col("depth"), 6))
    rows = rows.where((F.col("depth") <= depth) & (F.col("priority") > -0.9) & F.length("anchor").between(1, 80)).join(seen.select("target").distinct(), "target", "left_anti")
    return rows.orderBy(F.desc("priority"), "seq").limit(most)


def walked(edges: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """node and depth: what links (a, b) reach from ``start`` (node) in some steps; each step's new nodes are written once."""
    now = start.withColumn("depth", F.lit(0).cast("long"))
    seen = now
    for depth in range(1, steps + 1):
        found = edges.join(now.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        now = stored(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "frontier")
        seen = seen.unionByName(now)
    return seen


def trend(value: Column, order: str, partition: list[str], span: int = 10) -> dict[str, Column]:
    """Means of the last ``span`` values and of those before, and whether the former is no better."""
    w = Window.partitionBy(*partition).orderBy(order)
    last, before = F.avg(value).over(w.rowsBetween(-span + 1, 0)), F.avg(value).over(w.rowsBetween(-2 * span + 1, -span))
    return {"recent": F.round(last, 6), "earlier": F.round(before, 6), "plateau": F.round(last, 6) >= F.round(before, 6)}


def regressions(runs: DataFrame, metric: str, order: str, higher_is_better: bool, partition: list[str], tolerance: float = 0.05) -> DataFrame:
    """Adds the run before and whether a metric got worse by more than the tolerance."""
    before = F.lag(metric).over(Window.partitionBy(*partition).orderBy(order))
    worse = F.col(metric) < before * (1 - tolerance) if higher_is_better else F.col(metric) > before * (1 + tolerance)
    return runs.withColumn("before", before).withColumn("regressed", F.coalesce(worse, F.lit(False)))


def weighted_choice(rows: DataFrame, key: str, weight: Column, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement in proportion to their weights: exponential keys from a hash, the same on each run."""
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return rows.withColumn("_k", F.round(-F.log(uniform) / weight, 9)).orderBy("_k", key).limit(n).drop("_k")


def warmup_schedule(step: Column, warm: int, peak: float, total: int, least: float, cosine: bool) -> Column:
    """Learning rate: linear at first, then constant or a cosine to ``least`` of the peak."""
    done = F.least(F.lit(1.0), (step - warm) / max(1, total - warm))
    later = peak * (least + (1 - least) * 0.5 * (1 + F.cos(done * 3.141592653589793))) if cosine else F.lit(peak)
    return F.when(step < warm, peak * (step + 1) / warm).otherwise(later)
