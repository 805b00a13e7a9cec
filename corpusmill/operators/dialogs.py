"""Dialogs: pairs with history from turns, admission, formats of dialog data, quotes, replay and training weights."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators.store import stored

USERS, BOTS = ("human", "user", "prompter"), ("gpt", "assistant", "bot")


def pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, user, bot, history: each reply to a user's turn, with the two pairs before it as text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = turns.select("conv_id", "turn", F.lower("role").alias("role"), T.clean_field("text").alias("text"))
    said = said.where(F.col("role").isin(*USERS, *BOTS)).withColumns({"before": F.lag("text").over(w), "asked": F.lag("role").over(w).isin(*USERS)})
    found = said.where(F.col("role").isin(*BOTS) & F.col("asked") & (F.col("before") != "")).select("conv_id", "turn", F.col("before").alias("user"), F.col("text").alias("bot"))
    one = F.concat_ws(" / ", "user", "bot")
    earlier = F.collect_list(one).over(w.rowsBetween(-2, -1))
    return found.withColumn("history", F.array_join(earlier, " // "))


def admitted(found: DataFrame) -> DataFrame:
    """user and bot as kept for training: cleaned, shortened, neither empty, hollow nor personal, each pair once."""
    user, bot = T.shorten(T.strip("user"), 300), T.shorten(T.clean_reply("bot"), 220)
    rows = found.withColumns({"user": user, "bot": bot}).where((F.length("user") >= 2) & (F.length("bot") >= 2))
    hollow = (F.length("bot") < 60) & F.col("bot").rlike(K.HOLLOW_TAIL)
    rows = rows.where(~hollow & ~F.col("user").rlike(K.PERSONAL) & ~F.col("bot").rlike(K.PERSONAL))
    first = F.min(F.struct(*[c for c in rows.columns if c not in ("user", "bot")])).alias("x")
    return rows.groupBy("user", "bot").agg(first).select("x.*", "user", "bot")


def or_else(*fields: Column) -> Column:
    """The first field that is neither null nor empty."""
    return F.coalesce(*[F.when(f != "", f) for f in fields], F.lit(""))


def ended(answer: Column, marks: str = "。．.!?！？") -> Column:
    return F.when(answer.rlike(f"[{marks}]$"), answer).otherwise(F.concat(answer, F.lit("。")))


def from_json_rows(rows: DataFrame, kind: str) -> DataFrame:
    """user, bot, context, weight from rows of a JSON column ``row`` in one of the public formats."""
    get = lambda *names: T.clean_field(or_else(*[F.get_json_object("row", f"$.{n}") for n in names]))
    none, one = F.lit(None).cast("string"), F.lit(1.0)
    if kind == "instruction":
        extra = get("input")
        user = F.when(extra != "", F.concat(get("instruction"), F.lit("\n"), extra)).otherwise(get("instruction"))
        made = [(user, get("output", "response"), none, one)]
    elif kind in ("qa", "qa_text"):
        made = [(get("question", "title"), get("answer.text", "answer.value", "answer") if kind == "qa_text" else get("answer", "answers"), none, one)]
    elif kind == "wikiqa":
        made = [(get("query", "question"), F.when(get("answer") != "", ended(get("answer"))).otherwise(""), F.substring(get("text", "passage"), 1, 240), one)]
    elif kind == "squad":
        context, answer = get("context"), T.strip(or_else(F.get_json_object("row", "$.answers.text[0]")))
        at = F.greatest(F.lit(1), F.when(F.instr(context, answer) > 0, F.instr(context, answer) - 100).otherwise(1))
        made = [(F.when(context != "", get("question")).otherwise(""), F.when(answer != "", ended(answer, "。.")).otherwise(""), F.substr(context, at, F.lit(240)), one)]
    elif kind == "preference":
        turns = F.from_json(F.get_json_object("row", "$.conversations"), "array<struct<from:string,role:string,value:string,content:string>>")
        users = F.filter(turns, lambda t: F.lower(or_else(t["from"], t["role"])).isin(*USERS))
        last = T.strip(F.coalesce(F.try_element_at(F.transform(users, lambda t: or_else(t["value"], t["content"])), F.lit(-1)), F.lit("")))
        made = [(last, get("chosen"), none, one), (F.when((get("chosen") != "") & (get("chosen") != get("rejected")), last).otherwise(""), get("rejected"), none, F.lit(-1.0))]
    else:
        raise ValueError(f"no such format: {kind}")
    options = F.array(*[F.struct(u.alias("user"), b.alias("bot"), c.alias("context"), w.alias("weight")) for u, b, c, w in made])
    return rows.select(F.explode(options).alias("p")).select("p.*").where("user != '' and bot != ''")


def quote_pairs(docs: DataFrame, gap: int = 40, most: int = 200) -> DataFrame:
    """doc_id, i, user, bot, history: quotations that follow each other closely, with the two pairs before."""
    quote = re.compile("「([^「」]{2,80})」")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, text in zip(part["doc_id"], part["text"], strict=True):
                chain: list[str] = []
                last, end, n = None, 0, 0
                for m in quote.finditer(text or ""):
                    said = m[1].strip()
                    if last is None or m.start() - end > gap:
                        chain = []
                    elif said != last and n < most:
                        out.append((doc, n, last, said, " // ".join(chain[-2:])))
                        chain.append(f"{last} / {said}")
                        n += 1
                    last, end = said, m.end()
            yield pd.DataFrame(out, columns=["doc_id", "i", "user", "bot", "history"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, i long, user string, bot string, history string")


def capped(rows: DataFrame, kind: str, order: list[Column | str], caps: dict[str, int], most: int) -> DataFrame:
    """The newest rows of each kind, as many as its cap allows.

    The largest cap is a constant bound on ranks, so each task keeps no more of a kind before the exchange.
    """
    largest = max([most, *caps.values()])
    cap = F.coalesce(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(kind)], F.lit(most))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_k") <= largest).where(F.col("_k") <= cap).drop("_k")


def token_weights(length: Column, loss_from: Column, weight: Column) -> Column:
    """The weight of each target: a fifth before the reply starts."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(i < F.greatest(loss_from - 1, F.lit(0)), weight * 0.2).otherwise(weight))


def banned_next(ids: Column, size: int) -> Column:
    """What followed an earlier copy of the last ``size``-1 items."""
    tail = F.slice(ids, F.size(ids) - size + 2, size - 1)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids) - size + 1, F.lit(1))), lambda i: F.slice(ids, i, size - 1) == tail)
    found = F.transform(places, lambda i: F.try_element_at(ids, (i + size - 1).cast("int")))
    return F.when(F.size(ids) >= size, F.array_sort(F.array_distinct(found))).otherwise(F.slice(ids, 1, 0))


def values_at(rows: DataFrame, group: str, value: str, shares: dict[str, float], parts: int = 256) -> DataFrame:
    """For each group the value at floor(n * share) of its sorted values, and the greatest as ``most``; exact.

    Approximate quantiles cut a group's values into parts, whose sizes are counted; only the parts that hold a wanted
    rank are sorted, each in a task of its own, so a hot group never meets in one.
    """
    rows = stored(rows.select(group, F.col(value).alias("v")), "values")
    cuts = rows.groupBy(group).agg(F.approx_percentile("v", [i / parts for i in range(1, parts)], 4096).alias("cuts"), F.count(F.lit(1)).alias("n"), F.max("v").alias("most"))
    cut = rows.join(F.broadcast(cuts.select(group, F.array_distinct("cuts").alias("cuts"))) if cuts.count() <= 10_000 else cuts.select(group, F.array_distinct("cuts").alias("cuts")), group)
    cut = cut.select(group, "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    sizes = cut.groupBy(group, "part").agg(F.count(F.lit(1)).alias("size"))
    upto = F.sum("size").over(Window.partitionBy(group).orderBy("part"))  # at most ``parts`` rows a group
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.col("n") - 1, F.floor(F.col("n") * x)).alias("rank")) for name, x in shares.items()])
    asked = cuts.select(group, "most", F.explode(ranks).alias("r")).select(group, "most", "r.name", "r.rank")
    held = sizes.withColumn("first", upto - F.col("size")).join(asked, group).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("size")))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy("v")) - 1
    found = cut.join(held.select(group, "part").distinct(), [group, "part"]).withColumn("place", place).join(held, [group, "part"]).where(F.col("place") == F.col("rank") - F.col("first"))
    wide = found.groupBy(group).agg(F.max("most").alias("most"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    return wide.select(group, *[F.round(name, 6).alias(name) for name in shares], F.round("most", 6).alias("most"))
