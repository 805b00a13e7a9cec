"""Small models: random-indexing vectors and their sketches, sub-word encoding, the learned re-ranker."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusmill.functions import fixed as K


# Two bytes a place; 64 planes of 16 places for and 16 against, drawn with seed 12345.
ENTRY_BYTES = 2
PLANES, SEED, SIDE = 64, 12345, 16


def index_entries(term: str) -> list[tuple[int, int]]:
    """The few places and signs of a term's own vector: two bytes of its BLAKE2b digest for each."""
    digest = hashlib.blake2b(term.encode(), digest_size=ENTRY_BYTES * K.NONZERO).digest()
    return [(int.from_bytes(digest[i : i + ENTRY_BYTES], "big") % K.DIMENSIONS, 1 if digest[i] & 1 else -1) for i in range(0, ENTRY_BYTES * K.NONZERO, ENTRY_BYTES)]


@F.pandas_udf(ArrayType(StructType([StructField("dim", IntegerType()), StructField("sign", IntegerType())])))
def index_vector(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: [{"dim": d, "sign": s} for d, s in index_entries(t)])


def term_vectors(pairs: DataFrame) -> DataFrame:
    """term, dim, x from (term, neighbour, weight): the sum of neighbours' vectors, the same in any order."""
    own = pairs.select("neighbour").distinct().select("neighbour", F.inline(index_vector("neighbour")))
    return pairs.join(own, "neighbour").groupBy("term", F.col("dim").cast("long").alias("dim")).agg(F.sum(F.col("weight") * F.col("sign")).alias("x"))


def planes(n: int = PLANES, seed: int = SEED) -> list[tuple[list[int], list[int]]]:
    """Sparse planes: the places that count and those that count against."""
    rng = random.Random(seed)
    drawn = [rng.sample(range(K.DIMENSIONS), 2 * SIDE) for _ in range(n)]
    return [(d[:SIDE], d[SIDE:]) for d in drawn]


def sketches(vectors: DataFrame) -> DataFrame:
    """term and a 64-bit sketch: on which side of each plane the vector lies, first plane highest.

    Each place knows its planes, so a term's sums are one aggregation with a map-side part; no task sees a whole group.
    """
    drawn = planes()
    sides = [[(d in plus) - (d in minus) for plus, minus in drawn] for d in range(K.DIMENSIONS)]
    table = F.from_json(F.lit(json.dumps(sides)), "array<array<int>>")
    of = F.element_at(table, (F.col("dim") + 1).cast("int"))
    sums = [F.sum(F.col("x") * F.element_at("side", j + 1)) for j in range(PLANES)]
    summed = vectors.select("term", "x", of.alias("side")).groupBy("term").agg(*[s.alias(f"s{j}") for j, s in enumerate(sums)])
    bits = [F.when(F.col(f"s{j}") > 0, F.lit(1 << (PLANES - 1 - j) if j else -(1 << 63))).otherwise(F.lit(0)) for j in range(PLANES)]
    sketch = bits[0].cast("long")
    for b in bits[1:]:
        sketch = sketch.bitwiseOR(b.cast("long"))
    return summed.select("term", sketch.alias("sketch"))


def encode(text: str, vocabulary: dict[str, int], longest: int, unknown: int = 0) -> list[int]:
    """The longest piece at each place; characters that no piece starts with are unknown."""
    out, i = [], 0
    while i < len(text):
        size = next((n for n in range(min(longest, len(text) - i), 0, -1) if text[i : i + n] in vocabulary), 0)
        out.append(vocabulary[text[i : i + size]] if size else unknown)
        i += size or 1
    return out


def encoded(rows: DataFrame, pieces: list[str], id_col: str = "doc_id") -> DataFrame:
    """id and ids of each text by a vocabulary of bounded size; characters are pieces too."""
    vocabulary = {p: i + 1 for i, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({id_col: part[id_col], "ids": [encode((t or "").lower(), vocabulary, longest) for t in part["text"]]})

    return rows.select(id_col, "text").mapInPandas(run, f"{id_col} long, ids array<int>")


def predicted(features: list[Column], weights: list[float]) -> Column:
    """A logistic prediction as an expression."""
    z = sum((f * w for f, w in zip(features, weights, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def learn_online(rows: DataFrame, features: list[str], label: str, order: str, start: list[float], rate: float = 0.05, decay: float = 1e-3) -> DataFrame:
    """model and weights after stochastic steps in order, by model; a model's feedback is a user's, so it is small."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        w = np.array(start)
        for x, y in zip(part[features].to_numpy(float), part[label].to_numpy(float), strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ x)))))
            w += rate * ((y - p) * x - decay * w)
        return pd.DataFrame({"model": [key[0]], "weights": [w.tolist()], "n": [len(part)]})

    return rows.groupBy("model").applyInPandas(run, "model long, weights array<double>, n long")
