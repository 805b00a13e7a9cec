"""A small decoder: loss and gradients, optimiser, growth, training over partitions, scoring and generation.

A model is a dict of float32 tensors. Its size is set by its :class:`Shape`, never by the data, so it may be broadcast;
``MOST_BYTES`` is checked where it is.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Weights = dict[str, np.ndarray]

MOST_BYTES = 64 << 20
EPSILON = 1e-5
# The optimiser and the average of weights.
BETA1, BETA2, DECAY, CLIP, KEEP, AVERAGE_EVERY = 0.9, 0.99, 0.05, 1.0, 0.998, 4
#: Rows of attention that are worked on together: they need no keys after their last one, and stay in the cache.
ROWS = 32
#: Sequences that are scored together, for the same reason, and those that are learned together, where calls cost more than the cache saves.
TOGETHER, LEARNED_TOGETHER = 8, 16
#: Prompts that are continued together: a step for one takes nearly as long as for all of them.
CONTINUED_TOGETHER = 32
#: Scores that cannot be larger than this need no maximum taken off before they are exponents of float32.
STEADY = 40.0


@dataclass(frozen=True)
class Shape:
    vocabulary: int
    width: int = 32
    layers: int = 2
    heads: int = 4
    hidden: int = 64


def fresh(shape: Shape, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.02).astype(np.float32)
    w = {"embedding": draw(shape.vocabulary, shape.width), "last_norm": np.ones(shape.width, np.float32)}
    for i in range(shape.layers):
        w |= _layer(i, shape, draw)
    return w


def _layer(i: int, shape: Shape, draw) -> Weights:
    d, h = shape.width, shape.hidden
    squares = {f"{i}.{n}": draw(d, d) for n in ("query", "key", "value", "out")}
    norms = {f"{i}.{n}": np.ones(d, np.float32) for n in ("norm1", "norm2")}
    return squares | norms | {f"{i}.gate": draw(d, h), f"{i}.up": draw(d, h), f"{i}.down": draw(h, d)}


def layers_of(w: Weights) -> int:
    return sum(n.endswith(".query") for n in w)


# Inside a pass, arrays are (batch, rows, time): a product takes a sequence as it lies, heads are rows that need no copies,
# and what is done to a token or a row runs along the memory.


def _norm(x):
    """Tokens by their root mean square, and its inverse."""
    r = np.einsum("bij,bij->bj", x, x)[:, None]
    r = 1 / np.sqrt(r / x.shape[1] + EPSILON)
    return x * r, r


def _norm_back(d, x, r):
    """``x`` is the first result of :func:`_norm`; ``d`` is overwritten."""
    d -= x * (np.einsum("bij,bij->bj", d, x) / x.shape[1])[:, None]
    d *= r
    return d


def _angles(start: int, n: int, size: int):
    """Cosines and sines of each pair of a head's rows."""
    turn = np.arange(start, start + n)[None] / 10000 ** (np.arange(size // 2) * 2 / size)[:, None]
    return np.cos(turn).astype(np.float32), np.sin(turn).astype(np.float32)


def _rotate(x, cos, sin):
    """Turns the pairs of rows of (..., size, time), which are half a head apart."""
    x = x.reshape(*x.shape[:-2], 2, *cos.shape)
    turned = x * cos
    turned[..., 0, :, :] -= x[..., 1, :, :] * sin
    turned[..., 1, :, :] += x[..., 0, :, :] * sin
    return turned.reshape(*x.shape[:-3], -1, x.shape[-1])


def _turned(x):
    return x.swapaxes(-1, -2)


def _softmax(x, axis=-1):
    e = x - x.max(axis, keepdims=True)
    np.exp(e, out=e)
    e /= e.sum(axis, keepdims=True)
    return e


def _attend(q, k, v, start):
    """Sums of values, weighted by exponents of scores, the exponents' sums in the last column, and the exponents in blocks.

    ``v`` has a last column of ones. A query at ``i`` reads the keys up to ``start + i``; the rest are not computed.
    """
    n, blocks = q.shape[2], []
    sums = _turned(np.empty((*q.shape[:2], v.shape[-1], n), q.dtype))
    k, v = _turned(k), _turned(v)
    steady = math.sqrt(float(np.einsum("...ij,...ij->...i", q, q).max()) * float(np.einsum("...ij,...ij->...j", k, k).max())) <= STEADY
    hidden = np.triu(np.full((min(n, ROWS),) * 2, -1e9, q.dtype), 1)
    for at in range(0, n, ROWS):
        to = min(at + ROWS, n)
        e = q[:, :, at:to] @ k[..., : start + to]
        e[..., start + at :] += hidden[: to - at, : to - at]
        if not steady:
            e -= e.max(-1, keepdims=True)
        np.exp(e, out=e)
        np.matmul(v[..., : start + to], _turned(e), out=_turned(sums)[..., at:to])
        blocks.append(e)
    return sums, blocks


def _attend_back(do, o, q, k, v, sums, blocks):
    """Gradients of queries, keys and values side by side, without a past; all are (batch, heads, size, time)."""
    own = np.empty_like(v)
    np.divide(do, sums[:, :, -1:], out=own[:, :, :-1])
    np.negative(np.einsum("bhij,bhij->bhj", own[:, :, :-1], o), out=own[:, :, -1])
    d = np.empty((len(q), 3, *q.shape[1:]), q.dtype)
    for i in reversed(range(len(blocks))):
        e, at = blocks[i], i * ROWS
        to = e.shape[-1]
        mine = slice(at, to)
        ds = _turned(own[..., mine]) @ v[..., :to]
        ds *= e
        np.matmul(k[..., :to], _turned(ds), out=d[:, 0, ..., mine])
        for part, x, y in ((d[:, 1], q, ds), (d[:, 2], own[:, :, :-1], e)):
            if i == len(blocks) - 1:
                np.matmul(x[..., mine], y, out=part)
            else:
                part[..., :to] += x[..., mine] @ y
    return d


def _joined(w: Weights, norm: str, *names: str) -> np.ndarray:
    """Matrices side by side, a row for each result, with the norm's factors before them."""
    return np.concatenate([w[m].T for m in names]) * w[norm]


def _parted(w: Weights, d: np.ndarray, x: np.ndarray, norm: str, *names: str) -> Weights:
    """Gradients of joined matrices and of the norm's factors, from those of results and from the norm's tokens."""
    both, whole = (d @ _turned(x)).sum(0), np.concatenate([w[m].T for m in names])
    ends = np.cumsum([w[m].shape[1] for m in names])[:-1]
    return {norm: np.einsum("ij,ij->j", both, whole)} | {m: g.T for m, g in zip(names, np.split(both * w[norm], ends), strict=True)}


def forward(w: Weights, ids: np.ndarray, heads: int, past: list | None = None) -> tuple[np.ndarray, list]:
    """Logits of (batch, time) ids, and what the gradients need. ``past`` holds each layer's keys and values, and grows."""
    start = past[0][0].shape[2] if past and past[0] is not None else 0
    x, steps = np.ascontiguousarray(_turned(w["embedding"][ids])), []
    (batch, _, n), size = x.shape, x.shape[1] // heads
    cos, sin = _angles(start, n, size)
    for i in range(layers_of(w)):
        three, two = _joined(w, f"{i}.norm1", *(f"{i}.{m}" for m in ("query", "key", "value"))), _joined(w, f"{i}.norm2", f"{i}.gate", f"{i}.up")
        a, r1 = _norm(x)
        qkv = (three @ a).reshape(batch, 3, heads, size, n)
        qk, v = _rotate(qkv[:, :2], cos, sin), np.ones((batch, heads, size + 1, n), x.dtype)
        q, k, v[:, :, :-1] = qk[:, 0], qk[:, 1], qkv[:, 2]
        q *= 1 / math.sqrt(size)
        keys, values = _turned(k), _turned(v)
        if past is not None:
            if past[i] is not None:
                keys, values = np.concatenate([past[i][0], keys], 2), np.concatenate([past[i][1], values], 2)
            past[i] = (keys, values)
        sums, blocks = _attend(_turned(q), keys, values, start)
        sums = _turned(sums)
        o = sums[:, :, :-1] / sums[:, :, -1:]
        x = x + w[f"{i}.out"].T @ o.reshape(x.shape)
        b, r2 = _norm(x)
        gu = two @ b
        g, u = gu[:, : len(two) // 2], gu[:, len(two) // 2 :]
        s = np.clip(g, -60, 60)
        np.negative(s, out=s)
        np.exp(s, out=s)
        s += 1
        np.divide(1, s, out=s)
        gs = g * s
        h = gs * u
        steps.append((three, two, a, r1, q, k, v, sums, blocks, o, b, r2, u, s, gs, h))
        x = x + w[f"{i}.down"].T @ h
    last, r = _norm(x)
    known = w["embedding"] * w["last_norm"]
    return _turned(known @ last), [*steps, (known, last, r, cos, sin)]


def loss_and_gradients(w: Weights, ids: np.ndarray, weights: np.ndarray, heads: int) -> tuple[float, Weights]:
    """The mean loss of each next token, weighted; a negative weight makes a token less likely instead of likelier."""
    share, loss, grads = weights / max(np.abs(weights).sum(), 1e-9), 0.0, {}
    for at in range(0, len(ids), LEARNED_TOGETHER):
        more, part = _share_of_loss(w, ids[at : at + LEARNED_TOGETHER], share[at : at + LEARNED_TOGETHER], heads)
        loss, grads = loss + more, {n: grads[n] + g for n, g in part.items()} if grads else part
    return loss, grads


def _share_of_loss(w: Weights, ids: np.ndarray, share: np.ndarray, heads: int) -> tuple[float, Weights]:
    logits, steps = forward(w, ids[:, :-1], heads)
    d, at = _softmax(_turned(logits), 1), ids[:, None, 1:]
    got = np.take_along_axis(d, at, 1)[:, 0]
    rest, likely = np.maximum(1 - got, 1e-6), share >= 0
    loss = float(np.where(likely, -np.log(np.maximum(got, 1e-12)) * share, np.log(rest) * share).sum())
    d *= np.where(likely, share, share * got / rest)[:, None].astype(d.dtype)
    np.put_along_axis(d, at, (np.where(likely, got - 1, -got) * share)[:, None], 1)
    known, last, r, cos, sin = steps[-1]
    both = (d @ _turned(last)).sum(0)
    grads = {"embedding": both * w["last_norm"], "last_norm": np.einsum("ij,ij->j", both, w["embedding"])}
    dx = _norm_back(known.T @ d, last, r)
    for i in reversed(range(layers_of(w))):
        three, two, a, r1, q, k, v, sums, blocks, o, b, r2, u, s, gs, h = steps[i]
        grads[f"{i}.down"] = (dx @ _turned(h)).sum(0).T
        dh, both = w[f"{i}.down"] @ dx, np.empty((len(dx), len(two), dx.shape[2]), dx.dtype)
        dg, du = both[:, : s.shape[1]], both[:, s.shape[1] :]
        np.multiply(dh, gs, out=du)
        np.subtract(1, s, out=dg)
        dg *= gs
        dg += s
        dg *= u
        dg *= dh
        grads |= _parted(w, both, b, f"{i}.norm2", f"{i}.gate", f"{i}.up")
        dx += _norm_back(two.T @ both, b, r2)
        grads[f"{i}.out"] = (dx @ _turned(o.reshape(dx.shape))).sum(0).T
        dqkv = _attend_back((w[f"{i}.out"] @ dx).reshape(o.shape), o, q, k, v, sums, blocks)
        dqkv[:, 0] *= 1 / math.sqrt(q.shape[2])
        dqkv[:, :2] = _rotate(dqkv[:, :2], cos, -sin)
        dqkv = dqkv.reshape(len(dx), -1, dx.shape[2])
        grads |= _parted(w, dqkv, a, f"{i}.norm1", *(f"{i}.{m}" for m in ("query", "key", "value")))
        dx += _norm_back(three.T @ dqkv, a, r1)
    read = ids[:, :-1].reshape(-1)
    order = np.argsort(read, kind="stable")
    found, first = np.unique(read[order], return_index=True)
    grads["embedding"][found] += np.add.reduceat(_turned(dx).reshape(len(read), -1)[order], first)
    return loss, grads


class Optimiser:
    """AdamW with clipped gradients and a slow average of the weights. Tensors are parts of one array, so a step is a few operations."""

    def __init__(self, w: Weights):
        self.w, self._w = self._parts(w)
        self.average, self._average = self._parts(w)
        self._shrink = np.concatenate([np.full(t.size, DECAY if t.ndim > 1 else 0, np.float32) for t in w.values()])
        self.m, self.v = np.zeros_like(self._w), np.zeros_like(self._w)
        self.step = 0

    @staticmethod
    def _parts(w: Weights) -> tuple[Weights, np.ndarray]:
        whole = np.concatenate([t.reshape(-1) for t in w.values()])
        ends = np.cumsum([t.size for t in w.values()])
        return {n: whole[end - t.size : end].reshape(t.shape) for (n, t), end in zip(w.items(), ends, strict=True)}, whole

    def update(self, grads: Weights, rate: float) -> None:
        self.step += 1
        g = np.concatenate([grads[n].reshape(-1) for n in self.w])
        g *= min(1.0, CLIP / (math.sqrt(float(g @ g)) + 1e-9))
        self.m += (1 - BETA1) * (g - self.m)
        g *= g
        self.v += (1 - BETA2) * (g - self.v)
        move = self.m / (1 - BETA1**self.step) / (np.sqrt(self.v / (1 - BETA2**self.step)) + 1e-8)
        self._w -= rate * (move + self._shrink * self._w)
        if self.step % AVERAGE_EVERY == 0:
            self._average += (1 - KEEP) * (self._w - self._average)


def deeper(w: Weights, shape: Shape, seed: int = 1) -> Weights:
    """One layer more, which changes nothing until it is trained."""
    rng = np.random.default_rng(seed)
    new = _layer(layers_of(w), shape, lambda *s: (rng.standard_normal(s) * 0.02).astype(np.float32))
    for n in new:
        if n.endswith((".out", ".down")):
            new[n] = np.zeros_like(new[n])
    return w | new


def broader(w: Weights, more: int, seed: int = 2) -> Weights:
    """More hidden units in each layer, whose results are not used until they are trained."""
    rng, out = np.random.default_rng(seed), dict(w)
    for i in range(layers_of(w)):
        for n in ("gate", "up"):
            t = w[f"{i}.{n}"]
            out[f"{i}.{n}"] = np.concatenate([t, (rng.standard_normal((t.shape[0], more)) * 0.02).astype(np.float32)], 1)
        t = w[f"{i}.down"]
        out[f"{i}.down"] = np.concatenate([t, np.zeros((more, t.shape[1]), np.float32)])
    return out


def more_tokens(w: Weights, parts: list[list[int]]) -> Weights:
    """New tokens start as the mean of the tokens that they were made of."""
    rows = [w["embedding"][p].mean(0) if p else w["embedding"].mean(0) for p in parts]
    return w | {"embedding": np.concatenate([w["embedding"], np.array(rows, np.float32).reshape(len(rows), -1)])}


def _checked(w: Weights) -> Weights:
    size = sum(t.nbytes for t in w.values())
    if size > MOST_BYTES:
        raise ValueError(f"a model of {size} bytes is over the {MOST_BYTES} that are broadcast")
    return w


def _keep_memory() -> None:
    """Freed arrays stay with the process: else each step gets its pages anew, which takes as long as its sums (glibc only)."""
    allocator = ctypes.CDLL(None)
    if hasattr(allocator, "mallopt"):
        allocator.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        allocator.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


def _batch(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Padded ids, and a weight for each next token: the request's count a tenth of the reply's, padding nothing."""
    size = np.fromiter(map(len, part["ids"]), np.int64, len(part))[:, None]
    ids = np.zeros((len(part), int(size.max())), np.int64)
    for row, t in zip(ids, part["ids"], strict=True):
        row[: len(t)] = t
    at, weight = np.arange(1, ids.shape[1])[None], part["weight"].to_numpy(np.float32)[:, None]
    weights = np.where(at < part["loss_from"].to_numpy()[:, None], np.float32(0.1) * np.abs(weight), weight)
    return ids, np.where(at < size, weights, np.float32(0))


def train(rows: DataFrame, w: Weights, shape: Shape, rounds: int, workers: int = 4, rate: float = 3e-3, batch: int = 16, key: str = "id") -> Weights:
    """Weights after rounds of local steps and averaging; ``rows``: key, ids, weight, loss_from.

    In each round every worker passes over its share batch by batch (never holding it), from the same weights; the results
    are averaged tensor by tensor on the executors, so the driver gets one model. This differs from averaging gradients
    at each step, which Spark would need a barrier for; a lost executor only repeats its own share.
    """
    dealt = rows.where("size(ids) >= 3").select(key, "ids", "weight", "loss_from").repartition(workers, key)
    for _ in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(_checked(w))

        def run(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            _keep_memory()
            state, seen = Optimiser(held.value), 0
            for part in parts:
                for at in range(0, len(part), batch):
                    ids, weights = _batch(part.iloc[at : at + batch])
                    state.update(loss_and_gradients(state.w, ids, weights, shape.heads)[1], rate)
                    seen += 1
            if seen:
                yield pd.DataFrame({"tensor": list(state.w), "data": [t.astype("<f4").tobytes() for t in state.w.values()], "n": seen})

        def mean(key_: tuple, part: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(d, "<f4").astype(np.float64) * n for d, n in zip(part["data"], part["n"], strict=True))
            return pd.DataFrame({"tensor": [key_[0]], "data": [(total / part["n"].sum()).astype("<f4").tobytes()]})

        got = dealt.mapInPandas(run, "tensor string, data binary, n long").groupBy("tensor").applyInPandas(mean, "tensor string, data binary").collect()
        new = {r.tensor: np.frombuffer(r.data, "<f4").reshape(w[r.tensor].shape).astype(np.float32) for r in got}
        w = {n: new.get(n, t) for n, t in w.items()}
        held.unpersist()
    return w


def _nats(w: Weights, heads: int, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each sequence's next tokens and their mean negative log probability (nan: none).

    Sequences of like length are padded and worked on together; no token reads what is after it.
    """
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    nats, order = np.full(len(rows), np.nan), np.argsort(size, kind="stable")
    order = order[size[order] >= 2]
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        ids = np.zeros((len(some), int(size[some[-1]])), np.int64)
        for row, i in zip(ids, some, strict=True):
            row[: size[i]] = rows[i]
        p = np.take_along_axis(_softmax(_turned(forward(w, ids[:, :-1], heads)[0]), 1), ids[:, None, 1:], 1)[:, 0]
        wanted = np.arange(1, ids.shape[1])[None] < size[some, None]
        nats[some] = np.where(wanted, -np.log(np.maximum(p, 1e-12)), 0).sum(1, dtype=float) / (size[some] - 1)
    return np.maximum(size - 1, 0), nats


def scored(rows: DataFrame, w: Weights, shape: Shape, key: str = "id") -> DataFrame:
    """key, tokens, nats: the mean negative log probability of each sequence's tokens; shorter than two: none."""
    return scored_by(rows, {"nats": w}, shape, key)


def scored_by(rows: DataFrame, models: dict[str, Weights], shape: Shape, key: str = "id") -> DataFrame:
    """As :func:`scored`, with a column for each model of that shape; rows are read and passed to Python once for all of them."""
    held = rows.sparkSession.sparkContext.broadcast({name: _checked(w) for name, w in models.items()})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _keep_memory()
        for part in parts:
            ids = list(part["ids"])
            got = {name: _nats(w, shape.heads, ids) for name, w in held.value.items()}
            yield pd.DataFrame({key: part[key], "tokens": [max(len(t) - 1, 0) for t in ids]} | {name: nats for name, (_, nats) in got.items()})

    return rows.select(key, "ids").mapInPandas(run, ", ".join([f"{key} long, tokens long", *(f"`{name}` double" for name in models)]))


def choose(logits: np.ndarray, ids: list[int], copied: set[int], rng, temperature: float, top_p: float, penalty: float, copy_bonus: float, no_repeat: int) -> int:
    """The next id: repeated ones are penalised, the context's favoured, and what would repeat a run is forbidden."""
    x = logits.astype(float)
    said = list(set(ids))
    x[said] = np.where(x[said] > 0, x[said] / penalty, x[said] * penalty)
    x[list(copied)] += copy_bonus
    tail = ids[len(ids) - no_repeat + 1 :] if no_repeat > 1 else []
    if tail and len(ids) >= no_repeat:
        banned = [ids[i + no_repeat - 1] for i in range(len(ids) - no_repeat + 1) if ids[i : i + no_repeat - 1] == tail]
        if len(set(banned)) < len(x):
            x[banned] = -np.inf
    if temperature <= 0:
        return int(x.argmax())
    p = _softmax(x / temperature)
    order = np.argsort(-p, kind="stable")
    kept = order[: int(np.searchsorted(np.cumsum(p[order]), top_p)) + 1]
    return int(rng.choice(kept, p=p[kept] / p[kept].sum()))


def _side_by_side(pasts: list[list]) -> list:
    """The keys and values of several prompts, which end together: keys are turned on by what a shorter prompt is short of.

    What is put before them has no value and no share in the exponents' sums; its key is one of the prompt's own.
    """
    out, most = [], max(p[0][0].shape[2] for p in pasts)
    for layer in zip(*pasts, strict=True):
        keys, values = [], []
        for k, v in layer:
            _, heads, n, size = k.shape
            cos, sin = (np.repeat(t, n, 1) for t in _angles(most - n, 1, size))
            k = _turned(_rotate(_turned(k), cos, sin))
            keys.append(np.concatenate([np.repeat(k[:, :, :1], most - n, 2), k], 2))
            values.append(np.concatenate([np.zeros((1, heads, most - n, size + 1), v.dtype), v], 2))
        out.append((np.concatenate(keys), np.concatenate(values)))
    return out


def _continue(w: Weights, heads: int, prompts: list[list[int]], pick, new: int, end: int) -> list[list[int]]:
    """Up to ``new`` ids after each prompt, which are not empty; ``pick`` (place, logits, ids so far) chooses. Each step is one for all of them."""
    pasts, made, feed, open_ = [[None] * layers_of(w) for _ in prompts], [[] for _ in prompts], [], set(range(len(prompts)))
    for i, t in enumerate(prompts):
        feed.append(pick(i, forward(w, np.array([t]), heads, pasts[i])[0][0, -1], t))
    past = _side_by_side(pasts)
    for left in reversed(range(new)):
        for i in sorted(open_):
            if feed[i] == end:
                open_.remove(i)
                feed[i] = 0  # nobody reads what comes after it
            else:
                made[i].append(feed[i])
        if not left or not open_:
            break
        logits = forward(w, np.array(feed)[:, None], heads, past)[0][:, -1]
        for i in open_:
            feed[i] = pick(i, logits[i], [*prompts[i], *made[i]])
    return made


def continued(prompts: DataFrame, w: Weights, shape: Shape, new: int, end: int, temperature: float = 0.8, top_p: float = 0.9, penalty: float = 1.2, copy_bonus: float = 0.0, no_repeat: int = 3, key: str = "id") -> DataFrame:
    """key and ids: up to ``new`` ids after each prompt (key, ids), until ``end``. The same prompt always draws the same numbers."""
    held = prompts.sparkSession.sparkContext.broadcast(_checked(w))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, asked = list(part[key]), [list(map(int, t)) for t in part["ids"]]
            out, order = [[] for _ in asked], sorted((i for i, t in enumerate(asked) if t and new > 0), key=lambda i: len(asked[i]))
            for at in range(0, len(order), CONTINUED_TOGETHER):
                some = order[at : at + CONTINUED_TOGETHER]
                draws = [np.random.default_rng(zlib.crc32(str(names[i]).encode())) for i in some]

                def pick(j, logits, ids, some=some, draws=draws):
                    return choose(logits, ids, set(asked[some[j]]), draws[j], temperature, top_p, penalty, copy_bonus, no_repeat)

                for i, got in zip(some, _continue(held.value, shape.heads, [asked[i] for i in some], pick, new, end), strict=True):
                    out[i] = got
            yield pd.DataFrame({key: part[key], "ids": out})

    return prompts.select(key, "ids").mapInPandas(run, f"{key} long, ids array<int>")


def save(spark: SparkSession, w: Weights, shape: Shape, path: str) -> None:
    """A row for each tensor, with the shape of the model beside it."""
    rows = [(n, list(t.shape), bytearray(t.astype("<f4").tobytes())) for n, t in w.items()]
    spark.createDataFrame(rows, "tensor string, shape array<int>, data binary").write.mode("overwrite").parquet(f"{path}/tensors")
    spark.createDataFrame([asdict(shape)]).write.mode("overwrite").parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> tuple[Weights, Shape]:
    rows = spark.read.parquet(f"{path}/tensors").collect()
    return {r.tensor: np.frombuffer(r.data, "<f4").reshape(r.shape).astype(np.float32) for r in rows}, Shape(**spark.read.parquet(f"{path}/shape").first().asDict())
