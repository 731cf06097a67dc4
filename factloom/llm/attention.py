"""A small causal self-attention model over subword ids, trained and run in numpy.

One layer, two heads with relative position biases, and a two-level softmax: ids
are grouped by frequency into ``SIDE`` classes of ``SIDE``, so a token costs two
softmaxes of ``SIDE`` and the distribution over all ids is exact.  The output
starts from the counts of neighbouring ids where ``PairOffsets`` are given, else
from biases that begin at the corpus frequencies; attention adds to that what
the ids further back tell.

A text is cut into blocks of ``STRIDE`` ids.  A block's window also holds the
``CONTEXT`` ids before it, so windows overlap and each id is scored once, with
all ids of its window up to it as context.
"""

from __future__ import annotations

import contextlib
import copy
import ctypes

import numpy as np

SIDE = 48
IDS = SIDE * SIDE
STRIDE, CONTEXT = 32, 16
SPAN = STRIDE + CONTEXT
WIDTH, HEADS, HEAD = 24, 2, 8
MIXED = HEADS * HEAD  # of all heads side by side
PAD = IDS  # a key that is masked
PART = 32  # windows whose attention weights are worked on at once
_BACK = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(SPAN)[None]  # how far a key lies back
_FUTURE = _BACK < 0
_BACK0 = np.maximum(_BACK, 0)


def keep_memory() -> None:
    """Freed memory stays with this process, where glibc is the C library: arrays of a few MB are made again and again."""
    with contextlib.suppress(Exception):
        c = ctypes.CDLL(None)
        c.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 1 << 27)  # M_TRIM_THRESHOLD


def windows(ids: np.ndarray, counts: np.ndarray, pick=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, targets, text of each window) of texts that lie one after another in ``ids``.

    Key t of a window is the id before target t; the id before a text's first is 0.
    Targets beyond a text are -1.  ``pick``, of (text, place in it), says which windows are made.
    """
    n = (counts + STRIDE - 1) // STRIDE
    text = np.repeat(np.arange(len(counts)), n)
    begin = np.cumsum(counts) - counts
    block = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    if pick is not None:
        own = pick(text, block)
        text, block = text[own], block[own]
    first = (block * STRIDE)[:, None]
    size, base = counts[text][:, None], begin[text][:, None]
    t = first + np.arange(STRIDE)[None]
    padded = np.append(ids, 0)
    targets = np.where(t < size, padded[np.minimum(base + t, len(ids))], -1)
    k = first - CONTEXT + np.arange(SPAN)[None]  # the key's target position; its id is one before
    keys = np.where((k < 0) | (k > size), PAD, np.where(k == 0, 0, padded[np.clip(base + k - 1, 0, len(ids))]))
    return keys, targets, text


class PairOffsets:
    """Smoothed pair counts as what the attention's output starts from: log shares of classes and of ids in their class, by the id before."""

    SMOOTH = 8.0

    def __init__(self, pairs: np.ndarray, n: np.ndarray, frequencies: np.ndarray):
        base = (frequencies + 0.5) / (frequencies + 0.5).sum() * self.SMOOTH
        table = np.zeros(IDS * IDS, np.float32)
        table[pairs] = n
        table = table.reshape(IDS, IDS)
        table += base.astype(np.float32)
        table = table.reshape(IDS, SIDE, SIDE)
        group = table.sum(2, dtype=np.float64)
        table /= group[:, :, None].astype(np.float32)
        np.log(table, out=table)
        self.before = group.sum(1)
        self.base = base.astype(np.float32)
        self.item, self.group = table.reshape(IDS * SIDE, SIDE), np.log(group / self.before[:, None]).astype(np.float32)
        self.before = self.before.astype(np.float32)
        self.least = base.reshape(SIDE, SIDE).sum(1).astype(np.float32)

    def less_one(self, before: np.ndarray, group: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of all classes, and of the ids in the target's, for targets of texts that were counted: each is left out of its own count."""
        at, groups, items = np.arange(len(before)), self.group.take(before, 0), self.item.take(before * SIDE + group, 0)
        own = groups[at, group]
        n = np.exp(own) * self.before[before]
        groups[at, group] = own + np.log(np.maximum(n - 1, self.least[group]) / n)
        own = items[at, item]
        n *= np.exp(own)
        items[at, item] = own + np.log(np.maximum(n - 1, self.base[group * SIDE + item]) / n)
        return groups, items


class AttentionModel:
    def __init__(self, counts: np.ndarray, pairs: PairOffsets | None = None, seed: int = 3):
        self.pairs = pairs
        draw = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (draw.normal(size=shape) * scale).astype(np.float32)

        f = (counts.astype(np.float64) + 0.5).reshape(SIDE, SIDE)
        self.p = {
            "E": normal(IDS + 1, WIDTH, scale=0.3),
            "Q": normal(WIDTH, MIXED, scale=0.2), "K": normal(WIDTH, MIXED, scale=0.2), "V": normal(WIDTH, MIXED, scale=0.2), "O": normal(MIXED, WIDTH, scale=0.2),
            "R": np.stack([-0.05 * np.arange(SPAN), -0.5 * np.arange(SPAN)][:HEADS]).astype(np.float32),
            "C": normal(WIDTH, SIDE, scale=0.05), "U": normal(SIDE, WIDTH, SIDE, scale=0.05),
        }
        if pairs is None:
            self.p |= {"c": np.log(f.sum(1) / f.sum()).astype(np.float32), "u": np.log(f / f.sum(1, keepdims=True)).astype(np.float32)}

    def over(self, pairs: PairOffsets | None) -> AttentionModel:
        """The model with its own copy of the parameters, over these offsets; without them for sending, apart from what it was fitted over."""
        other = copy.copy(self)
        other.p, other.pairs = {k: v.copy() for k, v in self.p.items()}, pairs
        return other

    def tables(self):
        """Queries, keys, values and position biases of all ids, the heads side by side.

        Values carry a last 1, so that weights and their sum come from one product; a masked key's are all 0.
        """
        p, kind = self.p, self.p["E"].dtype
        e = p["E"].copy()
        e[PAD] = 0
        q, k = (x.reshape(-1, HEADS, HEAD) for x in (e @ (p["Q"] / kind.type(np.sqrt(HEAD))), e @ p["K"]))
        v = np.ones((IDS + 1, HEADS, HEAD + 1), kind)
        v[:, :, :HEAD] = (e @ p["V"]).reshape(-1, HEADS, HEAD)
        v[PAD] = 0
        return e, q, k, v, np.where(_FUTURE, kind.type(-1e9), p["R"][:, _BACK0])

    @staticmethod
    def _attend(keys: np.ndarray, tables, shift: bool, kept: list | None = None) -> np.ndarray:
        """Weighted values of each target by head, in parts whose weights stay in a core's cache; what a gradient needs goes into ``kept``."""
        _, q, k, v, bias = tables
        o = np.empty((len(keys), STRIDE, HEADS, HEAD), q.dtype)
        for at in range(0, len(keys), PART):
            own = keys[at : at + PART]
            qs, ks, vs = (x.take(i, 0).transpose(0, 2, 1, 3) for x, i in ((q, own[:, CONTEXT:]), (k, own), (v, own)))
            s = qs @ ks.transpose(0, 1, 3, 2)
            s += bias
            if shift:
                s -= s.max(-1, keepdims=True)
            np.exp(s, out=s)
            found = s @ vs
            total = found[..., HEAD:]
            np.divide(found[..., :HEAD], total, out=o[at : at + PART].transpose(0, 2, 1, 3))
            if kept is not None:
                kept.append((qs, ks, vs, s, total))
        return o

    def log_probs(self, keys: np.ndarray, targets: np.ndarray, tables) -> np.ndarray:
        """Natural log probability of each target; 0 beyond a text.

        The same as the forward half of ``gradients`` with fewer passes: exponentials
        are not shifted first, and a batch where one overflows is run again shifted.
        """
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            out = self._log_probs(keys, targets, tables, False)
        return out if np.isfinite(out).all() else self._log_probs(keys, targets, tables, True)

    def _log_probs(self, keys: np.ndarray, targets: np.ndarray, tables, shift: bool) -> np.ndarray:
        p = self.p
        live = np.flatnonzero(targets.ravel() >= 0)
        goal = targets.ravel()[live]
        query = keys[:, CONTEXT:]
        o = self._attend(keys, tables, shift)
        h, query = o.reshape(-1, MIXED), query.ravel()
        if len(live) < targets.size:
            h, query = h.take(live, 0), query[live]
        h = h @ p["O"]
        h += p["E"].take(query, 0)
        group, item = (goal // SIDE).astype(np.int16), goal % SIDE
        order = np.argsort(group, kind="stable")
        h, group, item, query = h.take(order, 0), group[order], item[order], query[order]
        edge = np.searchsorted(group, np.arange(SIDE + 1))
        z = h @ p["C"]
        z += self.pairs.group.take(query, 0) if self.pairs else p["c"]
        out = self._log_share(z, group, shift)
        for g in range(SIDE):
            a, e = edge[g], edge[g + 1]
            if e > a:
                np.matmul(h[a:e], p["U"][g], out=z[a:e])
        z += self.pairs.item.take(query * SIDE + group, 0) if self.pairs else p["u"].take(group, 0)
        out += self._log_share(z, item, shift)
        full = np.zeros(targets.size, np.float32)
        full[live[order]] = out
        return full.reshape(targets.shape)

    @staticmethod
    def _log_share(z: np.ndarray, pick: np.ndarray, shift: bool) -> np.ndarray:
        if shift:
            z -= z.max(1, keepdims=True)
        out = z[np.arange(len(z)), pick]
        np.exp(z, out=z)
        return out - np.log(z @ np.ones(SIDE, np.float32))

    def gradients(self, keys: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, gradient of each parameter) of one batch."""
        own, g = self.learn(keys, targets)
        return -own.sum(dtype=np.float64) / max(1, (targets >= 0).sum()), g

    def learn(self, keys: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(natural log probability of each target, gradient of their negative mean) of windows that ``pairs`` count; shifted only where an exponential overflows."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            own, g = self._learn(keys, targets, False)
        return (own, g) if np.isfinite(own).all() and all(np.isfinite(x).all() for x in g.values()) else self._learn(keys, targets, True)

    def _learn(self, keys: np.ndarray, targets: np.ndarray, shift: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        p, b = self.p, len(keys)
        kind = p["E"].dtype
        live = np.flatnonzero(targets.ravel() >= 0)
        goal, n = targets.ravel()[live], len(live)
        order = np.argsort((goal // SIDE).astype(np.int16), kind="stable")
        live, goal = live[order], goal[order]
        group, item = goal // SIDE, goal % SIDE
        edge = np.searchsorted(group, np.arange(SIDE + 1)).tolist()
        query = keys[:, CONTEXT:]
        tables, kept = self.tables(), []
        e, o = tables[0], self._attend(keys, tables, shift, kept)
        seen, before = o.reshape(-1, MIXED).take(live, 0), query.ravel()[live]
        h = seen @ p["O"]
        h += e.take(before, 0)
        g = {k: np.zeros_like(v) for k, v in p.items() if k in "RUu"}
        z = h @ p["C"]
        if self.pairs:
            own, items = self.pairs.less_one(before, group, item)
        else:
            own, items = p["c"], p["u"].take(group, 0)
        z += own
        out = self._share_error(z, group, shift)
        g["C"] = h.T @ z
        if not self.pairs:
            g["c"] = z.sum(0)
        dh = z @ p["C"].T
        spans = [(k, x, y) for k, (x, y) in enumerate(zip(edge, edge[1:])) if y > x]
        for k, x, y in spans:
            np.matmul(h[x:y], p["U"][k], out=z[x:y])
        z += items
        out += self._share_error(z, item, shift)
        for k, x, y in spans:
            own = z[x:y]
            np.matmul(h[x:y].T, own, out=g["U"][k])
            if not self.pairs:
                np.add.reduce(own, 0, out=g["u"][k])
            dh[x:y] += own @ p["U"][k].T
        g["O"] = seen.T @ dh
        do, straight = np.zeros((b * STRIDE, MIXED), kind), np.zeros((b * STRIDE, WIDTH), kind)
        do[live], straight[live] = dh @ p["O"].T, dh
        do = do.reshape(o.shape)
        rows = np.empty((b, SPAN, WIDTH), kind)  # of the gradient of the ids' vectors, a row a key
        rows_to = np.concatenate([p[k].reshape(WIDTH, HEADS, HEAD) for k in "KV"], 2).reshape(WIDTH, -1).T
        kv, asks, lag = np.zeros((WIDTH, 2 * MIXED), kind), np.zeros((WIDTH, MIXED), kind), np.zeros((HEADS, STRIDE, SPAN), kind)
        for at, (qs, ks, vs, s, total) in zip(range(0, b, PART), kept):
            own = slice(at, at + PART)
            d = np.empty((len(s), HEADS, STRIDE, HEAD + 1), kind)  # of the weighted sums and of the sum of weights
            np.divide(do[own].transpose(0, 2, 1, 3), total, out=d[..., :HEAD])
            np.einsum("bhtw,bthw->bht", d[..., :HEAD], o[own], out=d[..., HEAD])
            np.negative(d[..., HEAD], out=d[..., HEAD])
            back = np.empty((len(s), SPAN, HEADS, 2 * HEAD), kind)
            to = back.transpose(0, 2, 1, 3)
            to[..., HEAD:] = s.transpose(0, 1, 3, 2) @ d[..., :HEAD]
            ds = d @ vs.transpose(0, 1, 3, 2)
            ds *= s
            lag += ds.sum(0)
            to[..., :HEAD] = ds.transpose(0, 1, 3, 2) @ qs
            asked = np.ascontiguousarray((ds @ ks).transpose(0, 2, 1, 3)).reshape(-1, MIXED)
            asked /= kind.type(np.sqrt(HEAD))
            back = back.reshape(-1, 2 * MIXED)
            vectors = e.take(keys[own], 0)
            kv += vectors.reshape(-1, WIDTH).T @ back
            asks += np.ascontiguousarray(vectors[:, CONTEXT:]).reshape(-1, WIDTH).T @ asked
            np.matmul(back, rows_to, out=rows[own].reshape(-1, WIDTH))
            rows[own, CONTEXT:] += (asked @ p["Q"].T).reshape(-1, STRIDE, WIDTH)
        rows[:, CONTEXT:] += straight.reshape(b, STRIDE, WIDTH)
        for h in range(HEADS):
            g["R"][h] = np.bincount(_BACK0.ravel(), np.where(_FUTURE, 0, lag[h]).ravel(), SPAN)
        g["Q"], kv = asks, kv.reshape(WIDTH, HEADS, 2, HEAD)
        g["K"], g["V"] = (np.ascontiguousarray(kv[:, :, x]).reshape(WIDTH, MIXED) for x in (0, 1))
        g["E"] = self._by_id(keys.ravel(), rows.reshape(-1, WIDTH))
        g["E"][PAD] = 0
        full = np.zeros(targets.size, kind)
        full[live] = out
        for x in g.values():
            x /= kind.type(max(1, n))
        return full.reshape(targets.shape), g

    @staticmethod
    def _share_error(z: np.ndarray, pick: np.ndarray, shift: bool) -> np.ndarray:
        """Log shares of the picked columns; ``z`` becomes the gradient of their negative sum."""
        if shift:
            z -= z.max(1, keepdims=True)
        at = np.arange(len(z))
        out = z[at, pick]
        np.exp(z, out=z)
        total = z @ np.ones(SIDE, z.dtype)
        z /= total[:, None]
        z[at, pick] -= 1
        return out - np.log(total)

    @staticmethod
    def _by_id(ids: np.ndarray, rows: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
        """Sums of ``rows`` by id."""
        order = np.argsort(ids.astype(np.int16), kind="stable") if order is None else order
        out = np.zeros((IDS + 1, rows.shape[1]), rows.dtype)
        if len(ids):
            ids = ids[order]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            out[ids[first]] = np.add.reduceat(rows.take(order, 0), first, axis=0)
        return out

    def vector(self) -> np.ndarray:
        """All parameters one after another."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def take(self, vector: np.ndarray) -> None:
        """Parameters from what ``vector`` returned."""
        at = 0
        for k in sorted(self.p):
            shape, size = self.p[k].shape, self.p[k].size
            self.p[k] = vector[at : at + size].reshape(shape).astype(np.float32)
            at += size

    def train(self, keys: np.ndarray, targets: np.ndarray, steps: int, batch: int, rate: float = 4e-2, seed: int = 5) -> list[float]:
        """Adam with a falling rate; the losses."""
        draw, losses, descent = np.random.default_rng(seed), [], Descent(self)
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, draw.permutation(len(keys))])
            at, order = order[:batch], order[batch:]
            loss, g = self.gradients(keys[at].astype(np.int64), targets[at].astype(np.int64))
            losses.append(float(loss))
            descent.step(g, rate * min(1.0, step / 50) * (0.03 + 0.97 * (1 - step / steps)))
        return losses


class Descent:
    """Adam on the parameters of a model, which become parts of one array."""

    def __init__(self, model: AttentionModel):
        self.all = model.vector().astype(np.float32)
        at = 0
        for k in sorted(model.p):
            model.p[k] = self.all[at : at + model.p[k].size].reshape(model.p[k].shape)
            at += model.p[k].size
        self.m, self.v, self.steps = np.zeros_like(self.all), np.zeros_like(self.all), 0

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        x = np.concatenate([g[k].ravel() for k in sorted(g)]).astype(np.float32, copy=False)
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * x
        x *= x
        x *= np.float32(0.01)
        self.v *= np.float32(0.99)
        self.v += x
        np.sqrt(self.v, out=x)
        x *= np.float32(1 / np.sqrt(1 - 0.99**self.steps))
        x += np.float32(1e-8)
        np.divide(self.m, x, out=x)
        x *= np.float32(rate / (1 - 0.9**self.steps))
        self.all -= x
