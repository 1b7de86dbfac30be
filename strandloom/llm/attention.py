"""A small causal self-attention model over subword ids, in numpy.

A subword's probability is that of its class given the context, times its own among the class's members given
the class of the subword before it:

    p(id | context) = p(class | context) * p(id | class, subword before)

The second factor and a prior for the first are counts over the whole corpus, discounted; one layer of masked
attention, fitted by gradient steps on windows, gives the first. What attention adds is scaled by what helps on
windows kept from fitting, down to nothing.
"""

from __future__ import annotations

import copy

import numpy as np

CLASSES = 64
WIDTH = 16
WINDOW = 32
OVERLAP = 8
#: Frequent ids whose places beside an id tell its class.
CONTEXT = 64
#: What is taken off every count in the tables and given to what has none.
DISCOUNT = 0.75
#: What large weights lose in a step, by the rate.
DECAY = 0.02
#: Parts of the fitted logits that are tried on the windows kept from fitting.
SCALES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Logits are kept within this distance of 0, where no exponential overflows.
LOGIT = 80.0
#: Frequent subwords with a row, and with a column, of their own in the table of what follows what.
ROWS = 1024
COLUMNS = 8192


def neighbour_places(counts: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """The column of every id in ``group_subwords``'s counts: the most frequent have their own, all others the last."""
    place = np.full(len(counts), context, dtype=np.int32)
    frequent = np.argsort(-counts, kind="stable")[:context]
    place[frequent] = np.arange(len(frequent))
    return place


def group_subwords(x: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """A class for each id, by k-means over how often frequent ids stand before and after it.

    ``x[id]`` holds these counts over the whole corpus. Ids without any share the last class."""
    weight = x.sum(axis=1, dtype=np.float64)
    ids = np.flatnonzero(weight)
    out = np.full(len(x), classes - 1, dtype=np.int64)
    k = min(classes - 1, len(ids))
    if k:
        x, weight = x[ids].astype(np.float32), weight[ids]
        x = np.sqrt((x + 0.1 * x.mean(axis=0)) / (weight + 1)[:, None]).astype(np.float32)
        centre = x[np.argsort(-weight, kind="stable")[:k]].copy()
        for _ in range(rounds):
            near = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
            for c in range(k):
                mine = near == c
                if mine.any():
                    centre[c] = np.average(x[mine], axis=0, weights=weight[mine])
        out[ids] = near
    return out


class Contexts:
    """What the subword before another is known by: its own row if it is among the most frequent, else its class's; last, a text's start.

    ``column`` gives the most frequent ids a column of the count table, all others one in common."""

    def __init__(self, class_of: np.ndarray, counts: np.ndarray, rows: int = ROWS, columns: int = COLUMNS) -> None:
        order = np.argsort(-counts, kind="stable")
        self.class_of = class_of.astype(np.int32)
        self.classes = CLASSES if class_of.max(initial=0) < CLASSES else int(class_of.max()) + 1
        rows, columns = min(rows, len(counts)), min(columns, len(counts))
        self.row = self.class_of + rows
        self.row[order[:rows]] = np.arange(rows)
        self.start = rows + self.classes
        self.column = np.full(len(counts), columns, dtype=np.int32)
        self.column[order[:columns]] = np.arange(columns)
        self.shape = (self.start + 1, columns + 1)

    def cells(self, stream: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The cell of the count table of every subword of a stream of texts that begin at ``begins``."""
        r = np.empty(len(stream), dtype=np.int32)
        r[1:] = self.row[stream[:-1]]
        r[begins] = self.start
        return r * self.shape[1] + self.column[stream]


class Model:
    """Tables of counts and the attention layer.

    ``member[row, column]``: log p(id | its class, row) of the ids with a column; an id without one has
    ``share[id] + left[row, its class]``. ``prior[row, class]``: log p(class | row), to which attention adds. Counts are discounted and what
    is taken off goes to the class's, or all classes', frequencies in the whole corpus."""

    def __init__(self, contexts: Contexts, counts: np.ndarray, table: np.ndarray, width: int = WIDTH, window: int = WINDOW, overlap: int = OVERLAP, seed: int = 7) -> None:
        """``counts[id]`` and ``table`` (of the contexts' shape) are counts over the corpus."""
        self.contexts, self.window, self.overlap = contexts, window, overlap
        class_of, classes, vocab = contexts.class_of, contexts.classes, len(counts)
        smooth = counts + 0.05  # ids never seen keep some probability
        mass = np.bincount(class_of, weights=smooth, minlength=classes)
        own = smooth / mass[class_of]
        self.share = np.log(own).astype(np.float32)
        named = contexts.column < contexts.shape[1] - 1
        listed = np.flatnonzero(named)
        listed = listed[np.argsort(contexts.column[listed])]
        group = class_of[listed]
        # counts of ids without a column, by class
        rest = np.bincount(class_of[~named], weights=smooth[~named], minlength=classes)
        spread = rest / max(rest.sum(), 1e-30)
        total, taken = np.zeros((2, len(table), classes))
        for c in range(classes):
            mine = table[:, :-1][:, group == c]
            total[:, c] = mine.sum(axis=1, dtype=np.float64)
            taken[:, c] = np.minimum(mine, DISCOUNT).sum(axis=1, dtype=np.float64)
        extra = table[:, -1:].astype(np.float64) * spread
        whole = total + extra
        empty = whole == 0
        safe = np.where(empty, 1.0, whole)
        back = np.where(empty, 1.0, np.maximum(taken, 1e-6 * safe))  # the share of counts that goes by frequency
        unlisted = back + extra * (mass / np.maximum(rest, 1e-30))
        # one over all that is given out
        norm = np.where(empty, 1.0, total - taken + back + extra)
        self.left = np.log(np.where(rest > 0, unlisted, 1.0) / norm).astype(np.float32)
        self.member = np.empty((len(table), len(listed)), dtype=np.float16)
        for r in range(len(table)):
            n = table[r, :-1].astype(np.float64)
            self.member[r] = np.log((n - np.minimum(n, DISCOUNT) + back[r, group] * own[listed]) / norm[r, group])
        mean = whole.sum(axis=0) + 0.5
        off = np.minimum(whole, DISCOUNT)
        given = np.maximum(off.sum(axis=1, keepdims=True), 1e-3)
        self.prior = np.log((whole - off + given * mean / mean.sum()) / ((whole - off).sum(axis=1, keepdims=True) + given)).astype(np.float32)
        rng = np.random.default_rng(seed)
        d = width
        p = {
            "class_in": rng.normal(0, 0.3, (classes + 1, d)), "id_in": np.zeros((vocab + 1, d)), "place": rng.normal(0, 0.1, (window, d)), "q": rng.normal(0, d**-0.5, (d, d)), "k": rng.normal(0, d**-0.5, (d, d)),
            "v": rng.normal(0, d**-0.5, (d, d)), "o": rng.normal(0, 0.1 * d**-0.5, (d, d)), "out": rng.normal(0, 0.1, (d, classes)), "skip": np.zeros((d, classes)),
        }
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.seen = np.tri(window, dtype=np.float32)
        self.input: np.ndarray | None = None

    def _forward(self, before: np.ndarray):
        """All that training needs; ``before`` holds the subwords before each position, -1 at a text's start. The last is the logits."""
        p, x = self.p, self.contexts
        (n, t), d = before.shape, p["q"].shape[0]
        start = before < 0
        ids = np.where(start, len(x.class_of), before).ravel()
        c = np.append(x.class_of, np.int32(x.classes))[ids]
        into = np.concatenate([p["q"] * np.float32(d**-0.5), p["k"], p["v"]], axis=1)
        h0 = p["id_in"][ids] + p["class_in"][c]
        h0.reshape(n, t, d)[...] += p["place"][:t]
        qkv = (h0 @ into).reshape(n, t, 3 * d)
        a = qkv[:, :, :d] @ qkv[:, :, d : 2 * d].transpose(0, 2, 1)
        np.clip(a, -LOGIT, LOGIT, out=a)
        np.exp(a, out=a)
        a *= self.seen[:t, :t]
        a /= (a @ np.ones(t, dtype=np.float32))[:, :, None]
        z = np.empty((n * t, 2 * d), dtype=np.float32)
        z[:, :d] = h0
        h = (a @ qkv[:, :, 2 * d :]).reshape(-1, d)
        z[:, d:] = h @ p["o"]
        y = z @ np.concatenate([p["skip"], p["out"]])
        y += self.prior[np.append(x.row, x.start)[ids]]
        np.clip(y, -LOGIT, LOGIT, out=y)
        return ids, c, into, qkv, a, h, z, y.reshape(n, t, -1)

    def ready(self) -> Model:
        """Folds the fitted weights for scoring."""
        p, x = self.p, self.contexts
        self.input = np.concatenate([p["id_in"][:-1] + p["class_in"][:-1][x.class_of], p["id_in"][-1:] + p["class_in"][-1:]])
        self.scaled_q = p["q"] * np.float32(self.input.shape[1] ** -0.5)
        self.kv = np.concatenate([p["k"], p["v"]], axis=1)
        self.ends = np.concatenate([p["skip"], p["o"] @ p["out"]])
        return self

    def log_probs(self, before: np.ndarray, here: np.ndarray, first: int = 0) -> np.ndarray:
        """Natural log probability of ``here[:, first:]`` given the subwords before it in its window."""
        if self.input is None:
            self.ready()
        x = self.contexts
        n, t = before.shape
        d = self.input.shape[1]
        h = self.input[before]  # -1 is the last row, a text's start
        h += self.p["place"][:t]
        kv = h @ self.kv
        late = h[:, first:]
        a = (late @ self.scaled_q) @ kv[:, :, :d].transpose(0, 2, 1)
        np.clip(a, -LOGIT, LOGIT, out=a)
        np.exp(a, out=a)
        a *= self.seen[first:t, :t]
        mixed = np.empty((n, t - first, 2 * d), dtype=np.float32)
        mixed[:, :, :d] = late
        np.divide(a @ kv[:, :, d:], (a @ np.ones(t, dtype=np.float32))[:, :, None], out=mixed[:, :, d:])
        y = mixed.reshape(-1, 2 * d) @ self.ends
        back, now = before[:, first:].ravel(), here[:, first:].ravel()
        r = np.where(back >= 0, x.row[back], x.start)
        y += self.prior[r]
        c = x.class_of[now]
        np.clip(y, -LOGIT, LOGIT, out=y)
        picked = y[np.arange(len(y)), c]
        np.exp(y, out=y)
        out = picked - np.log(y @ np.ones(y.shape[1], dtype=np.float32))
        col = x.column[now]
        plain = col == self.member.shape[1]
        own = self.member[r, np.where(plain, 0, col)].astype(np.float32)
        if plain.any():
            own[plain] = self.share[now[plain]] + self.left[r[plain], c[plain]]
        return (out + own).reshape(n, t - first)

    def loss(self, windows: np.ndarray, scale: float = 1.0, batch: int = 512) -> float:
        """Mean natural log loss of the classes in ``windows``, with the attention's logits scaled."""
        total = n = 0.0
        out, skip = self.p["out"], self.p["skip"]
        self.p["out"], self.p["skip"] = out * np.float32(scale), skip * np.float32(scale)
        for a in range(0, len(windows), batch):
            w = windows[a : a + batch]
            here = w[:, 1:]
            *_, y = self._forward(np.where(w[:, :-1] == -2, 0, w[:, :-1]))
            want = self.contexts.class_of[np.maximum(here, 0)].astype(np.int64)
            lp = np.take_along_axis(y, want[:, :, None], axis=2)[:, :, 0] - np.log(np.exp(y).sum(axis=2))
            total -= float(lp[here >= 0].sum())
            n += float((here >= 0).sum())
        self.p["out"], self.p["skip"] = out, skip
        return total / max(n, 1.0)

    def vector(self) -> np.ndarray:
        """All fitted weights one after another."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def copied(self) -> Model:
        """A model with weights of its own and the same tables."""
        out = copy.copy(self)
        out.p = {k: v.copy() for k, v in self.p.items()}
        return out

    def load(self, vector: np.ndarray) -> Model:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = vector[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        self.input = None
        return self

    def settle(self, kept: np.ndarray) -> tuple[float, float]:
        """Scales what attention adds by what is best on the windows ``kept`` from fitting; returns the scale and the loss."""
        losses = [self.loss(kept, s) for s in SCALES] if len(kept) else [0.0] * (len(SCALES) - 1) + [-1.0]
        best = int(np.argmin(losses))
        self.p["out"] *= np.float32(SCALES[best])
        self.p["skip"] *= np.float32(SCALES[best])
        self.ready()
        return SCALES[best], losses[best]

    def fit(self, windows: np.ndarray, steps: int = 1200, batch: int = 128, rate: float = 0.01, seed: int = 11, kept: np.ndarray | None = None, every: int = 100, patience: int = 3) -> list[float]:
        """Adam on the class loss; ``windows[n, window + 1]``, padded by -2 at the end, a text's start -1. Returns the losses.

        Every window is taken once before any is taken again. Where windows are ``kept`` for it, the weights that do best on them stay, and fitting ends when that has not changed for a while."""
        if not len(windows):
            return []
        rng = np.random.default_rng(seed)
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        losses = []
        held = kept is not None and len(kept) > 0
        best, stay, idle = (self.loss(kept), self.vector(), 0) if held else (np.inf, None, 0)
        order, at, small = np.zeros(0, dtype=np.int64), 0, np.min_scalar_type(max(len(self.p["id_in"]), len(self.p["class_in"])))  # numbers of 16 bits are sorted by radix
        for step in range(1, steps + 1):
            if at >= len(order):
                order, at = rng.permutation(len(windows)), 0
            w = windows[order[at : at + batch]]
            at += batch
            before, here = np.where(w[:, :-1] == -2, 0, w[:, :-1]), w[:, 1:].ravel()
            ids, c, into, qkv, a, h, z, y = self._forward(before)
            (m, t), d, p = before.shape, z.shape[1] // 2, self.p
            valid = (here >= 0).astype(np.float32)
            n = max(1.0, float(valid.sum()))
            prob = y.reshape(m * t, -1)
            np.exp(prob, out=prob)
            one = 1 / (prob @ np.ones(prob.shape[1], dtype=np.float32))
            places, want = np.arange(m * t), self.contexts.class_of[np.maximum(here, 0)]
            losses.append(float(-(np.log(prob[places, want] * one + 1e-12) * valid).sum() / n))
            valid /= np.float32(n)
            prob *= (one * valid)[:, None]
            prob[places, want] -= valid
            ends = z.T @ prob
            dz = prob @ np.concatenate([p["skip"], p["out"]]).T
            g = {"skip": ends[:d], "out": ends[d:], "o": h.T @ dz[:, d:]}
            dh = dz[:, d:] @ p["o"].T
            fall = np.einsum("ij,ij->i", dh, h).reshape(m, t, 1)
            dh = dh.reshape(m, t, d)
            q, k, v = qkv[:, :, :d], qkv[:, :, d : 2 * d], qkv[:, :, 2 * d :]
            da = dh @ v.transpose(0, 2, 1)
            da -= fall
            da *= a
            dqkv = np.empty_like(qkv)
            dqkv[:, :, :d], dqkv[:, :, d : 2 * d], dqkv[:, :, 2 * d :] = da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh
            dqkv = dqkv.reshape(-1, 3 * d)
            g["q"], g["k"], g["v"] = np.split(z[:, :d].T @ dqkv, 3, axis=1)
            g["q"] *= np.float32(d**-0.5)
            dx = dz[:, :d] + dqkv @ into.T
            g["place"] = np.zeros_like(p["place"])
            g["place"][:t] = dx.reshape(m, t, d).sum(axis=0)
            # tables are moved where they were used only
            by = np.argsort(ids.astype(small), kind="stable")
            edge = np.flatnonzero(np.diff(ids[by], prepend=-1))
            rows, some = ids[by[edge]], np.add.reduceat(dx[by], edge, axis=0)
            kinds = c[by[edge]]
            by = np.argsort(kinds.astype(small), kind="stable")
            edge = np.flatnonzero(np.diff(kinds[by], prepend=-1))
            g["class_in"] = np.zeros_like(p["class_in"])
            g["class_in"][kinds[by[edge]]] = np.add.reduceat(some[by], edge, axis=0)
            lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for name, grad in [*g.items(), ("id_in", some)]:
                first, second = state[name]
                mine = rows if name == "id_in" else slice(None)
                up, wide = 0.9 * first[mine] + 0.1 * grad, 0.99 * second[mine] + 0.01 * grad**2
                first[mine], second[mine] = up, wide
                now = self.p[name][mine] - (lr / (1 - 0.9**step)) * up / (np.sqrt(wide / (1 - 0.99**step)) + 1e-6)
                self.p[name][mine] = now * (1 - lr * DECAY) if name in ("id_in", "out", "skip") else now
            if held and (step % every == 0 or step == steps):
                now = self.loss(kept)
                best, stay, idle = (now, self.vector(), 0) if now < best else (best, stay, idle + 1)
                if idle >= patience:
                    break
        if held:
            self.load(stay)
        self.ready()
        return losses

    def score(self, stream: np.ndarray, lengths: np.ndarray, batch: int = 128) -> np.ndarray:
        """Natural log probability of each text of ``stream`` (texts one after another), all their subwords once."""
        if not len(stream):
            return np.zeros(len(lengths))
        return np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=self.each(stream, lengths, batch), minlength=len(lengths))

    def each(self, stream: np.ndarray, lengths: np.ndarray, batch: int = 128) -> np.ndarray:
        """Natural log probability of each subword of ``stream``.

        A text's first window scores all its positions; each later one begins ``overlap`` positions earlier and scores the rest."""
        w, o = self.window, self.overlap
        step, n = w - o, len(stream)
        out = np.zeros(n + 1, dtype=np.float32)  # the last takes what lies behind a text's end
        ends = np.cumsum(lengths)
        begins = ends - lengths
        later = np.maximum(0, -(-(lengths - w) // step))
        text = np.repeat(np.arange(len(lengths)), later)
        order = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
        next_at = begins[text] + (order + 1) * step
        here, before = np.zeros((2, n + 1), dtype=np.int32)
        here[:n] = stream
        before[1:] = stream
        before[begins[lengths > 0]] = -1
        reach = np.arange(w)
        for at, end, first in ((begins, ends, 0), (next_at, ends[text], o)):
            for i in range(0, len(at), batch):
                spot = at[i : i + batch, None] + reach
                spot = np.where(spot < end[i : i + batch, None], spot, n)
                out[spot[:, first:]] = self.log_probs(before[spot], here[spot], first)
        return out[:n]
