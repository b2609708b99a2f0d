"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the mean of hashed embeddings of its character trigrams, its beginning and the word itself, so unseen spellings share parts
with seen ones. Windows of WINDOW words are read in both directions; attention weighs the states, and a logistic unit scores the
pooled state. Gradients are written out; dense weights train with Adam, embeddings with Adagrad.
"""

from __future__ import annotations

import numpy as np

BUCKETS, D, H, A = 1 << 15, 12, 8, 8
WINDOW, STRIDE = 32, 16
PREFIX = 5
WORDS_AT_ONCE = 20_000
#: Weights of a summary that the fit of the head starts from and is drawn to.
START = (0.3, 0.2, 0.0, 0.0)
#: Of training: share of words hidden at random, least probability of a toxic document's worst window, least number of steps.
DROP, TRUST, STEPS = 0.2, 0.3, 160
STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~…“”„‘’«»¡¿–—"


def normalize(word: str) -> str:
    return word.lower().strip(STRIP) or word


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' parts, one after the other, and where each word's begin: its trigrams between borders, its first
    PREFIX characters, and itself."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = "".join("\x02" + w + "\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    p = np.uint64(0x9E3779B97F4A7C15)
    mixed = (c + np.uint64(1)) * p
    mixed ^= mixed >> np.uint64(29)
    tri = np.zeros(len(c), np.uint64)
    tri[:-2] = (mixed[:-2] * np.uint64(31) + mixed[1:-1]) * np.uint64(31) + mixed[2:]
    place = np.arange(len(c)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(mixed * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), starts) * p
    with np.errstate(over="ignore"):
        front = np.add.reduceat(np.where(place <= PREFIX, mixed * (place.astype(np.uint64) * np.uint64(4) + np.uint64(3)), np.uint64(0)), starts) * p
    last = starts + lengths - 1
    tri[last - 1] = whole  # the two places without a trigram of their own
    tri[last] = front
    tri *= p
    return (tri >> np.uint64(64 - 15)).astype(np.int64), starts


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    starts[-1] = n - WINDOW
    return np.unique(starts)


def _sigmoid(x):
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def summary(owner: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    """Of each of n texts: its highest window's logit, the means of its three and eight highest, the logarithm of its number of
    windows, and 1. Texts without a window have zeros."""
    order = np.lexsort((-logit, owner))
    o, x = owner[order], np.clip(logit[order].astype(float), -20, 20)
    rank = np.arange(len(o)) - np.searchsorted(o, o)
    out = np.zeros((n, 5))
    for c, k in enumerate((1, 3, 8)):
        top = rank < k
        out[:, c] = np.bincount(o[top], x[top], n) / np.maximum(1, np.bincount(o[top], minlength=n))
    count = np.bincount(o, minlength=n)
    out[:, 3], out[:, 4] = np.log2(np.maximum(1, count)), count > 0
    return out


class BiGRU:
    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        g = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        self.E = g(BUCKETS, D, k=0.1)
        self.p = {"Wf": g(D, 3 * H), "Uf": g(H, 3 * H), "bf": np.zeros(3 * H, np.float32), "Wb": g(D, 3 * H), "Ub": g(H, 3 * H), "bb": np.zeros(3 * H, np.float32), "Wa": g(2 * H, A), "ba": np.zeros(A, np.float32), "va": g(A), "wo": g(2 * H), "bo": np.zeros(1, np.float32)}
        self.head, self.prior = np.array([*START, 0.0]), 0.0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.squares, self.step = np.zeros_like(self.E), 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("moments", "squares")}

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of words, float32 [len(words), D]."""
        buckets, starts = grams(words)
        sizes = np.diff(np.append(starts, len(buckets)))
        return np.add.reduceat(self.E[buckets], starts, axis=0) / sizes[:, None].astype(np.float32) if len(words) else np.zeros((0, D), np.float32)

    def projections(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What the words give to the gates, forward and backward."""
        x = np.concatenate([self.inputs(words[s : s + WORDS_AT_ONCE]) for s in range(0, max(1, len(words)), WORDS_AT_ONCE)])
        return x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]

    # Scoring: nothing is kept but the states.
    def _states(self, proj, ids, mask, back: bool) -> np.ndarray:
        n, width = ids.shape
        U, out, h = self.p["Ub" if back else "Uf"], np.empty((width, n, H), np.float32), np.zeros((n, H), np.float32)
        part = proj[back]
        for t in range(width - 1, -1, -1) if back else range(width):
            x, hu = part[ids[:, t]], h @ U
            zr = _sigmoid(x[:, : 2 * H] + hu[:, : 2 * H])
            new = np.tanh(x[:, 2 * H :] + zr[:, H:] * hu[:, 2 * H :])
            step = new + zr[:, :H] * (h - new)
            h = step if mask is None else np.where(mask[:, t, None], step, h)
            out[t] = h
        return out

    def _pool(self, h, mask):
        q = np.tanh(h @ self.p["Wa"] + self.p["ba"])
        s = q @ self.p["va"]
        if mask is not None:
            s = np.where(mask.T, s, np.float32(-1e9))
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        return q, a, np.einsum("tn,tnh->nh", a, h)

    def logits(self, proj: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """ids [windows, width]: rows of the projections; mask: where there is a word (None: everywhere)."""
        h = np.concatenate([self._states(proj, ids, mask, False), self._states(proj, ids, mask, True)], axis=2)
        return self._pool(h, mask)[2] @ self.p["wo"] + self.p["bo"]

    # Training.
    def _forward(self, x, mask, back):
        n = x.shape[1]
        U, h, keep = self.p["Ub" if back else "Uf"], np.zeros((n, H), np.float32), []
        xp = x @ self.p["Wb" if back else "Wf"] + self.p["bb" if back else "bf"]
        out = np.empty((*x.shape[:2], H), np.float32)
        for t in range(len(x) - 1, -1, -1) if back else range(len(x)):
            hu = h @ U
            zr = _sigmoid(xp[t, :, : 2 * H] + hu[:, : 2 * H])
            new = np.tanh(xp[t, :, 2 * H :] + zr[:, H:] * hu[:, 2 * H :])
            keep.append((t, h, zr, new, hu[:, 2 * H :]))
            h = np.where(mask[t], new + zr[:, :H] * (h - new), h)
            out[t] = h
        return out, keep

    def _backward(self, x, mask, back, keep, dh, grads):
        U, W = self.p["Ub" if back else "Uf"], self.p["Wb" if back else "Wf"]
        carry, dpre = np.zeros_like(dh[0]), np.zeros((*x.shape[:2], 3 * H), np.float32)
        dU = np.zeros_like(U)
        for t, h, zr, new, hun in reversed(keep):
            d = dh[t] + carry
            z, r = zr[:, :H], zr[:, H:]
            dn = d * (1 - z) * (1 - new * new)
            dz, dr = d * (h - new) * z * (1 - z), dn * hun * r * (1 - r)
            m = mask[t]
            pre_h = np.concatenate([dz, dr, dn * r], axis=1) * m
            dpre[t] = np.concatenate([dz, dr, dn], axis=1) * m
            dU += h.T @ pre_h
            carry = np.where(m, d * z + pre_h @ U.T, d)
        name = "b" if back else "f"
        grads["U" + name], grads["W" + name], grads["b" + name] = dU, np.einsum("tnd,tnk->dk", x, dpre), dpre.sum(axis=(0, 1))
        return dpre @ W.T

    def train(self, table: "Words", ids: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float = 0.01) -> float:
        """One step on windows ids [n, width] (-1: no word), labels y; the mean loss."""
        used, back = np.unique(np.maximum(ids, 0), return_inverse=True)
        back = back.reshape(ids.shape).T
        mask = (ids >= 0).T[:, :, None]
        buckets, owner, sizes = table.of(used)
        vectors = np.stack([np.bincount(owner, self.E[buckets, d], len(used)) for d in range(D)], axis=1) / sizes[:, None]
        x = vectors.astype(np.float32)[back] * mask
        hf, kf = self._forward(x, mask, False)
        hb, kb = self._forward(x, mask, True)
        h = np.concatenate([hf, hb], axis=2)
        q, a, pooled = self._pool(h, mask[:, :, 0].T)
        p = _sigmoid(pooled @ self.p["wo"] + self.p["bo"])
        loss = float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / weight.sum())
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        g = {"wo": pooled.T @ d, "bo": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["wo"]
        dh = a[:, :, None] * dp
        da = np.einsum("nh,tnh->tn", dp, h)
        ds = a * (da - (a * da).sum(axis=0))
        g["va"] = np.einsum("tn,tnk->k", ds, q)
        dq = ds[:, :, None] * self.p["va"] * (1 - q * q)
        g["Wa"], g["ba"] = np.einsum("tnh,tnk->hk", h, dq), dq.sum(axis=(0, 1))
        dh = dh + dq @ self.p["Wa"].T
        dx = (self._backward(x, mask, False, kf, dh[:, :, :H], g) + self._backward(x, mask, True, kb, dh[:, :, H:], g)) * mask
        self.step += 1
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            m, s = self.moments[k]
            m += 0.1 * (v - m)
            s += 0.001 * (v * v - s)
            self.p[k] -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)
        flat, dx = back.ravel(), dx.reshape(-1, D)
        dv = np.stack([np.bincount(flat, dx[:, k], len(used)) for k in range(D)], axis=1) / sizes[:, None]
        dE = np.stack([np.bincount(buckets, dv[owner, k], BUCKETS) for k in range(D)], axis=1).astype(np.float32)
        self.squares += dE * dE
        self.E -= 3 * rate * dE / (np.sqrt(self.squares) + 1e-6)
        return loss


class Words:
    """The training words' parts."""

    def __init__(self, words: list[str]):
        parts = [grams(words[s : s + WORDS_AT_ONCE]) for s in range(0, max(1, len(words)), WORDS_AT_ONCE)]
        shift = np.cumsum([0, *(len(b) for b, _ in parts)])
        self.buckets = np.concatenate([b for b, _ in parts])
        self.starts = np.append(np.concatenate([s + k for (_, s), k in zip(parts, shift)]), len(self.buckets))

    def of(self, used: np.ndarray):
        sizes = self.starts[used + 1] - self.starts[used]
        owner = np.repeat(np.arange(len(used)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[used], sizes)
        return self.buckets[at], owner, sizes


def fit(docs: list[tuple[list[str], int]], share: float, seed: int = 4, epochs: int = 2, refine: int = 3, batch: int = 256) -> BiGRU:
    """docs: (windows, of words with spaces between, label). A fifth of the documents only fits the head.

    First every window learns its document's label, for few passes, so that only what many windows share is learned. Then, as a
    document is toxic by its worst window, toxic documents teach by their two highest-scoring windows and clean ones by theirs and a
    share of the others; toxic documents without any window above `TRUST` are left out there, since their labels teach nothing but
    their own words. At last the summaries of the documents kept back fit the head, a logistic unit whose output is the
    probability, with toxic documents weighing `share` in all."""
    net, rng = BiGRU(), np.random.default_rng(seed)
    net.prior = share
    if len({y for _, y in docs}) < 2:
        net.head = np.array([0.0, 0.0, 0.0, 0.0, np.log((share + 1e-6) / (1 - share + 1e-6))])
        return net
    number: dict[str, int] = {}
    ids, owner = [], []
    for k, (parts, _) in enumerate(docs):
        for w in parts:
            row = [number.setdefault(x, len(number)) for x in w.split(" ")[:WINDOW]]
            ids.append(row + [-1] * (WINDOW - len(row)))
            owner.append(k)
    ids, owner, table = np.array(ids), np.array(owner), Words(list(number))
    label = np.array([y for _, y in docs], np.float32)
    y = label[owner]
    back = np.zeros(len(docs), bool)
    for v in (0, 1):
        of = np.flatnonzero(label == v)
        back[rng.permutation(of)[: len(of) // 5]] = True
    teach = np.flatnonzero(~back[owner])

    def run(rows, rate):
        balance = np.where(y == 1, 0.5 / max(1, (y[rows] == 1).sum()), 0.5 / max(1, (y[rows] == 0).sum())).astype(np.float32) * len(rows)
        rows = rng.permutation(rows)
        for s in range(0, len(rows), batch):
            some = rows[s : s + batch]
            seen = np.where(rng.random(ids[some].shape) < DROP, -1, ids[some])
            seen[:, 0] = ids[some, 0]
            net.train(table, seen, y[some], balance[some], rate)

    def logits():
        proj, out = net.projections(list(number)), np.empty(len(ids), np.float32)
        for s in range(0, len(ids), 4096):
            some = ids[s : s + 4096]
            out[s : s + 4096] = net.logits(proj, np.maximum(some, 0), some >= 0)
        top = np.full(len(docs), -np.inf, np.float32)
        np.maximum.at(top, owner, out)
        return out, top

    for _ in range(max(epochs, min(30, STEPS * batch // max(1, len(teach))))):  # small samples need more passes
        run(teach, 0.01)
    for _ in range(refine):
        out, top = logits()
        order = np.lexsort((-out, owner))
        rank = np.empty(len(ids), int)
        rank[order] = np.arange(len(ids)) - np.searchsorted(owner[order], owner[order])
        trusted = top[owner] > np.log(TRUST / (1 - TRUST))
        pick = ~back[owner] & np.where(y == 1, (rank < 2) & trusted, (rank < 2) | (rng.random(len(ids)) < 0.5))
        if len(set(y[pick])) == 2:
            for _ in range(max(1, min(10, STEPS * batch // 8 // max(1, pick.sum())))):
                run(np.flatnonzero(pick), 0.005)
    out, _ = logits()
    held = back if len(set(label[back])) == 2 and back.sum() >= 20 else np.ones(len(docs), bool)
    X, target = summary(owner, out, len(docs))[held], label[held].astype(float)
    weight = np.where(target == 1, share / max(1, target.sum()), (1 - share) / max(1, (1 - target).sum()))
    start = np.array([*START, 0.0])
    pull = np.array([1, 1, 1, 1, 0.01]) * 8.0 / len(target)
    w = start.copy()
    for _ in range(200):  # damped Newton steps of a regularised logistic fit
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        grad = X.T @ (weight * (p - target)) + pull * (w - start)
        step = np.linalg.solve((X * (weight * p * (1 - p))[:, None]).T @ X + np.diag(pull), grad)
        w = w - step * min(1.0, 0.5 / (1e-9 + np.abs(step).max()))
    net.head = w if np.isfinite(w).all() else start
    return net
