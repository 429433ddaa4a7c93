"""A bidirectional gated recurrent network over bytes, trained in NumPy by backpropagation through time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

WINDOW = 32  # bytes of a word read at once; longer words are read window by window
READ_ROWS = 4096  # windows read at once
EDGE = 32  # the byte that marks both ends of a word


def windows(word: str) -> list[bytes]:
    """The word's bytes between edge marks, cut into windows."""
    raw = word.encode("utf-8")
    if len(raw) <= WINDOW:
        return [b"%c%b%c" % (EDGE, raw, EDGE)]
    cut = [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]
    cut[0] = bytes([EDGE]) + cut[0]
    cut[-1] += bytes([EDGE])
    return cut


def letters(x: np.ndarray) -> np.ndarray:
    """Positions that belong to letters: ASCII letters, and all bytes of other characters."""
    return (x >= 128) | ((x | 32) - 97 < 26) & (x >= 65)


def by_length(items: Sequence[bytes]) -> dict[int, np.ndarray]:
    """Positions in ``items`` of each length: sequences of one length need no padding."""
    n = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    order = np.argsort(n, kind="stable")
    cut = np.flatnonzero(np.diff(n[order])) + 1
    return {int(n[g[0]]): g for g in np.split(order, cut) if len(g)}


def as_matrix(items: Sequence[bytes], at: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join([items[i] for i in at]), dtype=np.uint8).reshape(len(at), length)


def _sigmoid(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    y = np.negative(x, out=out)
    np.exp(y, out=y)
    y += 1
    return np.divide(1, y, out=y)


class ByteGRU:
    """Per direction: table E of 256 x 3H gate inputs and recurrent weights U of H x 3H; output V, c.

    Gates in order: update z, reset r, candidate n, with n = tanh(E_n + r * (h U_n)) and
    h' = (1 - z) * n + z * h.  Every position gets softmax([forward h, backward h] V + c).
    """

    def __init__(self, labels: Sequence[str], hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = list(labels), hidden
        small = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"E0": small(256, 3 * hidden), "E1": small(256, 3 * hidden), "U0": small(hidden, 3 * hidden), "U1": small(hidden, 3 * hidden)}
        self.p |= {"V": small(2 * hidden, len(self.labels)), "c": np.zeros(len(self.labels), np.float32)}

    def _states(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of both directions at once, each in its reading order (time, 2, rows, H): states, states before, z, r, h U_n and n."""
        k, (rows, length) = self.hidden, x.shape
        gate = np.stack([self.p["E0"][x.T], self.p["E1"][x.T[::-1]]], axis=1)
        u, zr = np.stack([self.p["U0"], self.p["U1"]]), gate[..., : 2 * k]
        h, before, q, n = (np.empty((length, 2, rows, k), dtype=gate.dtype) for _ in range(4))
        last = np.zeros((2, rows, k), dtype=gate.dtype)
        for t in range(length):
            before[t], rec = last, last @ u
            zr[t] += rec[..., : 2 * k]
            _sigmoid(zr[t], zr[t])
            q[t] = rec[..., 2 * k :]
            rec = zr[t, ..., k:] * q[t]
            rec += gate[t, ..., 2 * k :]
            np.tanh(rec, out=n[t])
            last = last - n[t]
            last *= zr[t, ..., :k]
            last += n[t]
            h[t] = last
        return h, before, zr[..., :k], zr[..., k:], q, n

    def _output(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities (time, rows, labels) from the states of both directions, and these side by side."""
        h = np.concatenate([h[:, 0], h[::-1, 1]], axis=2)
        s = h @ self.p["V"] + self.p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        return s / s.sum(axis=2, keepdims=True), h

    def positions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities (time, rows, labels) and states of a byte matrix."""
        return self._output(self._states(x)[0])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over letter positions, and its gradients through time."""
        states, before, z, r, q, n = self._states(x)
        prob, h = self._output(states)
        mask = letters(x).T.astype(prob.dtype)
        total = max(1.0, float(mask.sum()))
        rows = np.arange(len(x))
        loss = float(-(np.log(prob[:, rows, y] + 1e-12) * mask).sum() / total)
        d = prob.copy()
        d[:, rows, y] -= 1.0
        d *= mask[:, :, None] / total
        g = {"V": np.tensordot(h, d, axes=([0, 1], [0, 1])), "c": d.sum(axis=(0, 1))}
        out, k = d @ self.p["V"].T, self.hidden
        out = np.stack([out[..., :k], out[::-1, :, k:]], axis=1)
        by_z, by_n, by_r = (before - n) * z * (1 - z), (1 - z) * (1 - n * n), q * r * (1 - r)
        back = np.stack([self.p["U0"].T, self.p["U1"].T])
        # gradients of the gates' inputs: from h U in ``rec``, and of n from E in ``dn``
        rec, dn = np.empty((*z.shape[:3], 3 * k), dtype=h.dtype), np.empty_like(n)
        dh = np.zeros_like(out[0])
        for t in range(len(out) - 1, -1, -1):
            dh += out[t]
            np.multiply(dh, by_z[t], out=rec[t, ..., :k])
            np.multiply(dh, by_n[t], out=dn[t])
            np.multiply(dn[t], by_r[t], out=rec[t, ..., k : 2 * k])
            np.multiply(dn[t], r[t], out=rec[t, ..., 2 * k :])
            dh *= z[t]
            dh += rec[t] @ back
        for way in (0, 1):
            g[f"U{way}"] = before[:, way].reshape(-1, k).T @ rec[:, way].reshape(-1, 3 * k)
        rec[..., 2 * k :] = dn
        steps = np.concatenate([rec[:, 0], rec[::-1, 1]], axis=2).reshape(-1, 6 * k)
        read = x.T.ravel()
        used = np.unique(read)  # a product with few rows adds up faster than row by row
        sums = (used[:, None] == read).astype(steps.dtype) @ steps
        for way in (0, 1):
            g[f"E{way}"] = np.zeros_like(self.p[f"E{way}"])
            g[f"E{way}"][used] = sums[:, 3 * k * way : 3 * k * (way + 1)]
        return loss, g

    def fit(self, items: Sequence[bytes], y: np.ndarray, *, epochs: int = 4) -> None:
        """``epochs`` passes of ``learn`` over all items."""
        state = None
        for epoch in range(epochs):
            state = self.learn(items, y, state, epoch=epoch, epochs=epochs)

    def learn(
        self, items: Sequence[bytes], y: np.ndarray, state: np.ndarray | None, *, epoch: int, epochs: int,
        batch: int = 256, rate: float = 0.01, seed: int = 7,
    ) -> np.ndarray:
        """One pass of Adam over batches of windows of one length, from ``state`` on; returns the state after it.

        A state is one vector: steps taken, parameters, and Adam's two moments.  Means of states are states.
        """
        rng, size = np.random.default_rng([seed, epoch]), sum(v.size for v in self.p.values())
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        if state is not None:
            step = round(state[0])
            for at, into in enumerate((self.p, m, v)):
                lo = 1 + at * size
                for k, x in into.items():
                    into[k] = state[lo : lo + x.size].reshape(x.shape).astype(x.dtype)
                    lo += x.size
        work = [(n, s) for n, at in by_length(items).items() for s in np.array_split(rng.permutation(at), -(-len(at) // batch))]
        now = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(work)):
            n, at = work[i]
            _, g = self.gradients(as_matrix(items, at, n), y[at])
            step += 1
            for key, d in g.items():
                m[key] = 0.9 * m[key] + 0.1 * d
                v[key] = 0.999 * v[key] + 0.001 * d * d
                self.p[key] -= now * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
        return np.concatenate([[step], *[x.ravel() for part in (self.p, m, v) for x in part.values()]]).astype(np.float64)

    def load(self, state: np.ndarray) -> None:
        """Take the parameters of a state."""
        lo = 1
        for k, x in self.p.items():
            self.p[k] = state[lo : lo + x.size].reshape(x.shape).astype(x.dtype)
            lo += x.size

    def _probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (time, labels, rows) as of ``positions``; gates lie apart and states are not kept."""
        k, s = self.hidden, np.zeros((x.shape[1], len(self.labels), len(x)), np.float32)
        x = x.T.astype(np.intp)
        g, rec, part = (np.empty((n, x.shape[1]), np.float32) for n in (3 * k, 3 * k, len(s[0])))  # new arrays at each step cost more than the sums
        for way in (0, 1):
            e, u, v = (np.ascontiguousarray(w.T) for w in (self.p[f"E{way}"], self.p[f"U{way}"], self.p["V"][way * k : (way + 1) * k]))
            h = np.zeros((k, x.shape[1]), np.float32)
            for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
                np.take(e, x[t], axis=1, mode="clip", out=g)
                np.matmul(u, h, out=rec)
                zr, n = g[: 2 * k], rec[2 * k :]
                zr += rec[: 2 * k]
                _sigmoid(zr, zr)
                n *= zr[k:]
                n += g[2 * k :]
                n *= 2
                _sigmoid(n, n)
                n *= 2
                n -= 1  # the hyperbolic tangent
                h -= n
                h *= zr[:k]
                h += n
                s[t] += np.matmul(v, h, out=part)
        s += self.p["c"][:, None]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def pooled(self, items: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per window: probabilities summed over letter positions, and the number of these positions."""
        out, count = np.zeros((len(items), len(self.labels)), np.float32), np.zeros(len(items), np.int64)
        for n, at in by_length(items).items():
            for lo in range(0, len(at), READ_ROWS):
                part = at[lo : lo + READ_ROWS]
                x = as_matrix(items, part, n)
                mask = letters(x)
                out[part] = np.einsum("tlb,bt->bl", self._probabilities(x), mask.astype(np.float32))
                count[part] = mask.sum(axis=1)
        return out, count

    def label(self, text: str) -> list[str]:
        """The label of every byte position of a text's words, edge marks left out."""
        out = []
        for word in text.split():
            for i, w in enumerate(cut := windows(word)):
                x = np.frombuffer(w, np.uint8)[None, :]
                best = self.positions(x)[0][:, 0].argmax(axis=1)
                out += [self.labels[j] for j in best[i == 0 : len(best) - (i == len(cut) - 1)]]
        return out
