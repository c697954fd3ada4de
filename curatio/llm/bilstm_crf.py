"""A character-level bidirectional LSTM with CRF transitions, in numpy.

All sequences of a batch have one length; ``mask`` marks the real characters, which must be
a prefix of each row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Net:
    symbols: int
    tags: int
    embed: int = 12
    hidden: int = 20
    seed: int = 7
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.w:
            return
        r, d, h = np.random.default_rng(self.seed), self.embed, self.hidden
        self.w["emb"] = r.normal(0, 0.3, (self.symbols, d)).astype(np.float32)
        for s in "fb":
            self.w[f"w{s}"] = r.normal(0, 1 / np.sqrt(d + h), (d + h, 4 * h)).astype(np.float32)
            self.w[f"c{s}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.w["out"] = r.normal(0, 0.2, (2 * h, self.tags)).astype(np.float32)
        self.w["bias"] = np.zeros(self.tags, np.float32)
        self.w["trans"] = np.zeros((self.tags, self.tags), np.float32)
        self.w["start"] = np.zeros(self.tags, np.float32)

    def _lstm(self, x: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        t, b, _ = x.shape
        h, c = np.zeros((b, self.hidden), np.float32), np.zeros((b, self.hidden), np.float32)
        n, out = self.hidden, np.zeros((t, b, self.hidden), np.float32)
        w, bias = self.w[f"w{side}"], self.w[f"c{side}"]
        from_x = x @ w[:self.embed] + bias
        for i in range(t):
            z = from_x[i] + h @ w[self.embed:]
            g = _sigmoid(z[:, :3 * n])
            u = np.tanh(z[:, 3 * n:])
            before, h_before = c, h
            c = g[:, n:2 * n] * c + g[:, :n] * u
            tc = np.tanh(c)
            h = g[:, 2 * n:] * tc
            out[i] = h
            if keep is not None:
                keep.append((g, u, before, tc, h_before))
        return out

    def _lstm_back(self, x: np.ndarray, side: str, keep: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        n, w = self.hidden, self.w[f"w{side}"]
        dh = np.zeros_like(dout[0])
        dc = np.zeros_like(dout[0])
        dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
        h_all = np.zeros((*x.shape[:2], n), np.float32)
        for i in range(len(x) - 1, -1, -1):
            g, u, before, tc, h_before = keep[i]
            gi, gf, go = g[:, :n], g[:, n:2 * n], g[:, 2 * n:]
            dh = dh + dout[i]
            dc = dc + dh * go * (1 - tc * tc)
            dz = dz_all[i]
            dz[:, :n] = dc * u * gi * (1 - gi)
            dz[:, n:2 * n] = dc * before * gf * (1 - gf)
            dz[:, 2 * n:3 * n] = dh * tc * go * (1 - go)
            dz[:, 3 * n:] = dc * gi * (1 - u * u)
            h_all[i] = h_before
            dh = dz @ w[self.embed:].T
            dc = dc * gf
        flat = dz_all.reshape(-1, 4 * n)
        grad[f"w{side}"] = np.concatenate([x.reshape(-1, self.embed).T @ flat, h_all.reshape(-1, n).T @ flat])
        grad[f"c{side}"] = flat.sum(axis=0)
        return dz_all @ w[:self.embed].T

    def _flip(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Reverses each row's real part of a (time, row, ...) array; the rest stays."""
        t = np.arange(len(x))[:, None]
        at = np.where(t < lengths, lengths - 1 - t, t)
        return np.take_along_axis(x, at[:, :, None], axis=0)

    def emissions(self, codes: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, row, tag) scores of ``codes`` (row, time)."""
        x = self.w["emb"][codes.T]
        xb = self._flip(x, lengths)
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._lstm(x, "f", kf)
        hb = self._flip(self._lstm(xb, "b", kb), lengths)
        h = np.concatenate([hf, hb], axis=2)
        if keep is not None:
            keep.update(x=x, xb=xb, kf=kf, kb=kb, h=h)
        return h @ self.w["out"] + self.w["bias"]

    def loss_and_gradient(self, codes: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, dict]:
        keep: dict = {}
        e = self.emissions(codes, lengths, keep).astype(np.float64)
        t, b, k = e.shape
        trans, start = self.w["trans"].astype(np.float64), self.w["start"].astype(np.float64)
        rows, real = np.arange(b), np.arange(t)[:, None] < lengths
        alpha = np.zeros((t, b, k))
        alpha[0] = start + e[0]
        for i in range(1, t):
            nxt = _logsumexp(alpha[i - 1][:, :, None] + trans, 1) + e[i]
            alpha[i] = np.where(real[i][:, None], nxt, alpha[i - 1])
        total = _logsumexp(alpha[-1], 1)
        beta = np.zeros((t, b, k))
        for i in range(t - 2, -1, -1):
            nxt = _logsumexp(trans + (e[i + 1] + beta[i + 1])[:, None, :], 2)
            beta[i] = np.where(real[i + 1][:, None], nxt, beta[i + 1])
        y = tags.T
        gold = start[y[0]] + e[0, rows, y[0]]
        de = np.exp(alpha + beta - total[:, None]) * real[:, :, None]
        dtrans = np.zeros((k, k))
        for i in range(1, t):
            on = real[i]
            if not on.any():
                break
            gold = gold + on * (trans[y[i - 1], y[i]] + e[i, rows, y[i]])
            pair = np.exp(alpha[i - 1][:, :, None] + trans + (e[i] + beta[i])[:, None, :] - total[:, None, None])
            dtrans += (pair * on[:, None, None]).sum(axis=0)
            np.add.at(dtrans, (y[i - 1][on], y[i][on]), -1)
        grad: dict = {"start": (np.exp(alpha[0] + beta[0] - total[:, None])).sum(axis=0), "trans": dtrans}
        np.add.at(grad["start"], y[0], -1)
        step, row = np.nonzero(real)
        de[step, row, y[step, row]] -= 1
        de = de.astype(np.float32)
        grad["out"] = keep["h"].reshape(t * b, -1).T @ de.reshape(t * b, k)
        grad["bias"] = de.reshape(-1, k).sum(axis=0)
        dh = de @ self.w["out"].T
        n = self.hidden
        dx = self._lstm_back(keep["x"], "f", keep["kf"], dh[:, :, :n], grad)
        dx = dx + self._flip(self._lstm_back(keep["xb"], "b", keep["kb"], self._flip(dh[:, :, n:], lengths), grad), lengths)
        grad["emb"] = np.zeros_like(self.w["emb"])
        np.add.at(grad["emb"], codes.T.reshape(-1), dx.reshape(-1, self.embed))
        return float((total - gold).sum()) / b, {a: v / b for a, v in grad.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, lengths: np.ndarray, epochs: int = 12, batch: int = 48,
            rate: float = 0.01) -> None:
        """Adam with a falling rate, over batches in a seeded order."""
        r, step = np.random.default_rng(self.seed), 0
        m = {a: np.zeros(v.shape) for a, v in self.w.items()}
        s = {a: np.zeros(v.shape) for a, v in self.w.items()}
        steps = max(1, epochs * -(-len(codes) // batch))
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                _, grad = self.loss_and_gradient(codes[pick], tags[pick], lengths[pick])
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                step += 1
                lr = rate * (1 - step / (steps + 1)) + 1e-4
                for a, g in grad.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    m[a] = 0.9 * m[a] + 0.1 * g
                    s[a] = 0.999 * s[a] + 0.001 * g * g
                    self.w[a] = (self.w[a] - lr * (m[a] / (1 - 0.9**step)) / (np.sqrt(s[a] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def decode(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag sequence of each row (row, time); 0 beyond its length."""
        e = self.emissions(codes, lengths)
        t, b, k = e.shape
        real = np.arange(t)[:, None] < lengths
        back = np.zeros((t, b, k), np.int8)
        score = self.w["start"] + e[0]
        for i in range(1, t):
            cand = score[:, :, None] + self.w["trans"]
            back[i] = cand.argmax(axis=1)
            score = np.where(real[i][:, None], cand.max(axis=1) + e[i], score)
        tag = score.argmax(axis=1)
        out, rows = np.zeros((t, b), np.int64), np.arange(b)
        for i in range(t - 1, -1, -1):
            out[i] = np.where(real[i], tag, 0)
            if i:
                tag = np.where(real[i], back[i, rows, tag], tag)
        return out.T
