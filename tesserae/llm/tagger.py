"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Sequences of a batch are padded at their end; a mask keeps the padding out of states, sums
and gradients.  Arrays run along time first: ``[time, sequence, ...]``.
"""

from __future__ import annotations

import numpy as np

CHARS = 130  # ASCII, other characters below U+2000 (letters above all), the rest


def characters(codes: np.ndarray) -> np.ndarray:
    """The network's numbers of code points."""
    return np.where(codes < 128, codes, np.where(codes < 0x2000, 128, 129)).astype(np.int32)


class Tagger:
    def __init__(self, labels: int, embed: int = 12, hidden: int = 16, seed: int = 1, allowed: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.hidden = hidden
        self.allowed = np.ones((labels, labels), np.float32) if allowed is None else allowed.astype(np.float32)
        self.p = {"E": rng.standard_normal((CHARS, embed)).astype(np.float32) * 0.5, "O": draw(2 * hidden, labels), "o": np.zeros(labels, np.float32)}
        self.p |= {"A": np.zeros((labels, labels), np.float32), "s": np.zeros(labels, np.float32), "t": np.zeros(labels, np.float32)}
        for d in "fb":
            self.p |= {f"X{d}": draw(embed, 4 * hidden), f"H{d}": draw(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1.0  # gates: in, keep, out, new; keep at first

    def _lstm(self, d: str, chars: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states along one direction; ``keep`` gets what the gradients need."""
        p, n = self.p, self.hidden
        half = np.repeat(np.array([0.5, 1.0], np.float32), [3 * n, n])  # the logistic function is a tanh of half
        table, inner = (p["E"] @ p[f"X{d}"] + p[f"c{d}"]) * half, p[f"H{d}"] * half
        h = c = np.zeros((chars.shape[1], n), np.float32)
        out = np.zeros((*chars.shape, n), np.float32)
        for t in range(len(chars)) if d == "f" else range(len(chars) - 1, -1, -1):
            z = np.tanh(table[chars[t]] + h @ inner)
            z[:, : 3 * n] = 0.5 * z[:, : 3 * n] + 0.5
            m = mask[t][:, None]
            new = (z[:, n : 2 * n] * c + z[:, :n] * z[:, 3 * n :]) * m
            bent = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, z, bent, m))
            h, c = z[:, 2 * n : 3 * n] * bent * m, new
            out[t] = h
        return out

    def _lstm_back(self, d: str, chars: np.ndarray, keep: list, dout: np.ndarray, g: dict[str, np.ndarray]) -> None:
        p, n = self.p, self.hidden
        dtable = np.zeros((CHARS, 4 * n), np.float32)
        dh = dc = np.zeros((chars.shape[1], n), np.float32)
        for t, h, c, z, bent, m in reversed(keep):
            i, f, o, new = (z[:, k * n : (k + 1) * n] for k in range(4))
            dh = (dh + dout[t]) * m
            dc = (dc + dh * o * (1 - bent**2)) * m
            dz = np.concatenate([dc * new * i * (1 - i), dc * c * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - new**2)], axis=1)
            g[f"H{d}"] += h.T @ dz
            np.add.at(dtable, chars[t], dz)
            dh, dc = dz @ p[f"H{d}"].T, dc * f
        g[f"X{d}"] += p["E"].T @ dtable
        g["E"] += dtable @ p[f"X{d}"].T
        g[f"c{d}"] += dtable.sum(0)

    def _crf(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of the labels at each place, expected transitions, and the log of each sequence's total."""
        p = self.p
        step, top = np.exp(p["A"]) * self.allowed, scores.max(2, keepdims=True)
        e = np.exp(scores - top)
        a, norm = np.empty_like(e), np.ones(scores.shape[:2], np.float32)
        for t in range(len(e)):
            now = np.exp(p["s"]) * e[t] if t == 0 else (a[t - 1] @ step) * e[t]
            total = now.sum(1)
            norm[t] = np.where(mask[t], total, 1)
            a[t] = np.where(mask[t][:, None], now / np.maximum(total, 1e-30)[:, None], a[t - 1] if t else 1)
        last = (a[-1] * np.exp(p["t"])).sum(1)
        b = np.empty_like(e)
        b[-1] = np.exp(p["t"]) / last[:, None]
        moves = np.zeros_like(step)
        for t in range(len(e) - 1, 0, -1):
            m = mask[t][:, None]
            ahead = e[t] * b[t] / norm[t][:, None]
            moves += (a[t - 1] * m).T @ ahead
            b[t - 1] = np.where(m, ahead @ step.T, b[t])
        logs = ((np.log(norm) + top[:, :, 0]) * mask).sum(0) + np.log(last)
        return a * b, moves * step, logs

    def scores(self, chars: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = np.concatenate([self._lstm(d, chars, mask, keep and keep[k]) for k, d in enumerate("fb")], axis=2)
        return states @ self.p["O"] + self.p["o"], states

    def marginals(self, chars: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities of the labels, ``[time, sequence, label]``."""
        return self._crf(self.scores(chars, mask)[0], mask)[0]

    def loss(self, chars: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the labels and its gradients."""
        p, keep, count = self.p, ([], []), chars.shape[1]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        scores, states = self.scores(chars, mask, keep)
        marginal, moves, logs = self._crf(scores, mask)
        hot = np.eye(len(p["o"]), dtype=np.float32)[labels]
        both = mask[1:] & mask[:-1]
        seen = np.zeros_like(p["A"])
        np.add.at(seen, (labels[:-1][both], labels[1:][both]), 1)
        ends = mask.sum(0) - 1
        of = np.arange(count)
        path = (scores * hot).sum(2)[mask].sum() + (p["A"] * seen).sum() + p["s"][labels[0]].sum() + p["t"][labels[ends, of]].sum()
        d = (marginal - hot) * mask[:, :, None] / count
        g["A"], g["s"] = (moves - seen) / count, d[0].sum(0)
        g["t"] = (marginal[ends, of] - hot[ends, of]).sum(0) / count
        flat, width = states.reshape(-1, states.shape[2]), self.hidden
        g["O"], g["o"] = flat.T @ d.reshape(len(flat), -1), d.sum((0, 1))
        dstates = d @ p["O"].T
        for k, name in enumerate("fb"):
            self._lstm_back(name, chars, keep[k], dstates[:, :, k * width : (k + 1) * width], g)
        return float((logs.sum() - path) / count), g

    def fit(self, chars: np.ndarray, mask: np.ndarray, labels: np.ndarray, epochs: int, batch: int = 64, rate: float = 1.5e-2, seed: int = 2) -> Tagger:
        """Adam on shuffled batches of ``[sequence, time]`` arrays, with a falling rate and clipped gradients."""
        rng, step = np.random.default_rng(seed), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        steps = epochs * -(-len(chars) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for i in range(0, len(order), batch):
                some = np.sort(order[i : i + batch])
                _, g = self.loss(chars[some].T, mask[some].T, labels[some].T)
                size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                step += 1
                now = rate * (1 - 0.95 * step / steps)
                for k, (m, v) in moments.items():
                    x = g[k] * min(1, 5 / max(size, 1e-9))
                    m += 0.1 * (x - m)
                    v += 0.01 * (x**2 - v)
                    self.p[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def best_paths(scores: np.ndarray, lengths: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The labels of the best allowed sequences, by Viterbi; ``scores`` is ``[time, sequence, label]``."""
    forbid = np.where(allowed > 0, 0, -1e9).astype(np.float32)
    total, back = scores[0], np.zeros(scores.shape, np.int8)
    for t in range(1, len(scores)):
        through = total[:, :, None] + forbid
        back[t] = through.argmax(1)
        moved = through.max(1) + scores[t]
        open_ = (t < lengths)[:, None]
        total, back[t] = np.where(open_, moved, total), np.where(open_, back[t], np.arange(scores.shape[2]))
    out = np.zeros(scores.shape[:2], np.int8)
    at, of = total.argmax(1), np.arange(scores.shape[1])
    for t in range(len(scores) - 1, -1, -1):
        out[t] = at
        at = back[t, of, at]
    return out
