"""A character tagger in numpy: a bidirectional LSTM under a chain of tag transitions (CRF)."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_MARKS = " \n@.+-()_%,:;=\"'/|<>[]{}#&*!?$"
SYMBOLS = 5 + len(_MARKS)


def symbols(codes: np.ndarray) -> np.ndarray:
    """A small alphabet: digit, lower, upper, other, beyond ASCII, and each common mark; 0 is padding."""
    table = np.full(129, 4, np.int64)
    table[48:58], table[97:123], table[65:91], table[128] = 1, 2, 3, 5
    for i, c in enumerate(_MARKS):
        table[ord(c)] = 6 + i
    return table[np.minimum(codes, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Tagger:
    """Windows are rows of symbols; all of one length."""

    def __init__(self, hidden: int = 24, embedding: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"embed": draw(SYMBOLS + 1, embedding), "out": draw(2 * hidden, TAGS), "out_bias": np.zeros(TAGS, np.float32)}
        for side in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p |= {f"x{side}": draw(embedding, 4 * hidden), f"h{side}": draw(hidden, 4 * hidden), f"bias{side}": bias}
        self.p["moves"] = np.zeros((TAGS, TAGS), np.float32)
        self.p["first"] = np.zeros(TAGS, np.float32)

    def _lstm(self, ids: np.ndarray, side: str, keep: bool):
        """Hidden states of one direction, (time, row, unit), and what going back needs."""
        p, n = self.p, self.hidden
        inputs = p["embed"] @ p[f"x{side}"] + p[f"bias{side}"]
        rows, steps = ids.shape
        h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
        states, trace = np.zeros((steps, rows, n), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = inputs[ids[:, t]] + h @ p[f"h{side}"]
            gates = _sigmoid(z)
            gates[:, 2 * n : 3 * n] = np.tanh(z[:, 2 * n : 3 * n])
            i, f, g, o = (gates[:, k * n : (k + 1) * n] for k in range(4))
            before, h_before = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            states[t] = h
            if keep:
                trace.append((t, gates, before, squashed, h_before))
        return states, trace

    def emissions(self, ids: np.ndarray, keep: bool = False):
        forward, ft = self._lstm(ids, "f", keep)
        backward, bt = self._lstm(ids, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["out_bias"], both, {"f": ft, "b": bt}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of each window (Viterbi)."""
        scores = self.emissions(ids)[0]
        best, back = scores[0] + self.p["first"], []
        for t in range(1, len(scores)):
            paths = best[:, :, None] + self.p["moves"]
            back.append(paths.argmax(axis=1))
            best = paths.max(axis=1) + scores[t]
        tags = np.zeros(ids.shape, np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(len(scores) - 2, -1, -1):
            tags[:, t] = back[t][np.arange(len(tags)), tags[:, t + 1]]
        return tags

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        p, n = self.p, self.hidden
        scores, both, traces = self.emissions(ids, keep=True)
        steps, rows, _ = scores.shape
        moves = p["moves"]
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + p["first"]
        for t in range(1, steps):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = _log_sum(moves + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        chance = np.exp(ahead + behind - total[None, :, None])
        gold = tags.T
        time, row = np.arange(steps)[:, None], np.arange(rows)[None, :]
        loss = total.sum() - scores[time, row, gold].sum() - p["first"][gold[0]].sum() - moves[gold[:-1], gold[1:]].sum()
        g = {}
        d_scores = chance.copy()
        d_scores[time, row, gold] -= 1
        g_moves = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            pair = ahead[t - 1][:, :, None] + moves + (scores[t] + behind[t])[:, None, :] - total[:, None, None]
            g_moves += np.exp(pair).sum(axis=0)
        np.add.at(g_moves, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        g["moves"], g["first"] = g_moves, chance[0].sum(axis=0) - np.bincount(gold[0], minlength=TAGS)
        flat = d_scores.reshape(-1, TAGS)
        g["out"], g["out_bias"] = both.reshape(-1, 2 * n).T @ flat, flat.sum(axis=0)
        d_both = d_scores @ p["out"].T
        g["embed"] = np.zeros_like(p["embed"])
        for k, side in enumerate("fb"):
            d_inputs, g_h = np.zeros((SYMBOLS + 1, 4 * n)), np.zeros_like(p[f"h{side}"])
            d_h, d_c = np.zeros((rows, n)), np.zeros((rows, n))
            for t, gates, before, squashed, h_before in reversed(traces[side]):
                i, f, c, o = (gates[:, j * n : (j + 1) * n] for j in range(4))
                d_h = d_h + d_both[t][:, k * n : (k + 1) * n]
                d_c = d_c + d_h * o * (1 - squashed * squashed)
                d_z = np.concatenate(
                    [d_c * c * i * (1 - i), d_c * before * f * (1 - f), d_c * i * (1 - c * c), d_h * squashed * o * (1 - o)], axis=1
                )
                np.add.at(d_inputs, ids[:, t], d_z)
                g_h += h_before.T @ d_z
                d_h, d_c = d_z @ p[f"h{side}"].T, d_c * f
            g[f"h{side}"], g[f"x{side}"], g[f"bias{side}"] = g_h, p["embed"].T @ d_inputs, d_inputs.sum(axis=0)
            g["embed"] += d_inputs @ p[f"x{side}"].T
        return loss / rows, {name: x / rows for name, x in g.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 4, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Tagger:
        """Adam over shuffled batches, with falling steps."""
        rng = np.random.default_rng(seed)
        mean, square = ({k: np.zeros(x.shape) for k, x in self.p.items()} for _ in range(2))
        total, step = max(1, epochs * -(-len(ids) // batch)), 0
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for at in range(0, len(ids), batch):
                own = order[at : at + batch]
                _, g = self.gradients(ids[own], tags[own])
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                for k, x in g.items():
                    x = x * min(1.0, 5.0 / (norm + 1e-9))
                    mean[k] += 0.1 * (x - mean[k])
                    square[k] += 0.01 * (x * x - square[k])
                    move = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                    self.p[k] -= (rate * (1 - step / (total + 1)) * move).astype(np.float32)
        return self
