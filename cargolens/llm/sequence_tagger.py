"""A character tagger: two LSTMs, one from each side, and a CRF over their outputs, in numpy.

Characters are ASCII codes and one symbol for all others; 0 fills up a window. A window has a
tag for every character: 0 for nothing, and for each kind one tag for its first character and one
for the others. Many windows go through the recurrences side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOLS = 130
HIDDEN = 16


def symbols(text: str) -> np.ndarray:
    """The symbols of a text, one for each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes + 1, SYMBOLS - 1).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray, keep: bool):
    """Hidden states (steps, windows, H) over symbols (steps, windows); with ``keep`` the gates too."""
    steps, n = x.shape
    size = recurrent.shape[0]
    hidden = np.empty((steps, n, size), recurrent.dtype)
    gates, cells = [], []
    h = np.zeros((n, size), recurrent.dtype)
    c = np.zeros_like(h)
    for t in range(steps):
        z = inputs[x[t]]
        z += h @ recurrent
        ifo = _sigmoid(z[:, : 3 * size])
        g = np.tanh(z[:, 3 * size :])
        c = ifo[:, size : 2 * size] * c + ifo[:, :size] * g
        squashed = np.tanh(c)
        h = ifo[:, 2 * size :] * squashed
        hidden[t] = h
        if keep:
            gates.append((ifo, g, squashed))
            cells.append(c)
    return (hidden, gates, cells) if keep else hidden


def _lstm_gradient(x, inputs, recurrent, hidden, gates, cells, d_hidden):
    """Gradients of ``inputs`` and ``recurrent`` from those of the hidden states."""
    steps, n = x.shape
    size = recurrent.shape[0]
    d_z = np.empty((steps, n, 4 * size), recurrent.dtype)
    dh = np.zeros((n, size), recurrent.dtype)
    dc = np.zeros_like(dh)
    for t in range(steps - 1, -1, -1):
        ifo, g, squashed = gates[t]
        i, f, o = ifo[:, :size], ifo[:, size : 2 * size], ifo[:, 2 * size :]
        dh = dh + d_hidden[t]
        dc = dc + dh * o * (1 - squashed**2)
        before = cells[t - 1] if t else np.zeros_like(dc)
        d_z[t, :, :size] = dc * g * i * (1 - i)
        d_z[t, :, size : 2 * size] = dc * before * f * (1 - f)
        d_z[t, :, 2 * size : 3 * size] = dh * squashed * o * (1 - o)
        d_z[t, :, 3 * size :] = dc * i * (1 - g**2)
        dh = d_z[t] @ recurrent.T
        dc = dc * f
    d_recurrent = hidden[:-1].reshape(-1, size).T @ d_z[1:].reshape(-1, 4 * size)
    which = np.zeros((steps * n, len(inputs)), recurrent.dtype)
    which[np.arange(steps * n), x.reshape(-1)] = 1
    return which.T @ d_z.reshape(-1, 4 * size), d_recurrent


@dataclass
class Tagger:
    """The parameters by name; ``tags`` tags."""

    tags: int
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, tags: int, hidden: int = HIDDEN, seed: int = 7, dtype=np.float32) -> Tagger:
        rng = np.random.default_rng(seed)
        some = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(dtype)
        weights = {}
        for side in ("left", "right"):
            weights[f"{side}_inputs"] = some(SYMBOLS, 4 * hidden, scale=0.3)
            weights[f"{side}_inputs"][:, hidden : 2 * hidden] += 1  # remember at first
            weights[f"{side}_recurrent"] = some(hidden, 4 * hidden, scale=0.5 / hidden**0.5)
        weights["out"] = some(2 * hidden, tags, scale=0.3)
        weights["bias"] = np.zeros(tags, dtype)
        weights["transitions"] = some(tags, tags, scale=0.05)
        return cls(tags, weights)

    def _emissions(self, x: np.ndarray, keep: bool = False):
        w = self.weights
        left = _lstm(x, w["left_inputs"], w["left_recurrent"], keep)
        right = _lstm(x[::-1], w["right_inputs"], w["right_recurrent"], keep)
        states = [side[0] if keep else side for side in (left, right)]
        joined = np.concatenate([states[0], states[1][::-1]], axis=2)
        scores = joined @ w["out"] + w["bias"]
        return (scores, joined, left, right) if keep else scores

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(tag) of every place, log of the sum over all ways, and expected transitions."""
        steps, n, tags = scores.shape
        move = np.exp(self.weights["transitions"].astype(np.float64))
        top = scores.max(2, keepdims=True)
        local = np.exp((scores - top).astype(np.float64))
        ahead = np.empty((steps, n, tags))
        log_sum = top.astype(np.float64).sum((0, 2))
        for t in range(steps):
            a = local[t] if not t else (ahead[t - 1] @ move) * local[t]
            total = a.sum(1, keepdims=True)
            ahead[t] = a / total
            log_sum += np.log(total[:, 0])
        back = np.ones((n, tags))
        marginal = np.empty_like(ahead)
        moves = np.zeros((tags, tags))
        for t in range(steps - 1, -1, -1):
            p = ahead[t] * back
            marginal[t] = p / p.sum(1, keepdims=True)
            if t:
                reach = local[t] * back
                joint = (ahead[t - 1] @ move) * reach
                scaled = reach / joint.sum(1, keepdims=True)
                moves += move * (ahead[t - 1].T @ scaled)
                back = reach @ move.T
                back /= back.max(1, keepdims=True)
        return marginal, log_sum, moves

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient. Both arrays are (steps, windows)."""
        w, (steps, n) = self.weights, x.shape
        scores, joined, left, right = self._emissions(x, keep=True)
        marginal, log_sum, moves = self._marginals(scores)
        right_way = np.take_along_axis(scores, y[:, :, None].astype(np.int64), 2).astype(np.float64).sum()
        right_way += w["transitions"][y[:-1], y[1:]].astype(np.float64).sum()
        d_scores = marginal
        flat = d_scores.reshape(-1, self.tags)
        flat[np.arange(steps * n), y.reshape(-1)] -= 1
        np.add.at(moves, (y[:-1].reshape(-1), y[1:].reshape(-1)), -1)
        d_scores = (d_scores / n).astype(scores.dtype)
        size = joined.shape[2] // 2
        gradient = {
            "out": joined.reshape(-1, 2 * size).T @ d_scores.reshape(-1, self.tags),
            "bias": d_scores.sum((0, 1)),
            "transitions": (moves / n).astype(scores.dtype),
        }
        d_joined = d_scores @ w["out"].T
        for side, (hidden, gates, cells), d in (
            ("left", left, d_joined[:, :, :size]),
            ("right", right, d_joined[::-1, :, size:]),
        ):
            own = x if side == "left" else x[::-1]
            gradient[f"{side}_inputs"], gradient[f"{side}_recurrent"] = _lstm_gradient(
                own, w[f"{side}_inputs"], w[f"{side}_recurrent"], hidden, gates, cells, d
            )
        return float((log_sum.sum() - right_way) / n), gradient

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.012, seed: int = 3) -> Tagger:
        """Adam over windows (windows, steps) and their tags; the rate falls to a tenth."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                some = order[a : a + batch]
                _, gradient = self.loss(np.ascontiguousarray(x[some].T), np.ascontiguousarray(y[some].T))
                norm = sum(float((g**2).sum()) for g in gradient.values()) ** 0.5
                step += 1
                pace = rate * (1 - 0.9 * step / steps)
                for k, g in gradient.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    up = mean[k] / (1 - 0.9**step)
                    self.weights[k] -= (pace * up / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(up.dtype)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of every window (windows, steps) and the probability of each tag there."""
        scores = self._emissions(np.ascontiguousarray(x.T))
        steps, n, tags = scores.shape
        move = self.weights["transitions"]
        came = np.empty((steps, n, tags), np.int8)
        best = scores[0]
        for t in range(1, steps):
            value = best[:, :, None] + move
            came[t] = value.argmax(1)
            best = value.max(1) + scores[t]
        way = np.empty((steps, n), np.int8)
        way[-1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            way[t - 1] = came[t, rows, way[t]]
        marginal, _, _ = self._marginals(scores)
        chance = np.take_along_axis(marginal, way[:, :, None].astype(np.int64), 2)[:, :, 0]
        return way.T, chance.T
