"""A character-level bidirectional LSTM with CRF transitions, trained and run with numpy.

Arrays are time-major: (positions, windows, ...). Tags: 0 is outside, then a first and an inner tag per kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LETTER, OTHER, PAD = 128, 129, 130  # code points above ASCII, and the space beyond a window's text
CODES = 131
EMBEDDING, HIDDEN = 12, 20
NEVER = -1e4


def encode(text: str, width: int) -> np.ndarray:
    """Classes of the first ``width`` characters, padded."""
    codes = np.frombuffer(text[:width].encode("utf-32-le", "replace"), "<u4").astype(np.int32)
    out = np.full(width, PAD, np.int32)
    out[: len(codes)] = codes
    for i in np.flatnonzero(codes >= 128).tolist():
        out[i] = LETTER if text[i].isalpha() else OTHER
    return out


def allowed(kinds: int) -> np.ndarray:
    """0 where tag b may follow tag a, else a very low score: inner tags follow their own kind only."""
    tags = 1 + 2 * kinds
    out = np.zeros((tags, tags), np.float32)
    for k in range(kinds):
        inner = 2 + 2 * k
        out[:, inner] = NEVER
        out[inner - 1, inner] = out[inner, inner] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(inputs: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, list]:
    steps, rows, width = inputs.shape
    size = width // 4
    hidden, state = np.zeros((rows, size), np.float32), np.zeros((rows, size), np.float32)
    out, memory = np.zeros((steps, rows, size), np.float32), []
    for t in range(steps):
        z = inputs[t] + hidden @ recurrent
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before, state = state, f * state + i * g
        squashed = np.tanh(state)
        memory.append((hidden, before, i, f, o, g, squashed))
        hidden = o * squashed
        out[t] = hidden
    return out, memory


def _lstm_back(grads: np.ndarray, memory: list, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, rows, size = grads.shape
    d_inputs, d_recurrent = np.zeros((steps, rows, 4 * size), np.float32), np.zeros_like(recurrent)
    d_hidden, d_state = np.zeros((rows, size), np.float32), np.zeros((rows, size), np.float32)
    for t in reversed(range(steps)):
        hidden, before, i, f, o, g, squashed = memory[t]
        d_hidden = d_hidden + grads[t]
        d_state = d_state + d_hidden * o * (1 - squashed**2)
        d_z = np.concatenate(
            (d_state * g * i * (1 - i), d_state * before * f * (1 - f), d_hidden * squashed * o * (1 - o), d_state * i * (1 - g**2)), axis=1
        )
        d_inputs[t] = d_z
        d_recurrent += hidden.T @ d_z
        d_hidden, d_state = d_z @ recurrent.T, d_state * f
    return d_inputs, d_recurrent


@dataclass
class Tagger:
    """Parameters by name; a plain value, so that it travels to the workers as it is."""

    weights: dict[str, np.ndarray]
    kinds: int

    @classmethod
    def fresh(cls, kinds: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        tags = 1 + 2 * kinds
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"letters": draw(CODES, EMBEDDING) * 4, "out": draw(2 * HIDDEN, tags), "bias": np.zeros(tags, np.float32)}
        w |= {"steps": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32)}
        for side in ("ahead", "back"):
            w |= {f"{side}_in": draw(EMBEDDING, 4 * HIDDEN), f"{side}_rec": draw(HIDDEN, 4 * HIDDEN), f"{side}_bias": np.zeros(4 * HIDDEN, np.float32)}
            w[f"{side}_bias"][HIDDEN : 2 * HIDDEN] = 1
        return cls(w, kinds)

    def _emissions(self, codes: np.ndarray) -> tuple[np.ndarray, dict]:
        w, kept = self.weights, {}
        sides = []
        for side, order in (("ahead", codes), ("back", codes[::-1])):
            table = w["letters"] @ w[f"{side}_in"] + w[f"{side}_bias"]
            hidden, kept[side] = _lstm(table[order], w[f"{side}_rec"])
            sides.append(hidden if side == "ahead" else hidden[::-1])
        kept["both"] = np.concatenate(sides, axis=2)
        return kept["both"] @ w["out"] + w["bias"], kept

    def _posterior(self, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of the tags, expected transition counts, and log of the partition sum, by scaled forward-backward."""
        w = self.weights
        top = emissions.max(axis=2, keepdims=True)
        p, step = np.exp(emissions - top), np.exp(w["steps"] + allowed(self.kinds))
        ahead, back, scale = np.zeros_like(p), np.ones_like(p), np.zeros(p.shape[:2], np.float32)
        now = np.exp(w["start"]) * p[0]
        for t in range(len(p)):
            if t:
                now = (ahead[t - 1] @ step) * p[t]
            scale[t] = now.sum(axis=1)
            ahead[t] = now / scale[t][:, None]
        for t in range(len(p) - 2, -1, -1):
            back[t] = ((back[t + 1] * p[t + 1]) @ step.T) / scale[t + 1][:, None]
        tags = p.shape[2]
        later = (p[1:] * back[1:] / scale[1:, :, None]).reshape(-1, tags)
        pairs = ahead[:-1].reshape(-1, tags).T @ later * step
        return ahead * back, pairs, (np.log(scale).sum(axis=0) + top[:, :, 0].sum(axis=0))

    def marginals(self, codes: np.ndarray) -> np.ndarray:
        """Tag probabilities of windows (rows) of classes: (windows, positions, tags)."""
        return self._posterior(self._emissions(codes.T)[0])[0].transpose(1, 0, 2)

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the windows' tags and its gradients."""
        codes, tags, w = codes.T, tags.T, self.weights
        rows = codes.shape[1]
        emissions, kept = self._emissions(codes)
        gamma, pairs, partition = self._posterior(emissions)
        gold = np.eye(emissions.shape[2], dtype=np.float32)[tags]
        steps = np.zeros_like(pairs)
        np.add.at(steps, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        score = (emissions * gold).sum() + (w["steps"] * steps).sum() + w["start"][tags[0]].sum()
        loss = (partition.sum() - score) / rows
        d_emissions = (gamma - gold) / rows
        g = {"steps": (pairs - steps) / rows, "start": (gamma[0] - gold[0]).sum(axis=0) / rows}
        flat = d_emissions.reshape(-1, d_emissions.shape[2])
        g |= {"out": kept["both"].reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(axis=0), "letters": np.zeros_like(w["letters"])}
        d_both = d_emissions @ w["out"].T
        for side, order, part in (("ahead", codes, d_both[:, :, :HIDDEN]), ("back", codes[::-1], d_both[::-1, :, HIDDEN:])):
            d_inputs, g[f"{side}_rec"] = _lstm_back(part, kept[side], w[f"{side}_rec"])
            hot = np.eye(CODES, dtype=np.float32)[order.ravel()]
            d_table = hot.T @ d_inputs.reshape(-1, 4 * HIDDEN)
            g[f"{side}_in"], g[f"{side}_bias"] = w["letters"].T @ d_table, d_table.sum(axis=0)
            g["letters"] += d_table @ w[f"{side}_in"].T
        return float(loss), g

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.012, seed: int = 0) -> Tagger:
        """Adam over random batches, its rate falling to nothing."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for t in range(1, steps + 1):
            rows = r.integers(0, len(codes), min(batch, len(codes)))
            _, g = self.gradients(codes[rows], tags[rows])
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            clip = min(1.0, 5.0 / (size + 1e-9))
            for k, v in g.items():
                v = v * clip
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                change = first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
                self.weights[k] -= (rate * (1 - (t - 1) / steps) * change).astype(np.float32)
        return self


def best_path(probabilities: np.ndarray, kinds: int) -> np.ndarray:
    """The likeliest permitted tag sequence for averaged tag probabilities (positions, tags)."""
    score, rule = np.log(probabilities + 1e-6), allowed(kinds)
    came = np.zeros(score.shape, np.int8)
    now = score[0]
    for t in range(1, len(score)):
        options = now[:, None] + rule
        came[t] = options.argmax(axis=0)
        now = options.max(axis=0) + score[t]
    path = np.zeros(len(score), np.int64)
    path[-1] = now.argmax()
    for t in range(len(score) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path
