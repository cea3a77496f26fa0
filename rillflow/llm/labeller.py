"""A bidirectional LSTM over sequences, in NumPy: one probability for each place.

A place is a vector and a bag, a set of numbers whose weights add up; places that share a bag share that
sum.  Both are projected once for all gates of both directions; the recurrence then runs over padded
batches of sequences of like length.  Training is Adam on the mean logistic loss of all places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Places:
    """Vectors of a row of places, the distinct bags, none empty, and which bag each place has."""

    vectors: np.ndarray
    bags: list[np.ndarray]
    which: np.ndarray

    @staticmethod
    def joined(parts: list[Places]) -> Places:
        starts = np.cumsum([0, *(len(p.bags) for p in parts)])
        return Places(np.concatenate([p.vectors for p in parts]), [b for p in parts for b in p.bags], np.concatenate([p.which + s for p, s in zip(parts, starts)]))

    def membership(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers that the bags hold, and which bag (rows) holds which of them (columns)."""
        numbers, columns = np.unique(np.concatenate(self.bags), return_inverse=True)
        holds = np.zeros((len(self.bags), len(numbers)), np.float32)
        holds[np.repeat(np.arange(len(self.bags)), list(map(len, self.bags))), columns] = 1.0
        return numbers, holds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, width: int, bag_numbers: int, hidden: int = 16, seed: int = 5):
        r, self.hidden = np.random.default_rng(seed), hidden
        gates = lambda rows: r.normal(0, (1 / rows) ** 0.5, (2, rows, 4 * hidden)).astype(np.float32)
        bias = np.zeros((2, 4 * hidden), np.float32)
        bias[:, hidden : 2 * hidden] = 1.0  # a cell keeps what it holds to begin with
        self.weights = {"input": gates(width), "bags": np.zeros((2, bag_numbers, 4 * hidden), np.float32), "state": gates(hidden), "bias": bias, "out": r.normal(0, 0.2, 2 * hidden).astype(np.float32), "shift": np.zeros(1, np.float32)}

    def project(self, places: Places) -> np.ndarray:
        """(n, 2, 4 * hidden): what each place sends to the gates of either direction."""
        numbers, holds = places.membership()
        sums = np.einsum("bk,dkg->bdg", holds, self.weights["bags"][:, numbers], optimize=True)
        return np.einsum("nw,dwg->ndg", places.vectors, self.weights["input"], optimize=True) + self.weights["bias"] + sums[places.which]

    def _direction(self, sent: np.ndarray, side: int, inside: np.ndarray) -> tuple[np.ndarray, list]:
        """States (t, batch, hidden) of one direction and what the way back needs; padding leaves the state as it is."""
        steps, batch = sent.shape[:2]
        h, c, size = np.zeros((batch, self.hidden), np.float32), np.zeros((batch, self.hidden), np.float32), self.hidden
        out, kept, weight = np.zeros((steps, batch, size), np.float32), [], self.weights["state"][side]
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            z = sent[t] + h @ weight
            ifo, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
            i, f, o = ifo[:, :size], ifo[:, size : 2 * size], ifo[:, 2 * size :]
            on = inside[t][:, None]
            new = np.where(on, f * c + i * g, c)
            tanh = np.tanh(new)
            state = np.where(on, o * tanh, h)
            kept.append((t, h, c, ifo, g, tanh))
            h, c, out[t] = state, new, state
        return out, kept

    def _sequences(self, sent: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Padded (t, batch, 2, gates), which places are there, and where each stands in the flat order."""
        starts = np.cumsum(lengths) - lengths
        places = np.arange(lengths.max())[:, None]
        inside = places < lengths
        flat = np.where(inside, starts + places, 0)
        return sent[flat], inside, flat

    def scores(self, sent: np.ndarray, lengths: np.ndarray, batch: int = 64) -> np.ndarray:
        """The probability of each place of sequences that stand one after another; ``sent`` is from ``project``."""
        out, starts = np.zeros(len(sent), np.float32), np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        while len(order):
            most = np.searchsorted(lengths[order], 2 * lengths[order[0]], side="right")  # little padding
            part, order = order[: min(batch, most)], order[min(batch, most) :]
            at = np.concatenate([np.arange(starts[s], starts[s] + lengths[s]) for s in part])
            padded, inside, flat = self._sequences(sent[at], lengths[part])
            states = [self._direction(padded[:, :, side], side, inside)[0] for side in (0, 1)]
            p = _sigmoid(np.concatenate(states, axis=2) @ self.weights["out"] + self.weights["shift"])
            out[at[flat[inside]]] = p[inside]
        return out

    def gradients(self, x: Places, lengths: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the places of one batch, and its gradients."""
        w, size = self.weights, self.hidden
        padded, inside, flat = self._sequences(self.project(x), lengths)
        sides = [self._direction(padded[:, :, side], side, inside) for side in (0, 1)]
        states = np.concatenate([s[0] for s in sides], axis=2)
        p, y, n = _sigmoid(states @ w["out"] + w["shift"]), truth[flat], inside.sum()
        loss = -(np.log(np.where(y, p, 1 - p) + 1e-9) * inside).sum() / n
        d = np.where(inside, (p - y) / n, 0).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["out"], grads["shift"] = np.einsum("tb,tbh->h", d, states), np.array([d.sum()], np.float32)
        to_states, back = d[:, :, None] * w["out"], np.zeros_like(padded)
        for side, (_, kept) in enumerate(sides):
            dh, dc = np.zeros_like(kept[0][1]), np.zeros_like(kept[0][1])
            for t, h, c, ifo, g, tanh in reversed(kept):
                i, f, o = ifo[:, :size], ifo[:, size : 2 * size], ifo[:, 2 * size :]
                on = inside[t][:, None]
                up = dh + to_states[t][:, side * size : (side + 1) * size]
                cell = dc + up * o * (1 - tanh**2)
                dz = np.where(on, np.hstack([cell * g * i * (1 - i), cell * c * f * (1 - f), up * tanh * o * (1 - o), cell * i * (1 - g**2)]), 0)
                back[t, :, side] = dz
                grads["state"][side] += h.T @ dz
                dh, dc = np.where(on, dz @ w["state"][side].T, dh), np.where(on, cell * f, dc)
        sent = back[inside]
        grads["bias"] = sent.sum(axis=0)
        at, (numbers, holds) = flat[inside], x.membership()
        grads["input"] = np.einsum("nw,ndg->dwg", x.vectors[at], sent, optimize=True)
        order = np.argsort(x.which[at], kind="stable")
        by_bag = np.add.reduceat(sent[order], np.searchsorted(x.which[at][order], np.arange(len(x.bags))))  # each bag has a place
        grads["bags"][:, numbers] = np.einsum("bk,bdg->dkg", holds, by_bag, optimize=True)
        return float(loss), grads

    def train(self, pages: list[tuple[Places, np.ndarray]], epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 6) -> None:
        """Adam over batches, in shuffled order, of (places, truth) sequences; the rate falls to a tenth."""
        r = np.random.default_rng(seed)
        first, second, step = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2)), None, 0
        first, second = first
        total = epochs * -(-len(pages) // batch)
        sizes = np.array([len(p[1]) for p in pages])
        for _ in range(epochs):
            order = np.argsort(sizes * r.uniform(0.8, 1.25, len(pages)))  # sequences of like length together
            for start in r.permutation(np.arange(0, len(order), batch)):
                part = [pages[i] for i in order[start : start + batch]]
                x, y = Places.joined([p[0] for p in part]), np.concatenate([p[1] for p in part])
                _, grads = self.gradients(x, np.array([len(p[1]) for p in part]), y)
                norm = sum(float((g**2).sum()) for g in grads.values()) ** 0.5
                step += 1
                now = rate * 0.1 ** (step / total)
                for k, g in grads.items():
                    at = np.s_[:, np.unique(np.concatenate(x.bags))] if k == "bags" else np.s_[...]  # weights that have no part in the batch rest
                    g = g[at] * min(1.0, 5.0 / (norm + 1e-9))
                    first[k][at] = 0.9 * first[k][at] + 0.1 * g
                    second[k][at] = 0.999 * second[k][at] + 0.001 * g**2
                    self.weights[k][at] -= now * (first[k][at] / (1 - 0.9**step)) / (np.sqrt(second[k][at] / (1 - 0.999**step)) + 1e-8)
