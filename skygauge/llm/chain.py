"""Linear-chain conditional random field with two labels (0, 1), sparse features, and Viterbi decoding."""

from __future__ import annotations

import numpy as np


class Chain:
    """weights[feature] is added to the score of label 1; steps[a, b] scores label b after label a."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.steps = np.zeros((2, 2))
        self.first = 0.0

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        w = self.weights
        out = np.array([sum(w.get(f, 0.0) for f in row) for row in rows])
        if len(out):
            out[0] += self.first
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Most likely labels by Viterbi; ties go to label 0."""
        if not rows:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        e = self.emissions(rows).tolist()
        a, b, back = 0.0, e[0], []
        for x in e[1:]:
            to0, to1 = (a + s00, b + s10), (a + s01, b + s11)
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            a, b = max(to0), max(to1) + x
        out = [int(b > a)]
        for how in reversed(back):
            out.append(int(how[out[-1]]))
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 15, rate: float = 0.2, decay: float = 1e-4, seed: int = 2) -> Chain:
        """Gradient ascent on the log-likelihood, page by page; marginals by forward and backward sums."""
        order = np.random.default_rng(seed)
        pages = [(r, np.array(y)) for r, y in pages if r]
        for epoch in range(epochs):
            step = rate / (1 + 0.2 * epoch)
            for n in order.permutation(len(pages)):
                rows, y = pages[n]
                e = np.stack([np.zeros(len(rows)), self.emissions(rows)], axis=1)
                fore, back = np.empty_like(e), np.zeros_like(e)
                fore[0] = e[0]
                for t in range(1, len(e)):
                    fore[t] = e[t] + np.logaddexp(fore[t - 1, 0] + self.steps[0], fore[t - 1, 1] + self.steps[1])
                for t in range(len(e) - 2, -1, -1):
                    ahead = back[t + 1] + e[t + 1]
                    back[t] = np.logaddexp(self.steps[:, 0] + ahead[0], self.steps[:, 1] + ahead[1])
                z = np.logaddexp(*fore[-1])
                gap = y - np.exp(fore[:, 1] + back[:, 1] - z)
                for row, g in zip(rows, gap.tolist()):
                    if abs(g) > 1e-4:
                        for f in row:
                            self.weights[f] = self.weights.get(f, 0.0) * (1 - step * decay) + step * g
                self.first += step * float(gap[0])
                if len(e) > 1:
                    pair = np.exp(fore[:-1, :, None] + self.steps + (e + back)[1:, None, :] - z).sum(axis=0)
                    seen = np.zeros((2, 2))
                    np.add.at(seen, (y[:-1], y[1:]), 1)
                    self.steps = self.steps + step * (seen - pair) / len(e)
        return self
