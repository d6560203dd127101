"""A linear-chain conditional random field over sequences of tokens, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np

#: Offsets of the tokens whose features bear on a label.
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
#: One block of weights per offset, and one for the token's mark: what it is part of or stands in.
BLOCKS = len(OFFSETS) + 1


class TokenScores:
    """Label scores of every token seen so far, one block per offset; a new token is scored on sight.

    Each token has two rows: apart from the token before it, and glued to it (marked by ``glue``).
    """

    def __init__(
        self,
        weights: np.ndarray,
        index: dict[str, int],
        features: Callable[[str], Iterable[str]],
        normal_form: Callable[[str], str],
        glue: str,
        limit: int = 300_000,
    ) -> None:
        self.weights = weights  # (features, offsets, labels)
        self.index, self.features, self.normal_form, self.glue, self.limit = index, features, normal_form, glue, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.forms: dict[str, int] = {}
        self.table = np.zeros((2048, *self.weights.shape[1:]), np.float32)

    def _score(self, token: str) -> int:
        form = self.normal_form(token)
        at = self.forms.get(form)
        if at is None:
            at = self.forms[form] = 2 * len(self.forms)
            if at + 1 >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for row, name in ((at, form), (at + 1, self.glue + form)):
                have = [self.index[f] for f in self.features(name) if f in self.index]
                self.table[row] = self.weights[have].sum(0)
        self.known[token] = at
        return at

    def ids(self, tokens: Sequence[str]) -> np.ndarray:
        """Row of each token standing apart; the next row is the one glued to its predecessor."""
        if len(self.known) > self.limit:
            self.clear()
        known, score = self.known, self._score
        return np.fromiter((known[t] if t in known else score(t) for t in tokens), np.int64, len(tokens))


def emissions(table: np.ndarray, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Label scores (tokens, labels) of concatenated sequences; ``begins`` and ``ends`` give each token's sequence.

    ``marks`` are the rows of the tokens' marks.
    """
    n = len(ids)
    place = np.arange(n)
    out = np.zeros((n, table.shape[2]), np.float32)
    for k, offset in enumerate(OFFSETS):
        at = place + offset
        inside = (at >= begins) & (at < ends)
        out[inside] += table[ids[at[inside]], k]
    out += table[marks, len(OFFSETS)]
    return out


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray, cells: int = 400_000) -> np.ndarray:
    """The best labels of every token; sequences are decoded side by side, longest first."""
    labels = np.zeros(len(scores), np.int8)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    step = transitions.T[None]  # (1, to, from)
    lo = 0
    while lo < len(order):
        longest = int(lengths[order[lo]])
        rows = order[lo : lo + max(1, cells // longest)]
        lo += len(rows)
        size = lengths[rows]
        width = np.searchsorted(-size, -np.arange(longest), side="left")  # rows longer than t
        best = scores[starts[rows]] + first
        back = []
        final = best.copy()
        for t in range(1, longest):
            live = int(width[t])
            options = best[:live, None, :] + step
            origin = options.argmax(2)
            best = np.take_along_axis(options, origin[:, :, None], 2)[:, :, 0] + scores[starts[rows[:live]] + t]
            back.append(origin.astype(np.int8))
            final[:live] = best
        now = final.argmax(1)
        for t in range(longest - 1, -1, -1):
            live = int(width[t])
            labels[starts[rows[:live]] + t] = now[:live]
            if t:
                now[:live] = back[t - 1][np.arange(live), now[:live]]
        del back
    return labels


class _Fold:
    """A share of the training sentences, longest first, with everything a step needs to know of it."""

    def __init__(
        self,
        sequences: list[Sequence[str]],
        marks: list[Sequence[str]],
        labels: list[Sequence[int]],
        k: int,
        features: Callable[[str], Iterable[str]],
        index: dict[str, int],
    ) -> None:
        vocabulary: dict[str, int] = {}
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        self.length = np.array([len(sequences[i]) for i in order])
        self.flat = np.array([vocabulary.setdefault(t, len(vocabulary)) for i in order for t in sequences[i]])
        self.marks = np.array([vocabulary.setdefault(m, len(vocabulary)) for i in order for m in marks[i]])
        self.gold = np.array([y for i in order for y in labels[i]])
        self.size, self.n, self.k = len(vocabulary), len(order), k
        pairs = np.array([(index[f], v) for v, t in enumerate(vocabulary) for f in dict.fromkeys(features(t)) if f in index])
        self.pair_f, self.edge_v = pairs[:, 0], np.flatnonzero(np.r_[True, np.diff(pairs[:, 1]) > 0])
        self.which_v = pairs[self.edge_v, 1]
        by_f = np.argsort(self.pair_f, kind="stable")
        self.pair_v = pairs[by_f, 1]
        self.edge_f = np.flatnonzero(np.r_[True, np.diff(self.pair_f[by_f]) > 0])
        self.which_f = self.pair_f[by_f][self.edge_f]
        self.starts = np.r_[0, np.cumsum(self.length)[:-1]]
        self.begins, self.ends = np.repeat(self.starts, self.length), np.repeat(self.starts + self.length, self.length)
        self.place = np.arange(len(self.flat))
        self.width = [int((self.length > t).sum()) for t in range(int(self.length[0]))]
        self.inner = self.place[1:][self.begins[1:] == self.begins[:-1]]
        self.truth = np.eye(k, dtype=np.float32)[self.gold]
        self.pairs = np.zeros((k, k), np.float32)
        np.add.at(self.pairs, (self.gold[self.inner - 1], self.gold[self.inner]), 1)

    def slopes(self, weights: np.ndarray, transitions: np.ndarray, first: np.ndarray, decay: float) -> list[np.ndarray]:
        """Slopes of the mean negative log-likelihood with weight decay."""
        table = np.zeros((self.size, BLOCKS, self.k), np.float32)
        table[self.which_v] = np.add.reduceat(weights[self.pair_f], self.edge_v, axis=0)
        score = emissions(table, self.flat, self.begins, self.ends, self.marks)
        # Forward and backward chances, scaled to one at every token.
        local = np.exp(score - score.max(1, keepdims=True))
        move = np.exp(transitions)
        alpha, beta, scale = np.empty_like(score), np.ones_like(score), np.empty(len(score), np.float32)
        begin = local[self.starts] * np.exp(first)
        scale[self.starts] = begin.sum(1)
        alpha[self.starts] = begin / scale[self.starts, None]
        for t in range(1, len(self.width)):
            at = self.starts[: self.width[t]] + t
            here = (alpha[at - 1] @ move) * local[at]
            scale[at] = here.sum(1)
            alpha[at] = here / scale[at, None]
        for t in range(len(self.width) - 2, -1, -1):
            at = self.starts[: self.width[t + 1]] + t
            beta[at] = ((beta[at + 1] * local[at + 1]) @ move.T) / scale[at + 1, None]
        chance = alpha * beta
        pairs = move * (alpha[self.inner - 1].T @ (beta[self.inner] * local[self.inner] / scale[self.inner, None]))
        off = chance - self.truth
        by_token = np.zeros_like(table)
        for o, offset in enumerate(OFFSETS):
            at = self.place + offset
            inside = (at >= self.begins) & (at < self.ends)
            tokens = self.flat[at[inside]]
            for label in range(self.k):
                by_token[:, o, label] = np.bincount(tokens, off[inside, label], minlength=self.size)
        for label in range(self.k):
            by_token[:, -1, label] = np.bincount(self.marks, off[:, label], minlength=self.size)
        of_features = decay * weights
        of_features[self.which_f] += np.add.reduceat(by_token[self.pair_v], self.edge_f, axis=0) / self.n
        return [of_features, (pairs - self.pairs) / self.n + decay * transitions, off[self.starts].sum(0) / self.n]


def train(
    sequences: Sequence[Sequence[str]],
    marks: Sequence[Sequence[str]],
    labels: Sequence[Sequence[int]],
    n_labels: int,
    features: Callable[[str], Iterable[str]],
    steps: int = 240,
    folds: int = 8,
    rate: float = 0.12,
    decay: float = 2e-4,
    least: int = 3,
) -> tuple[np.ndarray, dict[str, int], np.ndarray, np.ndarray]:
    """(weights, feature index, transitions, first): maximum likelihood by Adam with weight decay.

    ``marks`` tell what each token is part of or stands in. Each step takes the next of ``folds`` shares of the sentences; features seen on fewer than ``least``
    tokens are left out.
    """
    counts: dict[str, int] = {}
    seen: dict[str, int] = {}
    for sequence in (*sequences, *marks):
        for token in sequence:
            seen[token] = seen.get(token, 0) + 1
    for token, n in seen.items():
        for f in dict.fromkeys(features(token)):
            counts[f] = counts.get(f, 0) + n
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    parts = [_Fold(list(sequences[i::folds]), list(marks[i::folds]), list(labels[i::folds]), n_labels, features, index) for i in range(folds)]
    shapes = ((len(index), BLOCKS, n_labels), (n_labels, n_labels), (n_labels,))
    parameters, moment, spread = ([np.zeros(s, np.float32) for s in shapes] for _ in range(3))
    for step in range(1, steps + 1):
        pace = rate * min(1.0, 2.0 * (steps - step + 1) / steps)
        slopes = parts[step % folds].slopes(*parameters, decay)
        for p, g, m, v in zip(parameters, slopes, moment, spread, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return parameters[0], index, parameters[1], parameters[2]
