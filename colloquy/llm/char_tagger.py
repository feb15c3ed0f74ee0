"""A character tagger in numpy: a bidirectional LSTM whose scores go through CRF transitions.

Windows of a batch are the last axis of every array, so each step of the recurrence is a few operations
over contiguous rows. Both directions are one stacked array. Gates hold half their argument, so one ``tanh``
serves the three sigmoids too: ``sigmoid(2 z) = tanh(z) / 2 + 1 / 2``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

__all__ = ["SYMBOLS", "Tagger", "decode_windows", "symbols", "train_tagger"]

#: Characters of ASCII have a symbol each, but capitals and digits share one; then letters beyond ASCII, all else, and the end of a window.
_OTHER_LETTER, _OTHER, END = 128, 129, 130
SYMBOLS = 131
_TABLE = np.arange(0x300, dtype=np.int64)
_TABLE[ord("A") : ord("Z") + 1] = ord("A")
_TABLE[ord("0") : ord("9") + 1] = ord("0")
_TABLE[0x80:0xC0] = _OTHER
_TABLE[0xC0:] = _OTHER_LETTER
_TABLE = _TABLE.astype(np.uint8)


def symbols(text: str) -> np.ndarray:
    """The symbol of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x300, _TABLE[np.minimum(points, 0x2FF)], np.uint8(_OTHER)).astype(np.uint8)


@dataclass
class Tagger:
    """``embed`` (features, symbols), ``gates`` (direction, 4 states, states + features + 1), ``out`` (direction, tags, states), ``bias`` (tags), ``moves`` (from, to)."""

    embed: np.ndarray
    gates: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.gates, self.out, self.bias, self.moves]


def _features(m: Tagger, windows: np.ndarray) -> np.ndarray:
    """Features (step, feature, window) of symbols."""
    return np.ascontiguousarray(m.embed.T[windows].transpose(0, 2, 1))


def _recur(m: Tagger, there: np.ndarray, back: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (step, direction, state, window) of features read forwards and backwards; ``keep``: what training needs."""
    steps, _, n = there.shape
    states, features = m.out.shape[2], len(m.embed)
    x = np.ones((2, states + features + 1, n), np.float32)
    x[:, :states] = 0
    c, z, new = np.zeros((2, states, n), np.float32), np.empty((2, 4 * states, n), np.float32), np.empty((2, states, n), np.float32)
    out, kept = np.empty((steps, 2, states, n), np.float32), []
    for k in range(steps):
        x[0, states:-1], x[1, states:-1] = there[k], back[k]
        np.matmul(m.gates, x, out=z)
        np.tanh(z, out=z)
        if keep:
            kept.append((x.copy(), z.copy(), c.copy()))
        gate, fresh = z[:, : 3 * states], z[:, 3 * states :]
        gate *= 0.5
        gate += 0.5
        c *= gate[:, :states]
        np.multiply(gate[:, states : 2 * states], fresh, out=new)
        c += new
        np.tanh(c, out=new)
        if keep:
            kept[-1] += (new.copy(),)
        new *= gate[:, 2 * states :]
        x[:, :states] = new
        out[k] = new
    return out, kept


def _emissions(m: Tagger, there: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Scores (step, tag, window); those beyond a window's length mean nothing."""
    steps, n = there.shape
    at = length - 1 - np.arange(steps)[:, None]
    whole = bool((length == steps).all())
    seen = _features(m, there)
    states, _ = _recur(m, seen, seen[::-1] if whole else _features(m, np.take_along_axis(there, np.maximum(at, 0), 0)))
    scores = np.matmul(m.out[0], states[:, 0]) + m.bias[:, None]
    other = np.matmul(m.out[1], states[:, 1])
    return scores + (other[::-1] if whole else np.take_along_axis(other, np.maximum(at, 0)[:, None, :].repeat(len(m.bias), 1), 0))


def _paths(m: Tagger, scores: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose best path isn't all tag 0, and their best paths (step, window)."""
    steps, tags, n = scores.shape
    best = np.empty_like(scores)
    best[0] = scores[0]
    plain = np.empty((steps, n), np.float32)
    plain[0] = scores[0, 0]
    for k in range(1, steps):
        best[k] = (best[k - 1][:, None, :] + m.moves[:, :, None]).max(0) + scores[k]
        plain[k] = (plain[k - 1] + m.moves[0, 0]) + scores[k, 0]
    at = np.arange(n)
    some = np.flatnonzero(best[length - 1, :, at].max(1) > plain[length - 1, at])
    best, length = best[:, :, some], length[some]
    path = np.zeros((steps, len(some)), np.int64)
    tag = np.zeros(len(some), np.int64)
    for k in range(steps - 1, -1, -1):
        onward = best[k] + np.where(k == length - 1, np.float32(0), m.moves[:, tag])
        tag = np.where(k < length, onward.argmax(0), 0)
        path[k] = tag
    return some, path


def decode_windows(m: Tagger, text: np.ndarray, start: np.ndarray, length: np.ndarray, batch: int = 1024) -> list[tuple[int, int, int, int, float]]:
    """Runs of one tag above 0 in the best path of each window: window, start and end in it, tag, score.

    ``text`` holds symbols; windows are taken by falling length, so a batch has windows of like length. The
    score is how much more the run's tag is worth than tag 0, summed over its characters.
    """
    out = []
    order = np.argsort(-length, kind="stable")
    for a in range(0, len(order), batch):
        some = order[a : a + batch]
        n, first = length[some], start[some]
        place = np.arange(n[0])[:, None]
        there = np.where(place < n, text[np.minimum(first + place, len(text) - 1)], np.uint8(END))
        scores = _emissions(m, there, n)
        hit, path = _paths(m, scores, n)
        if not len(hit):
            continue
        edge = np.diff(path, axis=0, prepend=0, append=0) != 0
        for j, w in enumerate(hit):
            cuts = np.flatnonzero(edge[:, j])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if tag := int(path[s, j]):
                    gain = float((scores[s:e, tag, w] - scores[s:e, 0, w]).sum(dtype=np.float64))
                    out.append((int(some[w]), int(s), int(e), tag, gain))
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def _crf_loss(moves: np.ndarray, scores: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of ``tags`` (step, window) and its gradients by scores and moves."""
    steps, k, n = scores.shape
    fore, back = np.empty_like(scores), np.zeros_like(scores)
    fore[0] = scores[0]
    for t in range(1, steps):
        fore[t] = _log_sum(fore[t - 1][:, None] + moves[:, :, None], 0) + scores[t]
    for t in range(steps - 2, -1, -1):
        back[t] = _log_sum(moves[:, :, None] + (scores[t + 1] + back[t + 1])[None], 1)
    total = _log_sum(fore[-1], 0)
    by_score = np.exp(fore + back - total)
    at = np.arange(n)
    gold = np.take_along_axis(scores, tags[:, None], 1)[:, 0].sum(0) + moves[tags[:-1], tags[1:]].sum(0)
    by_move = np.zeros_like(moves)
    for t in range(1, steps):
        by_move += np.exp(fore[t - 1][:, None] + moves[:, :, None] + (scores[t] + back[t])[None] - total).sum(2)
    np.subtract.at(by_move, (tags[:-1], tags[1:]), 1)
    for t in range(steps):
        by_score[t, tags[t], at] -= 1
    return float((total - gold).mean()), by_score / n, by_move / n


def gradients(m: Tagger, windows: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The loss of one batch of whole windows (step, window) and its gradients, in the order of :meth:`Tagger.parts`."""
    steps, n = windows.shape
    states, features = m.out.shape[2], len(m.embed)
    seen = _features(m, windows)
    out, kept = _recur(m, seen, seen[::-1], keep=True)
    both = np.stack([out[:, 0], out[::-1, 1]], 1)
    scores = np.matmul(m.out[0], both[:, 0]) + np.matmul(m.out[1], both[:, 1]) + m.bias[:, None]
    loss, by_score, by_move = _crf_loss(m.moves, scores, tags)
    by_score = by_score.astype(np.float32)
    by_out = np.einsum("tkn,tdsn->dks", by_score, both, optimize=True)
    by_state = np.stack([np.matmul(m.out[0].T, by_score), np.matmul(m.out[1].T, by_score)[::-1]], 1)
    by_gates, by_embed = np.zeros_like(m.gates), np.zeros_like(m.embed)
    dh, dc = np.zeros((2, states, n), np.float32), np.zeros((2, states, n), np.float32)
    for t in range(steps - 1, -1, -1):
        x, z, before, now = kept[t]
        gate = z[:, : 3 * states] * 0.5 + 0.5
        forget, put, show, fresh = gate[:, :states], gate[:, states : 2 * states], gate[:, 2 * states :], z[:, 3 * states :]
        dh = dh + by_state[t]
        dc = dc + dh * show * (1 - now * now)
        dz = np.concatenate([dc * before * 0.5, dc * fresh * 0.5, dh * now * 0.5, dc * put], 1) * (1 - z * z)
        by_gates += np.matmul(dz, x.transpose(0, 2, 1))
        dx = np.matmul(m.gates.transpose(0, 2, 1), dz)
        for d, shown in enumerate((windows[t], windows[steps - 1 - t])):
            np.add.at(by_embed.T, shown, dx[d, states:-1].T)
        dh, dc = dx[:, :states], dc * forget
    return loss, [by_embed, by_gates, by_out, by_score.sum((0, 2)), by_move]


def train_tagger(windows: np.ndarray, tags: np.ndarray, n_tags: int, *, states: int = 8, features: int = 8, rounds: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Fits by Adam on ``windows`` of symbols (window, step) with ``tags``; the same input gives the same tagger."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    gates = normal(2, 4 * states, states + features + 1, scale=0.25)
    gates[:, :states, -1] += 0.5
    m = Tagger(normal(features, SYMBOLS, scale=0.5), gates, normal(2, n_tags, states, scale=0.3), np.zeros(n_tags, np.float32), np.zeros((n_tags, n_tags), np.float32))
    mean, square = [np.zeros_like(p) for p in m.parts()], [np.zeros_like(p) for p in m.parts()]
    order = np.zeros(0, np.int64)
    for k in range(1, rounds + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(windows))])
        some, order = order[:batch], order[batch:]
        _, slopes = gradients(m, windows[some].T, tags[some].T)
        size = float(np.sqrt(sum(float((g * g).sum()) for g in slopes)))
        pace = rate * min(1.0, k / 20) * (0.5 + 0.5 * np.cos(np.pi * k / rounds)) + 1e-4
        for p, g, a, b in zip(m.parts(), slopes, mean, square, strict=True):
            g = g * min(1.0, 2.0 / max(size, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (pace * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return m
