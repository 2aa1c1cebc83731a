"""Small conditional random fields over tokens with one-hot features, in numpy."""

from __future__ import annotations

import numpy as np


def unary(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Scores (tokens x labels) of feature numbers (tokens x slots)."""
    out = np.zeros((len(features), weights.shape[1]))
    for slot in range(features.shape[1]):
        out += weights[features[:, slot]]
    return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(-1, keepdims=True))
    return scores / scores.sum(-1, keepdims=True)


def _feature_sums(features: np.ndarray, error: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of ``error`` (tokens x labels) for every feature number."""
    flat, slots = features.ravel(), features.shape[1]
    return np.stack(
        [np.bincount(flat, weights=np.repeat(e, slots), minlength=size) for e in error.T], axis=1
    )


def fit_unary(features: np.ndarray, labels: np.ndarray, size: int, n_labels: int,
              steps: int = 200, decay: float = 1e-3, counts: np.ndarray | None = None) -> np.ndarray:
    """Multinomial logistic regression by full-batch Adagrad; ``counts`` says how many
    examples each row stands for."""
    weights = np.zeros((size, n_labels))
    squares = np.full_like(weights, 1e-6)
    target = np.eye(n_labels)[labels]
    counts = np.ones(len(labels)) if counts is None else np.asarray(counts, float)
    total = counts.sum()
    for _ in range(steps if len(labels) else 0):
        error = (_softmax(unary(weights, features)) - target) * (counts / total)[:, None]
        gradient = decay * weights / total + _feature_sums(features, error, size)
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
    return weights


def pair_potential(first: np.ndarray, second: np.ndarray, n_labels: int,
                   counts: np.ndarray | None = None, agree: float = 0.0) -> np.ndarray:
    """log P(l, m) / P(l) P(m) of label pairs, smoothed; zero without pairs. ``counts`` says how
    many pairs each stands for, ``agree`` how many more pairs of equal labels are assumed."""
    seen = np.full((n_labels, n_labels), 0.5) + agree * np.eye(n_labels)
    np.add.at(seen, (first, second), 1.0 if counts is None else np.asarray(counts, float))
    p = seen / seen.sum()
    potential = np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))
    return potential if len(first) or agree else np.zeros_like(potential)


def loopy_marginals(scores: np.ndarray, edges: np.ndarray, potentials: np.ndarray,
                    kinds: np.ndarray, rounds: int = 1000, damping: float = 0.3,
                    settled: float = 1e-6) -> np.ndarray:
    """Label marginals by damped sum-product messages over any pairwise graph.

    ``edges`` (pairs of tokens) of kind k have the log potential ``potentials[k]``. Messages
    go on until none changes by more than ``settled``, or for ``rounds`` rounds where they
    never settle; messages that have settled are not sent again until what they come from
    changes.
    """
    if not len(edges):
        return _softmax(scores)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.exp(np.concatenate([potentials[kinds], potentials[kinds].transpose(0, 2, 1)]))
    half = len(edges)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    messages = np.zeros((2 * half, scores.shape[1]))
    belief, active = scores.copy(), np.arange(2 * half)
    for _ in range(rounds):
        cavity = _softmax(belief[source[active]] - messages[back[active]])
        new = np.log(np.einsum("el,elm->em", cavity, pair[active]) + 1e-30)
        new -= new.max(1, keepdims=True)
        new = damping * messages[active] + (1 - damping) * new
        change = new - messages[active]
        messages[active] = new
        np.add.at(belief, target[active], change)
        moved = active[np.abs(change).max(1) > settled]
        if not len(moved):
            break
        touched = np.zeros(len(scores), bool)
        touched[target[moved]] = True
        again = touched[source]
        again[moved] = True
        active = np.flatnonzero(again)
    return _softmax(belief)


def padded(scores: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of chains (chains x places x labels) and which places are real."""
    lengths = np.diff(starts)
    places = np.arange(lengths.max(initial=0))
    real = places < lengths[:, None]
    out = np.zeros((*real.shape, scores.shape[1]))
    out[real] = scores
    return out, real


def chain_marginals(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray):
    """Token marginals and expected moves of linear chains, by forward-backward.

    Chains go longest first, so that every place works on the chains that reach it; sums are
    brought to one at every place.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    grid, real = padded(scores, starts)
    n, places, labels = grid.shape
    emit = np.exp(grid - grid.max(2, keepdims=True))[order]
    reach = (np.sort(lengths)[::-1][:, None] > np.arange(places)).sum(0)
    step = np.exp(moves - moves.max())
    level = lambda x: x / x.sum(1, keepdims=True)
    ahead, behind = np.ones_like(emit), np.ones_like(emit)
    if places:
        ahead[:, 0] = level(emit[:, 0])
    for t in range(1, places):
        m = reach[t]
        ahead[:m, t] = level((ahead[:m, t - 1] @ step) * emit[:m, t])
    for t in range(places - 2, -1, -1):
        m = reach[t + 1]
        behind[:m, t] = level((emit[:m, t + 1] * behind[:m, t + 1]) @ step.T)
    expected = np.zeros((labels, labels))
    for t in range(1, places):
        m = reach[t]
        before, after = ahead[:m, t - 1], emit[:m, t] * behind[:m, t]
        whole = ((before @ step) * after).sum(1, keepdims=True)
        expected += ((before / whole).T @ after) * step
    found = ahead * behind
    out = np.empty_like(grid)
    out[order] = found / found.sum(2, keepdims=True)
    return out[real], expected


def fit_chain(features: np.ndarray, labels: np.ndarray, starts: np.ndarray, size: int,
              n_labels: int, steps: int = 120, decay: float = 0.05):
    """Weights and moves of a linear-chain field by the gradient of its log-likelihood."""
    weights, moves = np.zeros((size, n_labels)), np.zeros((n_labels, n_labels))
    if not len(labels):
        return weights, moves
    squares, move_squares = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    target = np.eye(n_labels)[labels]
    seen = np.zeros_like(moves)
    inner = np.ones(len(labels), bool)
    inner[starts[:-1]] = False
    np.add.at(seen, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1.0)
    for _ in range(steps):
        marginals, expected = chain_marginals(unary(weights, features), starts, moves)
        gradient = decay * weights + _feature_sums(features, marginals - target, size)
        move_gradient = expected - seen + decay * moves
        squares += gradient**2
        move_squares += move_gradient**2
        weights = weights - 0.5 * gradient / np.sqrt(squares)
        moves = moves - 0.5 * move_gradient / np.sqrt(move_squares)
    return weights, moves


def viterbi(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of every chain; of equal paths the smaller labels."""
    grid, real = padded(scores, starts)
    n, places, labels = grid.shape
    best, came = grid[:, 0].copy() if places else grid[:, :0], []
    for t in range(1, places):
        options = best[:, :, None] + moves
        top = options.argmax(1)
        step = np.take_along_axis(options, top[:, None, :], 1)[:, 0] + grid[:, t]
        on = real[:, t, None]
        came.append(np.where(on, top, np.arange(labels)))
        best = np.where(on, step, best)
    out = np.zeros((n, places), int)
    if places:
        out[:, -1] = best.argmax(1)
        for t in range(places - 2, -1, -1):
            out[:, t] = came[t][np.arange(n), out[:, t + 1]]
    return out[real]
