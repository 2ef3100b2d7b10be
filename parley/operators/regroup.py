"""Grouping of a session's held segments: seeded k-means, spectral labels and smoothing of a label sequence.

These run inside a session's fold on at most cap x held segments.
"""

from __future__ import annotations

import numpy as np


def kmeans_pp(x: np.ndarray, k: int, seed: int = 42, rounds: int = 20) -> np.ndarray:
    """Labels of the rows by k-means++; a cluster that loses its rows keeps its centre."""
    draw = np.random.RandomState(seed)
    centres = x[[draw.randint(len(x))]]
    while len(centres) < k:
        gap = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        p = gap / gap.sum() if gap.sum() > 1e-10 else np.full(len(x), 1 / len(x))
        centres = np.vstack([centres, x[draw.choice(len(x), p=p)]])
    return settle(x, centres, rounds)[0]


def settle(x: np.ndarray, centres: np.ndarray, rounds: int, spherical: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) after rounds of k-means until no row moves; spherical: by direction, centres of unit length.

    A centre without rows, or whose rows cancel out, stays.
    """
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        near = (x @ centres.T - (0.0 if spherical else (centres**2).sum(axis=1) / 2)).argmax(axis=1)
        if (near == labels).all():
            break
        labels, member = near, np.eye(len(centres))[near]
        sums = member.T @ x
        size = np.linalg.norm(sums, axis=1) if spherical else member.sum(axis=0)
        held = size > 1e-10
        centres = np.where(held[:, None], sums / np.where(held, size, 1.0)[:, None], centres)
    return labels, centres


def viterbi(seen: np.ndarray, k: int, stay: float = 0.99, hit: float = 0.9) -> np.ndarray:
    """E8 on one sequence of labels 0..k-1."""
    n = len(seen)
    if n < 2 or k < 2:
        return seen
    same = np.eye(k, dtype=bool)
    move, emit = np.log(np.where(same, stay, (1 - stay) / (k - 1))), np.log(np.where(same, hit, 1 - hit))[seen]
    back, score = np.zeros((n, k), dtype=np.int16), emit[0] - np.log(k)
    for i in range(1, n):
        ways = score[:, None] + move
        back[i], score = ways.argmax(axis=0), ways.max(axis=0) + emit[i]
    path = np.empty(n, dtype=int)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def spectral_labels(x: np.ndarray, speakers: int, cap: int = 8) -> np.ndarray | None:
    """Cluster labels if the eigengap shows clearly fewer clusters than ``speakers``, else None."""
    most = min(cap, speakers, len(x) // 2)
    if most < 2:
        return None
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
    near = np.maximum(unit @ unit.T, 0.0)
    np.fill_diagonal(near, 0.0)
    degree = near.sum(axis=1)
    scale = np.divide(1.0, np.sqrt(degree), out=np.zeros_like(degree), where=degree > 1e-10)
    values, vectors = np.linalg.eigh(np.eye(len(x)) - scale[:, None] * near * scale)
    later = np.diff(values[: most + 1])[1:]
    if not len(later):
        return None
    k = int(later.argmax()) + 2
    noise = 5 * np.median(later) if len(later) > 1 else 0.0
    if later.max() < max(noise, 0.01) or k >= speakers:
        return None
    rows = vectors[:, :k]
    return viterbi(kmeans_pp(rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-10), k), k)
