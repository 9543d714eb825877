"""SetSketch registers over 5-word shingles, their bands, and the likelihood estimate of a similarity.

Every element of a set owns a Poisson process of points, each marked with one of the registers.  A
register keeps the smallest point marked with it over all elements (an exponential minimum), stored
as a truncated level on a scale of ratio ``BASE``.  The registers of a union are the larger of the
two levels, and two sets agree in a register about as often as their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from strandmill.llm.texts import BLANKS, WordHasher, by_bytes, mix, seeds

BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LEVELS = 1.001, 20.0, 65534
SHINGLE = 5
#: Below this estimate the true similarity is under 0.75 by six standard deviations.
LEAST_ESTIMATE = 0.75 - 6 * (0.75 * 0.25 / REGISTERS) ** 0.5


class Shingler:
    """Sorted distinct shingle hashes of each text."""

    def __init__(self):
        self.words = WordHasher(BLANKS)
        self.weights = seeds("shingle", SHINGLE + 1)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        words, counts = self.words.hashes(data, offsets)
        many = np.zeros(max(len(words) - SHINGLE + 1, 0), dtype=np.uint64)
        for i in range(SHINGLE):
            many += words[i: i + len(many)] * self.weights[i]
        many, out, at = mix(many), [], 0
        for n in counts.tolist():
            if n >= SHINGLE:
                out.append(np.unique(many[at: at + n - SHINGLE + 1]))
            elif n:
                whole = (words[at: at + n] * self.weights[:n]).sum(keepdims=True)
                out.append(mix(whole + self.weights[SHINGLE:] * np.uint64(n)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += n
        return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Levels of each set, one row per set; sets must not be empty."""
    minima = np.full((len(sets), REGISTERS), np.inf)
    todo, slack = np.arange(len(sets)), 8.0
    while len(todo):
        _fill(minima, sets, todo, slack)
        todo = todo[np.isinf(minima[todo]).any(axis=1)]
        slack *= 2
    levels = np.floor(1 - np.log(minima / RATE) / np.log(BASE))
    return np.clip(levels, 0, LEVELS + 1).astype(np.uint16)


def _fill(minima: np.ndarray, sets: list[np.ndarray], todo: np.ndarray, slack: float) -> None:
    """Take in all points below a bound that fills every register but with a chance of exp(-slack).

    Points above the bound could only matter to a register left empty, so the bound never shows.
    """
    sizes = np.array([len(sets[i]) for i in todo])
    owner = np.repeat(todo, sizes)
    bound = np.repeat((np.log(REGISTERS) + slack) / sizes, sizes)
    state = np.concatenate([sets[i] for i in todo])
    at, flat = np.zeros(len(state)), minima.reshape(-1)
    while len(state):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        draw = mix(state)
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / REGISTERS
        near = at < bound
        state, at, owner, bound, draw = state[near], at[near], owner[near], bound[near], draw[near]
        np.minimum.at(flat, owner * REGISTERS + (((draw & np.uint64(0xFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(20)).astype(np.int64), at)


def bands(levels: np.ndarray) -> np.ndarray:
    """One 64-bit value per set and band of registers."""
    grouped = levels.astype(np.uint64).reshape(len(levels), BANDS, ROWS)
    keys = (grouped * seeds("band", ROWS)).sum(axis=2, dtype=np.uint64) + seeds("bandno", BANDS)
    return mix(keys).view(np.int64)


def joint_estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs, given levels and set sizes, on a grid of 1/128.

    With shares u and v of the two sizes, a register is larger on the left with the chance
    p(u - v J) and on the right with p(v - u J), p(x) = -log_b(1 - x (b - 1) / b).
    """
    more = (left > right).sum(axis=1)[:, None]
    less = (left < right).sum(axis=1)[:, None]
    same = left.shape[1] - more - less
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    fit = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(grid, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 |A and B| >= 75 |A or B| for sorted distinct hashes."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short) or 100 * len(short) < 75 * len(long):
        return False
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    common = int((long[at] == short).sum())
    return 100 * common >= 75 * (len(a) + len(b) - common)


__all__ = ["Shingler", "bands", "by_bytes", "joint_estimate", "linked", "registers"]
