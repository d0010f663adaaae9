"""Weighted edit distances of columns of pairs: one dynamic programme for all pairs of the same two lengths.

Letters become numbers; those without a key of their own share one cost, so tables stay as small as the keyboard.  A cell
holds the cost and how many errors and restorations it takes; of two ways the cheaper counts, then the one with fewer
errors, then with fewer restorations.  The programme runs over the cells of a pair of lengths, each for all pairs at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lexmill.config import ACUTE, CONFUSIONS, EDIT_ALPHABET, LANE_CONFUSIONS, key_centers, substitution_cost

_LETTERS = sorted({*key_centers(), *EDIT_ALPHABET, *ACUTE})
_NUMBER = {c: k for k, c in enumerate(_LETTERS)}
_KNOWN = len(_LETTERS)
_COST = np.array([[substitution_cost(a, b) for b in _LETTERS] for a in _LETTERS])
_UNKNOWN = substitution_cost("\0", "\1")
_APOSTROPHES = [_NUMBER[c] for c in "'’"]


def _pairs_table(pairs) -> np.ndarray:
    out = np.zeros((_KNOWN + 1, _KNOWN + 1), bool)
    for a, b in pairs:
        out[_NUMBER[a], _NUMBER[b]] = True
    return out


_IS_ACUTE = _pairs_table((base, accented) for accented, base in ACUTE.items())
_IS_LANE = _pairs_table(LANE_CONFUSIONS)
_IS_FREE = _pairs_table([*((a, b) for a, b in ACUTE.items()), *((b, a) for a, b in ACUTE.items()), *CONFUSIONS])
_TABLE = np.pad(_COST, ((0, 1), (0, 1)), constant_values=_UNKNOWN)
_IS_APOSTROPHE = np.isin(np.arange(_KNOWN + 1), _APOSTROPHES)


class Letters:
    """Strings of one length as a matrix: code points, and numbers of letters (``_KNOWN`` for all without one)."""

    def __init__(self, strings: list[str], length: int):
        self.points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(strings), length)
        values, of = np.unique(self.points, return_inverse=True)
        self.numbers = np.array([_NUMBER.get(chr(v), _KNOWN) for v in values.tolist()], np.int64)[of.reshape(self.points.shape)] if length else np.zeros(self.points.shape, np.int64)


Cell = tuple[np.ndarray, np.ndarray, np.ndarray]


def _plus(cell: Cell, cost, errors, restored) -> Cell:
    return cell[0] + cost, cell[1] + errors, cell[2] + restored


def _less(a: Cell, b: Cell) -> Cell:
    first = (a[0] < b[0]) | (a[0] == b[0]) & ((a[1] < b[1]) | (a[1] == b[1]) & (a[2] <= b[2]))
    return tuple(np.where(first, x, y) for x, y in zip(a, b))


def _programme(a: Letters, b: Letters, substituted: Callable, omitted: Callable, inserted: float, swapped: float) -> Cell:
    """Cost, errors and restorations of each pair of rows; ``substituted(a, b, same)`` and ``omitted(b)`` price a place."""
    n, long_a = a.points.shape
    long_b = b.points.shape[1]
    row: list[Cell] = [(np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64))]
    gaps = [omitted(b.numbers[:, j]) for j in range(long_b)]
    for j in range(long_b):
        row.append(_plus(row[-1], *gaps[j]))
    before: list[Cell] | None = None
    for i in range(long_a):
        new = [_plus(row[0], inserted, 1, 0)]
        for j in range(long_b):
            same = a.points[:, i] == b.points[:, j]
            best = _plus(row[j], *substituted(a.numbers[:, i], b.numbers[:, j], same))
            best = _less(best, _plus(row[j + 1], inserted, 1, 0))
            best = _less(best, _plus(new[-1], *gaps[j]))
            if before is not None and j > 0:
                crossed = (a.points[:, i] == b.points[:, j - 1]) & (a.points[:, i - 1] == b.points[:, j]) & (a.points[:, i] != a.points[:, i - 1])
                if crossed.any():
                    other = _less(best, _plus(before[j - 1], swapped, 1, 0))
                    best = tuple(np.where(crossed, x, y) for x, y in zip(other, best))
            new.append(best)
        before, row = row, new
    return row[-1]


def by_lengths(typed: list[str], words: list[str]):
    """Positions of the pairs, and the pairs as ``Letters``, for each two lengths."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(typed, words)]).reshape(-1, 2)
    kinds, of = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    for (m, n), at in zip(kinds.tolist(), np.split(order, np.cumsum(np.bincount(of.ravel()))[:-1]) if len(order) else []):
        yield at, Letters([typed[k] for k in at], m), Letters([words[k] for k in at], n)


def typing_costs(typed: list[str], words: list[str], inserted: float, omitted: float, swapped: float) -> np.ndarray:
    out = np.zeros(len(typed))
    for at, a, b in by_lengths(typed, words):
        cells = _programme(a, b, lambda x, y, same: (np.where(same, 0.0, _TABLE[x, y]), 0, 0), lambda y: (omitted, 0, 0), inserted, swapped)
        out[at] = cells[0]
    return out


def rewrite_distances(typed: list[str], words: list[str]) -> np.ndarray:
    """Edits without restored letters and apostrophes, which are free."""
    out = np.zeros(len(typed), np.int64)
    for at, a, b in by_lengths(typed, words):
        cells = _programme(a, b, lambda x, y, same: (np.where(same | _IS_FREE[x, y], 0.0, 1.0), 0, 0), lambda y: (np.where(_IS_APOSTROPHE[y], 0.0, 1.0), 0, 0), 1.0, 1.0)
        out[at] = np.rint(cells[0]).astype(np.int64)
    return out


def channel_costs(typed: list[str], words: list[str], p: np.ndarray, inserted: float, omitted: float, swapped: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Typing costs with restorations priced by each pair's ``p``, and the errors and restorations that they take."""
    t, u = np.clip((p - 0.5) / 0.25, 0.0, 1.0), np.clip((1 - p - 0.5) / 0.25, 0.0, 1.0)
    w, v = t * t * (3 - 2 * t), u * u * (3 - 2 * u)
    acute, lane, mark = np.maximum(0.02, 0.35 * (1 - w)), np.maximum(0.02, 1.5 * (1 - 0.5 * w)), np.maximum(0.02, np.minimum(omitted, omitted * (1 - v)))
    out = np.zeros(len(typed)), np.zeros(len(typed), np.int64), np.zeros(len(typed), np.int64)
    for at, a, b in by_lengths(typed, words):
        own = acute[at], lane[at], mark[at]

        def substituted(x, y, same):
            is_acute, is_lane = _IS_ACUTE[x, y] & ~same, _IS_LANE[x, y] & ~same
            cost = np.where(same, 0.0, np.where(is_acute, own[0], np.where(is_lane, own[1], _TABLE[x, y])))
            restored = is_acute | is_lane
            return cost, (~same & ~restored).astype(np.int64), restored.astype(np.int64)

        def gap(y):
            apostrophe = _IS_APOSTROPHE[y]
            return np.where(apostrophe, own[2], omitted), (~apostrophe).astype(np.int64), apostrophe.astype(np.int64)

        for whole, part in zip(out, _programme(a, b, substituted, gap, inserted, swapped)):
            whole[at] = part
    return out
