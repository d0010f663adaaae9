"""A compressed full-text index: suffix array, Burrows-Wheeler transform and wavelet matrix, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and for each suffix in that order whether its first ``depth`` symbols
    differ from those of the suffix before it.

    The first sort takes as many symbols as fit into 64 bits; later ones only take suffixes that still tie."""
    n = len(text)
    bits, width = (int(text.max(initial=0)) + 1).bit_length(), 1
    while 2 * width * bits <= 64:
        width *= 2
    symbols = np.concatenate([text + 1, np.zeros(max(width, depth), np.int64)]).astype(np.uint64)  # 0 beyond the end
    key, have = symbols, 1
    while have < width:
        key = key[:-have] << np.uint64(bits * have) | key[have:]
        have *= 2
    start = depth % width  # how far ``depth`` is already compared
    differs = [symbols[j : j + n] for j in range(start)]
    key = key[:n]
    order = np.argsort(key)
    rank, ties = np.empty(n, np.int64), np.arange(n)  # a suffix ranks by the place of the first one that equals it so far
    key, suffixes = key[order], order
    while True:
        new = np.ones(len(ties), bool)
        new[1:] = key[1:] != key[:-1]
        rank[suffixes] = ties[np.maximum.accumulate(np.where(new, np.arange(len(ties)), 0))]
        ties = ties[~(new & np.append(new[1:], True))]
        if depth & width:  # prefixes of ``depth`` are compared in runs of powers of two
            differs.append(np.concatenate([rank[start:], np.full(min(start, n), -1)]))
            start += width
        if 2 * width > depth and not len(ties):
            break
        suffixes = order[ties]
        after = suffixes + width
        after = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffixes] * (n + 1) + after
        at = np.argsort(key)
        key, suffixes = key[at], suffixes[at]
        order[ties] = suffixes
        width *= 2
    new = np.zeros(n, bool)
    new[:1] = True
    for part in differs:
        of = part[order]
        new[1:] |= of[1:] != of[:-1]
    return order, new


class WaveletMatrix:
    """Rank of any symbol in a sequence, in packed bits with a count for each 64."""

    def __init__(self, symbols: np.ndarray):
        largest = int(symbols.max(initial=0))
        self.n, self.levels = len(symbols), max(1, largest.bit_length())
        self.words, self.counts, self.zeros = [], [], []
        first, every = np.zeros(largest + 1, np.int64), np.arange(largest + 1)
        for level in range(self.levels - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([one, np.zeros(64 - self.n % 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(self.n - np.count_nonzero(one)))
            first = self._down(self.levels - 1 - level, (every >> level & 1).astype(bool), first)
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self.first = first  # where each symbol's occurrences begin below the last level

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        at, both = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for k in range(self.levels):
            at = self._down(k, (both >> (self.levels - 1 - k) & 1).astype(bool), at)
        at -= self.first[both]
        return at[: len(low)], at[len(low) :]

    def _down(self, k: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of level ``k`` in the level below it, on the side of ``bit``."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).view(np.uint64)) - np.uint64(1)
        ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & mask)
        return np.where(bit, self.zeros[k] + ones, at - ones)


class FMIndex:
    """Backward search over a text of small integers; ``depth`` is the length at which matches count."""

    def __init__(self, text: np.ndarray, depth: int):
        self.order, new = suffix_order(text, depth)
        self.group = np.cumsum(new) - 1  # suffixes that agree in their first ``depth`` symbols
        self.last = text[self.order - 1]
        self.tree = WaveletMatrix(self.last)
        place = np.empty(len(text), np.int64)
        place[self.order] = np.arange(len(text))
        self.back = place[self.order - 1]  # the row of the suffix that begins one symbol earlier
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put in front; empty ones for symbols that the text lacks."""
        low, high = low.copy(), high.copy()
        single = high - low == 1
        one = np.flatnonzero(single)
        row = low[one]  # a single row goes on with the symbol before it or not at all
        same = self.last[row] == symbol[one]
        low[one], high[one] = np.where(same, self.back[row], 0), np.where(same, self.back[row] + 1, 0)
        many = np.flatnonzero(~single)
        of = symbol[many]
        known = (of >= 0) & (of < len(self.before) - 1)
        of = np.where(known, of, 0)
        a, b = self.tree.rank(of, low[many], high[many])
        low[many], high[many] = np.where(known, self.before[of] + a, 0), np.where(known, self.before[of] + b, 0)
        return low, high

    def matches(self, patterns: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all patterns (concatenated) at once: pattern, position and group of every position from which at
        least ``depth`` symbols match.  One backward pass gives the interval of the whole rest of a pattern at
        each position, which lies within one group; a pattern that is not in the text as a whole is searched
        window by window instead."""
        ends = np.cumsum(lengths)
        by_length = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[by_length]
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.order), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(int(sorted_lengths[0]) if len(lengths) else 0):
            live = by_length[: int(np.searchsorted(-sorted_lengths, -step, side="left"))]
            live = live[low[live] < high[live]]
            low[live], high[live] = self.extend(patterns[ends[live] - 1 - step], low[live], high[live])
            if step >= depth - 1:
                live = live[low[live] < high[live]]
                out.append((live, lengths[live] - 1 - step, self.group[low[live]]))
        failed = np.flatnonzero((low >= high) & (lengths >= depth))
        if len(failed):
            out = [tuple(x[~np.isin(o[0], failed)] for x in o) for o in out]
            count = lengths[failed] - depth + 1
            which, at = np.repeat(failed, count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            begin = ends[which] - lengths[which] + at
            low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.order), np.int64)
            for step in range(depth - 1, -1, -1):
                live = np.flatnonzero(low < high)
                low[live], high[live] = self.extend(patterns[begin[live] + step], low[live], high[live])
            live = np.flatnonzero(low < high)
            out.append((which[live], at[live], self.group[low[live]]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))
