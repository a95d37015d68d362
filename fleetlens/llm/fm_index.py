"""A compressed FM-index over integer symbols, searched for many patterns at once."""

import numpy as np


class WaveletMatrix:
    """Bit planes of a sequence, each with popcounts of its 64-bit blocks."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.planes, self.ranks, self.zeros = [], [], []
        for level in range(self.levels):
            bits = ((values >> (self.levels - 1 - level)) & 1).astype(np.uint8)
            blocks = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            blocks[: len(bits)] = bits
            plane = np.packbits(blocks, bitorder="little").view(np.uint64)
            ranks = np.zeros(len(plane) + 1, np.int64)
            np.cumsum(np.bitwise_count(plane), out=ranks[1:])
            self.planes.append(plane)
            self.ranks.append(ranks)
            self.zeros.append(len(bits) - int(ranks[-1]))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` comes to lie after following the bits of ``symbol`` through all planes."""
        for level in range(self.levels):
            block, offset = at >> 6, (at & 63).astype(np.uint64)
            below = self.planes[level][block] & ((np.uint64(1) << offset) - np.uint64(1))
            ones = self.ranks[level][block] + np.bitwise_count(below)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index of segments over symbols 1..n_symbols-1; 0 follows each segment.

    Suffixes are sorted by their first 16 symbols. Backward search only ever asks for patterns of at most
    ``width`` + 1 <= 16 symbols, for which that order gives exact intervals. Rows that agree in the first
    ``width`` symbols form a class, so an interval of a longer match is cut back to ``width``.
    """

    def __init__(self, symbols: np.ndarray, n_symbols: int, width: int):
        if not 8 <= width <= 15:
            raise ValueError("width must be from 8 to 15")
        size = len(symbols)
        rank, eight = symbols.astype(np.int64), None
        for shift in (1, 2, 4, 8):
            ahead = np.zeros(size, np.int64)
            ahead[: size - shift] = rank[shift:] + 1 if shift < size else 0
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(size, np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
            if shift == 4:
                eight = rank
        self.rows = order
        last = np.full(size, -1, np.int64)  # the eight symbols that end a prefix of ``width``
        last[: max(size - (width - 8), 0)] = eight[width - 8 :]
        a, b = eight[order], last[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.class_of = np.cumsum(new) - 1
        self.class_start = np.append(np.flatnonzero(new), size)
        counts = np.bincount(symbols, minlength=n_symbols)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.bwt = WaveletMatrix(symbols[order - 1], n_symbols)
        every = np.arange(n_symbols)
        self.shift = starts - self.bwt.descend(every, np.zeros(n_symbols, np.int64))
        self.size, self.width = size, width

    def class_least(self, values: np.ndarray) -> np.ndarray:
        """Least of ``values`` (one per text position) over the occurrences of each class."""
        return np.minimum.reduceat(values[self.rows], self.class_start[:-1])

    def match(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed segments, capped at ``width``, for every position, and the class of
        the positions where they reach it (else -1). All segments are extended to the left in step."""
        length = np.zeros(len(symbols), np.int64)
        found = np.full(len(symbols), -1, np.int64)
        order = np.argsort(begin - end, kind="stable")  # longest first
        begin, end = begin[order], end[order]
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), self.size, np.int64)
        run = np.zeros(len(begin), np.int64)
        sizes = end - begin
        for step in range(int(sizes.max(initial=0))):
            active = int(np.searchsorted(-sizes, -step, side="left"))
            low, high, run = low[:active], high[:active], run[:active]
            at = end[:active] - 1 - step
            low, high, run = self._extend(symbols, at, low, high, run)
            length[at] = run
            whole = run == self.width
            classes = self.class_of[low[whole]]
            found[at[whole]] = classes
            low[whole], high[whole] = self.class_start[classes], self.class_start[classes + 1]
        return length, found

    def _extend(self, symbols, at, low, high, run):
        """One symbol to the left. Where that has no occurrence, the match restarts with fewer symbols on
        its right until it has one."""
        symbol = symbols[at]
        new_low = self.shift[symbol] + self.bwt.descend(symbol, low)
        new_high = self.shift[symbol] + self.bwt.descend(symbol, high)
        new_run = np.minimum(run + 1, self.width)
        lost = np.flatnonzero(new_low >= new_high)
        keep = run[lost]
        while len(lost):
            keep = keep - 1
            lows, highs = np.zeros(len(lost), np.int64), np.full(len(lost), self.size, np.int64)
            alive = keep >= 0
            for k in range(int(keep.max(initial=-1)), -1, -1):
                use = alive & (k <= keep)
                s = symbols[at[lost[use]] + k]
                lows[use] = self.shift[s] + self.bwt.descend(s, lows[use])
                highs[use] = self.shift[s] + self.bwt.descend(s, highs[use])
            done = (lows < highs) | ~alive
            new_low[lost[done]] = np.where(alive[done], lows[done], 0)
            new_high[lost[done]] = np.where(alive[done], highs[done], self.size)
            new_run[lost[done]] = np.where(alive[done], keep[done] + 1, 0)
            lost, keep = lost[~done], keep[~done]
        return new_low, new_high, new_run
