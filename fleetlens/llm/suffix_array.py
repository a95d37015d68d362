"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

import numpy as np

#: Symbols that the first sort looks at; symbols are below 512, so seven fit a 63-bit key.
FIRST = 7


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes (fewer than 2^31) in order; the end of the array sorts before every symbol."""
    return _sorted(symbols, None)[0]


def prefix_groups(symbols: np.ndarray, depth: int) -> np.ndarray:
    """A number per position, equal where the next ``depth`` symbols (the end counts as one) are equal.

    The suffixes are sorted no further than that, so none is compared with the ones it shares more with.
    """
    return _sorted(symbols, depth)[1]


def _sorted(symbols: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``limit`` symbols, or of all, and the group of each position.

    Suffixes are grouped by their first symbols. Each round refines the groups that hold more than one
    suffix by the groups of the suffixes that lie the known depth and twice that further on, if three numbers
    fit one key, so the depth grows threefold, else by the first of them. The last round before a limit looks
    less far on, so that the depth becomes the limit.
    """
    n = len(symbols)
    depth = FIRST if limit is None else min(FIRST, limit)
    padded = np.zeros(n + FIRST, np.uint16)
    padded[:n] = symbols + np.uint16(1)
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key <<= np.uint64(9)
        key |= padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    # The group of a suffix is the first place of its group, counted from 1; 0 is beyond the end.
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    del key
    group = np.zeros(n + (2 * n if limit is None else limit) + 1, np.int32)
    group[order] = np.repeat(starts.astype(np.int32), sizes) + 1
    places = np.flatnonzero(np.repeat(sizes > 1, sizes))
    some = order[places]
    ways, bits = (3, 21) if n < 1 << 21 else (2, 32)
    while len(places) and depth != limit:
        deeper = ways * depth if limit is None else min(ways * depth, limit)
        key = group[some].astype(np.int64)
        for k in range(1, ways):
            key <<= bits
            key |= group[some + min(k * depth, deeper - depth)]
        refined = np.argsort(key)
        some, key = some[refined], key[refined]
        order[places] = some
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        group[some] = np.repeat(places[starts].astype(np.int32), sizes) + 1
        depth = deeper
        if depth != limit:
            more = np.repeat(sizes > 1, sizes)
            places, some = places[more], some[more]
    return order.astype(np.int32), group[:n]


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in ``order``; 0 for the first.

    Kasai's rule: if a suffix and its neighbour follow the same symbol, they share one symbol less than
    the suffix that starts there and its own neighbour. So only the others are compared, four symbols
    at a time, and the rest count down from them in text order.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 4, np.uint16)
    padded[:n] = symbols
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    text_at = np.arange(n, dtype=np.int32)
    follows = (text_at > 0) & (before > 0)
    follows[follows] = padded[text_at[follows] - 1] == padded[before[follows] - 1]
    compared = np.flatnonzero(~follows & (before >= 0))
    four = np.ndarray((n + 1,), np.uint64, padded.tobytes(), strides=(2,))
    shared = np.zeros(n, np.int32)
    left, right, depth = compared, before[compared].astype(np.int64), 0
    while len(left):
        x = four[np.minimum(left + depth, n)] ^ four[np.minimum(right + depth, n)]
        same = x == 0
        parts = x[~same]
        equal = np.zeros(len(parts), np.int64)
        for k in range(1, 4):
            equal += (parts & np.uint64((1 << 16 * k) - 1)) == 0
        shared[left[~same]] = depth + equal
        on = same & (np.maximum(left, right) + depth + 4 < n)
        at_end = same & ~on
        shared[left[at_end]] = depth + 4
        left, right = left[on], right[on]
        depth += 4
    room = n - np.maximum(text_at, before)
    shared[compared] = np.minimum(shared[compared], room[compared])
    # The rest count down from the last compared suffix before them in the text.
    known = np.maximum.accumulate(np.where(follows, 0, text_at))
    shared = np.maximum(shared[known] - (text_at - known), 0)
    shared[before < 0] = 0
    return shared[order]
