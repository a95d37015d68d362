"""Words of Arrow text batches as numpy arrays, without a Python object per word."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Fixed 64-bit code of every byte value, and the multiplier of the rolling hash and its inverse.
_CODE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes that are worked on at once.
SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_tables: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    got = _tables.get(name)
    if got is None or len(got) < n:
        got = _tables[name] = _powers(base, max(n, SLICE + 1))
    return got


@dataclass
class Words:
    """Words of some documents in order: byte range in ``data``, document, 64-bit hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document its first word, with the number of words at the end

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def place(self) -> np.ndarray:
        """Position of every word in its document."""
        return np.arange(len(self.doc)) - self.first[self.doc]


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    hi = int(offsets[-1]) if len(offsets) else 0
    return whole[lo:hi], offsets - lo


def words_of(column, lower: bool = False) -> Words:
    """Maximal runs of bytes other than space, tab, newline, VT, FF, CR in every text.

    These six are single bytes in UTF-8, so runs of bytes are runs of characters. ``lower`` puts
    A-Z in lower case before hashing. Hashes are polynomial over coded bytes, taken from prefix
    sums modulo 2**64 and then scrambled.
    """
    data, offsets = texts_of(column)
    n = len(data)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    if n:
        edge[0] = word[0]
        edge[1:n] = word[1:] & ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    edge[inner] |= word[inner] if n else False
    start = np.flatnonzero(edge[:n])
    stop = np.zeros(n + 1, bool)
    if n:
        stop[1:n] = word[:-1] & ~word[1:]
        stop[n] = word[-1]
    inner = offsets[1:-1]
    inner = inner[inner > 0]
    stop[inner] |= word[inner - 1] if n else False
    end = np.flatnonzero(stop)
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets[:-1])
    first = np.append(first, len(start)).astype(np.int64)
    return Words(data, start, end, doc, _hashes(data, start, end, lower), first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    code = _CODE
    if lower:
        code = _CODE.copy()
        code[65:91] = _CODE[97:123]
    out = np.empty(len(start), np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    at = 0
    while at < len(start):
        lo = int(start[at])
        upto = max(at + 1, int(np.searchsorted(end, lo + SLICE, side="right")))
        hi = int(end[upto - 1])
        power = _table("up", _BASE, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(code[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = start[at:upto] - lo, end[at:upto] - lo
        out[at:upto] = (sums[e] - sums[s]) * _table("down", inverse, hi - lo + 1)[s]
        at = upto
    size = (end - start).astype(np.uint64)
    return mixed(out ^ (size * np.uint64(0xD6E8FEB86659FD93)))


def grams(words: Words, n: int, seed: int = 0, inside_only: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words, and the index of its first word; by default of those inside a document."""
    h, total = words.hash, len(words.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.full(total - n + 1, seed * 2 + 1, np.uint64)
    for k in range(n):
        value = mixed(value * np.uint64(0x9FB21C651E98DF25) + h[k : total - n + 1 + k])
    if not inside_only:
        return value, np.arange(len(value))
    inside = words.doc[: total - n + 1] == words.doc[n - 1 :]
    at = np.flatnonzero(inside)
    return value[at], at


def range_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words begin..end of each range."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, n + 1)[:n], out=sums[1:])
    out = (sums[end] - sums[begin]) * _powers(pow(_BASE, -1, 1 << 64), n + 1)[begin]
    return mixed(out ^ ((end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def sliced(batch: pa.RecordBatch | pa.Table, column: str, most: int = 8 << 20):
    """Cut a batch into pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)
