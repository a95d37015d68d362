"""Removal of repeated byte strings with suffix arrays per shard.

A window is a fixed number of consecutive bytes of one text. A byte is removed if a window that covers
it also starts anywhere else, in the same text or another.

Texts are cut into segments: runs of windows with the same anchor, the least hash among their grams
of ``ANCHOR`` bytes. Equal windows have equal anchors, so a window whose anchor occurs once in the corpus
can't repeat and stays at home. Segments of the other anchors meet in the shard of their anchor. A shard
sorts all suffixes of its distinct segments by Larsson-Sadakane refinement, as far as a window reaches.
Suffixes that are still one group then begin with the same window, so no common prefixes are needed.

An anchor that occurs more than ``HOT`` times would make one shard grow with the corpus. Its windows
stay in the shard of their pack: the pack sorts them the same way and sends one fingerprint per distinct
window, with its count, in sorted runs. Runs are cut at the borders of hash ranges and merged across
shards by binary search, and the sums go back in the order sent. Both ways find the same windows.

Edge cases: a null or empty text has no bytes, no spans, and keeps an empty string. Texts shorter than
a window stay whole. Rows with equal or null ids are texts of their own, so repeated rows lose what they
share. Other columns are not used. Equality of whole segments, and of hot windows between packs, rests
on 64-bit hashes; within a shard it is that of the bytes.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import packs
from .memory import lean, lean_beside
from .suffix_array import prefix_groups
from .words import _BASE, _CODE, _table, mixed, texts_of

WINDOW = 400
#: Bytes of a gram. Long grams are seldom shared without a window around them that is shared too.
ANCHOR = 128
#: Occurrences beyond which an anchor's windows are compared by fingerprints instead of in one shard.
HOT = 1000
#: Windows of a segment at most; a run over periodic text is cut.
LONGEST = 4096
#: Shards per pack.
SHARDS = 2
#: Bytes of text per pack, and windows whose grams are hashed at once, few enough for a core's own cache.
PACK_BYTES = 2 << 20
CHUNK = 1 << 15


class Hashes:
    """Hash of any byte range, from sums of coded bytes times powers modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * _table("up", _BASE, n + 1)[:n], out=self.sums[1:])
        self.down = _table("down", pow(_BASE, -1, 1 << 64), n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - begin).astype(np.uint64)
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] ^ size * np.uint64(0xD6E8FEB86659FD93))

    def rolling(self, width: int, low: int, high: int) -> np.ndarray:
        """Hashes of the ``width`` bytes from each of low..high."""
        if high <= low:
            return np.zeros(0, np.uint64)
        out = self.sums[low + width : high + width] - self.sums[low:high]
        out *= self.down[low:high]
        out ^= out >> np.uint64(32)  # one round is enough to pick the least
        out *= np.uint64(0x9FB21C651E98DF25)
        return out


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest (``best`` is a ufunc) of every ``width`` neighbours, from spans that double; the last two overlap."""
    n = len(values) - width + 1
    if n < 1:
        return values[:0]
    span = 1
    while 2 * span <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[:n], values[width - span : width - span + n])


class Cut:
    """Windows of a pack, and their segments."""

    def __init__(self, table: pa.Table, window: int, anchor: int, counted: bool = False):
        self.window = window
        self.data, self.offsets = texts_of(table.column("text"))
        n = len(self.data)
        self.hashes = Hashes(self.data)
        lengths = np.diff(self.offsets)
        inside = np.repeat(np.arange(2 * len(lengths)) % 2 == 0, np.stack([np.maximum(lengths - window + 1, 0), np.minimum(lengths, window - 1)], axis=1).reshape(-1))
        more = window - anchor  # a window holds the grams that begin at it and up to here behind it
        total = max(n - window + 1, 0)
        least, found = np.zeros(total, np.uint64), [np.zeros(0, np.uint64)]
        for begin in range(0, total, CHUNK):
            stop = min(begin + CHUNK, total)
            low = max(begin - more, 0)
            grams = self.hashes.rolling(anchor, low, stop + more)
            here = sliding(grams, more + 1, np.minimum)
            here[~inside[low:stop]] = 0  # no window
            least[begin:stop] = here[begin - low :]
            if not counted:
                continue
            # Anchors are the grams that are least in some window. Where one gram is least at several places, each counts.
            upto = stop + (more if stop == total else 0)
            spread = np.zeros(upto - begin + more, np.uint64)
            spread[low - begin + more : stop - begin + more] = here
            grams = grams[begin - low : upto - low]
            found.append(grams[sliding(spread, more + 1, np.maximum) == grams])
        edge = np.flatnonzero(np.diff(least, prepend=np.uint64(0), append=np.uint64(0)))
        begin, stop = edge[:-1], edge[1:]
        real = least[begin] != 0 if len(begin) else np.zeros(0, bool)
        begin, stop = begin[real], stop[real]
        pieces = -(-(stop - begin) // LONGEST)
        self.begin = np.repeat(begin, pieces) + _steps(pieces) * LONGEST
        self.windows = np.minimum(np.repeat(stop, pieces) - self.begin, LONGEST)
        # Least hashes are small; scrambled once more they spread over all hash ranges.
        self.value = mixed(least[self.begin]) if len(self.begin) else np.zeros(0, np.uint64)
        # Every anchor is that of some segment, so only its occurrences take the second look at all grams.
        self.anchors, self.anchor_counts = np.unique(mixed(np.concatenate(found)) if counted else self.value, return_counts=True)
        self.end = self.begin + self.windows + window - 1

    def counts_of(self, found: np.ndarray) -> np.ndarray:
        """Occurrences of each segment's anchor, from the counts of all anchors."""
        return found[np.searchsorted(self.anchors, self.value)] if len(self.value) else np.zeros(0, np.int64)

    def distinct(self, some: np.ndarray):
        """Distinct segments among ``some``: a sample and the number of each, by anchor and content; and which one each is."""
        content = self.hashes.of(self.begin[some], self.end[some])
        order = np.lexsort((content, self.value[some]))
        anchors, content = self.value[some][order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (content[1:] != content[:-1])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        return some[order[starts]], np.diff(np.append(starts, len(order))), kind

    def hot_windows(self, hot: np.ndarray) -> np.ndarray:
        """First bytes of the windows of the segments ``hot``."""
        return np.repeat(self.begin[hot], self.windows[hot]) + _steps(self.windows[hot])

    def hot_runs(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints of the distinct windows of the segments ``hot``, and how often each occurs here."""
        if not len(hot):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # Neighbouring segments are one stretch of text; equal stretches are sorted once.
        joined = np.flatnonzero(np.append(True, self.begin[hot][1:] != (self.begin + self.windows)[hot][:-1]))
        begin = self.begin[hot][joined]
        windows = np.add.reduceat(self.windows[hot], joined)
        end = begin + windows + self.window - 1
        _, sample, weight = np.unique(self.hashes.of(begin, end), return_index=True, return_counts=True)
        begin, windows, end = begin[sample], windows[sample], end[sample]
        repeats, at = window_classes(self.data, begin, end, windows, weight, self.window)
        first, count = at[repeats[1]], repeats[2]
        prints = self.hashes.of(first, first + self.window)
        order = np.argsort(prints)
        return prints[order], count[order]


def _steps(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of several ranges."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)


def window_classes(data, begin, end, windows, weight, window: int):
    """Equal windows among the byte ranges begin..end of ``data``: suffixes that are one group when sorted by a window's length.

    Returns (class of every window, a window of each class, occurrences of each class), windows being numbered
    over the ranges, and the first byte of every window. Ranges count ``weight`` times.
    """
    size = end - begin
    stop = np.cumsum(size + 1) - 1  # each range is followed by symbol 0
    symbols = np.zeros(int(stop[-1]) + 1, np.uint16)
    inside = np.ones(len(symbols), bool)
    inside[stop] = False
    symbols[inside] = data[np.repeat(begin, size) + _steps(size)].astype(np.uint16) + 1
    place = np.repeat(stop - size, windows) + _steps(windows)
    # A window holds no symbol 0, so neither do those it equals.
    group = prefix_groups(symbols, window)[place]
    known = np.zeros(len(symbols) + 1, bool)
    known[group] = True
    kind = (np.cumsum(known) - 1)[group]
    occurrences = np.bincount(kind, np.repeat(weight, windows)).astype(np.int64)
    sample = np.empty(len(occurrences), np.int64)
    sample[kind] = np.arange(len(kind))
    return (kind, sample, occurrences), np.repeat(begin, windows) + _steps(windows)


@lean
def merged_counts(table: pa.Table) -> pa.Table:
    """Sums over all runs of one hash range, given back to each run in its order.

    Runs are merged two by two: binary search finds the place of each fingerprint of one in the other.
    """
    runs = [np.cumsum(packs.restored(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    counts = [packs.restored(x, np.int64) for x in table.column("counts").to_pylist()]
    level = list(zip(runs, counts, strict=True))
    while len(level) > 1:
        level = [_merged(*level[k : k + 2]) for k in range(0, len(level), 2)]
    every, sums = level[0]
    found = [sums[np.searchsorted(every, run)] for run in runs]
    return pa.table(
        {
            "pack": table.column("pack"),
            "part": table.column("part"),
            "found": pa.array([packs.squeezed(x) for x in found], pa.binary()),
        }
    )


def _merged(a, b=None):
    if b is None:
        return a
    (keys, counts), (others, more) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    at = np.searchsorted(keys, others)
    known = keys[np.minimum(at, len(keys) - 1)] == others
    counts = counts.copy()
    counts[at[known]] += more[known]
    return np.insert(keys, at[~known], others[~known]), np.insert(counts, at[~known], more[~known])


def runs_merged(rows: DataFrame, known: DataFrame, n: int, runs) -> DataFrame:
    """(pack, part, found): ``runs(table, tallied)`` of every pack, merged over all packs by hash ranges."""

    @lean_beside
    def send(table: pa.Table, tallied: pa.Table) -> pa.Table:
        keys, counts = runs(table, tallied)
        at = packs.range_starts(keys, n)
        pack = table.column("pack")[0].as_py() if table.num_rows else 0
        parts = np.flatnonzero(np.diff(at))
        blocks = [
            (packs.squeezed(packs.differences(keys[a:b])), packs.squeezed(counts[a:b]))
            for a, b in zip(at[parts], at[parts + 1], strict=True)
        ]
        return pa.table(
            {
                "pack": pa.array([pack] * len(parts), pa.int32()),
                "part": pa.array(parts, pa.int32()),
                "keys": pa.array([k for k, _ in blocks], pa.binary()),
                "counts": pa.array([c for _, c in blocks], pa.binary()),
            }
        )

    sent = packs.beside(rows, known, send, "pack int, part int, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(merged_counts, "pack int, part int, found binary")


def shard_search(window: int):
    """Finds the repeated windows of one shard: a bit per window of every segment sent, in the order sent."""

    @lean
    def search(table: pa.Table) -> pa.Table:
        sizes = [packs.restored(x, np.int32).astype(np.int64) for x in table.column("sizes").to_pylist()]
        weights = np.concatenate([packs.restored(x, np.int64) for x in table.column("weights").to_pylist()])
        text = b"".join(zstandard.decompress(x) for x in table.column("text").to_pylist())
        data = np.frombuffer(text, np.uint8)
        size = np.concatenate(sizes)
        end = np.cumsum(size)
        begin = end - size
        _, sample, back = np.unique(Hashes(data).of(begin, end), return_index=True, return_inverse=True)
        weight = np.bincount(back, weights).astype(np.int64)
        windows = size - window + 1
        (kind, _, occurrences), _ = window_classes(data, begin[sample], end[sample], windows[sample], weight, window)
        repeated = occurrences[kind] > 1
        first = np.cumsum(windows[sample]) - windows[sample]
        bits = repeated[np.repeat(first[back], windows) + _steps(windows)]
        stops = np.cumsum([int((x - window + 1).sum()) for x in sizes])[:-1]
        return pa.table(
            {
                "pack": table.column("pack"),
                "part": table.column("part"),
                "kinds": table.column("kinds"),
                "bits": pa.array([zstandard.compress(np.packbits(x).tobytes(), 1) for x in np.split(bits, stops)], pa.binary()),
            }
        )

    return search


def deduped(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    hot: int = HOT,
    shards: int = SHARDS,
    pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document: removed byte ranges, and the bytes that stay."""

    @lean
    def keys(table: pa.Table):
        cut = Cut(table, window, anchor, counted=True)
        return cut.anchors, cut.anchor_counts

    def ways(table: pa.Table, tallied: pa.Table):
        """The pack's segments, and which of them go to a shard and which are hot."""
        cut = Cut(table, window, anchor)
        counts = cut.counts_of(packs.counts_in_order(tallied))
        return cut, np.flatnonzero((counts > 1) & (counts <= hot)), np.flatnonzero(counts > hot)

    @lean_beside
    def ship(table: pa.Table, tallied: pa.Table) -> pa.Table:
        cut, some, _ = ways(table, tallied)
        sample, weight, _ = cut.distinct(some)
        at = packs.range_starts(cut.value[sample], shards * n)
        rows = []
        for part in np.flatnonzero(np.diff(at)):
            a, b = at[part], at[part + 1]
            begin, size = cut.begin[sample[a:b]], (cut.end - cut.begin)[sample[a:b]]
            text = cut.data[np.repeat(begin, size) + _steps(size)].tobytes()
            rows.append(
                (
                    int(part),
                    packs.squeezed(packs.differences(np.arange(a, b))),
                    packs.squeezed(size.astype(np.int32)),
                    packs.squeezed(weight[a:b].astype(np.int64)),
                    zstandard.compress(text, 3),
                )
            )
        pack = table.column("pack")[0].as_py() if table.num_rows else 0
        columns = list(zip(*rows, strict=True)) or [()] * 5
        names, kinds = ["part", "kinds", "sizes", "weights", "text"], [pa.int32(), *[pa.binary()] * 4]
        return pa.table(
            {"pack": pa.array([pack] * len(rows), pa.int32())}
            | {k: pa.array(v, t) for k, v, t in zip(names, columns, kinds, strict=True)}
        )

    def hot_keys(table: pa.Table, tallied: pa.Table):
        if not (packs.counts_in_order(tallied) > hot).any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        cut, _, heated = ways(table, tallied)
        return cut.hot_runs(heated)

    @lean_beside
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        by_kind = [answers.filter(pa.compute.equal(answers.column("what"), k)) for k in range(3)]
        cut, some, heated = ways(table, by_kind[0])
        repeated = np.zeros(len(cut.data) + 1, bool)
        sample, _, kind = cut.distinct(some)
        windows = cut.windows[sample]
        first = np.cumsum(windows) - windows
        flags = np.zeros(int(windows.sum()), bool)
        for kinds, bits in zip(by_kind[1].column("kinds").to_pylist(), by_kind[1].column("found").to_pylist(), strict=True):
            index = np.cumsum(packs.restored(kinds, np.int64))
            total = int(windows[index].sum())
            flags[first[index[0]] : first[index[0]] + total] = np.unpackbits(np.frombuffer(zstandard.decompress(bits), np.uint8))[:total]
        size = cut.windows[some]
        place = np.repeat(cut.begin[some], size) + _steps(size)
        repeated[place[flags[np.repeat(first[kind], size) + _steps(size)]]] = True
        if len(heated):
            place = cut.hot_windows(heated)
            _, back = np.unique(cut.hashes.of(place, place + window), return_inverse=True)
            repeated[place[packs.counts_in_order(by_kind[2])[back] > 1]] = True
        return _without(table, cut, repeated[:-1], window)

    rows, n = packs.packed(docs, pack_bytes)
    known = packs.tally(rows, n, keys)
    shipped = packs.beside(
        rows, known, ship, "pack int, part int, kinds binary, sizes binary, weights binary, text binary"
    )
    bits = shipped.groupBy("part").applyInArrow(shard_search(window), "pack int, part int, kinds binary, bits binary")
    counts = runs_merged(rows, known, n, hot_keys)
    answers = (
        known.selectExpr("0 AS what", "pack", "part", "CAST(NULL AS BINARY) AS kinds", "found")
        .union(bits.selectExpr("1", "pack", "part", "kinds", "bits"))
        .union(counts.selectExpr("2", "pack", "part", "CAST(NULL AS BINARY)", "found"))
    )
    return packs.beside(
        rows, answers, remove, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    )


def _without(table: pa.Table, cut: Cut, repeated: np.ndarray, window: int) -> pa.Table:
    """The texts without the bytes of repeated windows."""
    n = len(cut.data)
    upto = np.zeros(n + window, np.int32)
    np.cumsum(repeated, out=upto[window:])
    removed = upto[window:] > upto[:n]  # windows never cross texts
    del upto
    edge = np.zeros(n + 1, bool)
    edge[1:n] = removed[1:] & ~removed[:-1]
    if n:
        edge[0] = removed[0]
    inner = cut.offsets[:-1][cut.offsets[:-1] < n]
    edge[inner] = removed[inner]
    begin = np.flatnonzero(edge)
    last = np.zeros(n + 1, bool)
    last[1:n] = removed[:-1] & ~removed[1:]
    if n:
        last[n] = removed[-1]
    ends = cut.offsets[1:][cut.offsets[1:] > 0]
    last[ends] |= removed[ends - 1]
    stop = np.flatnonzero(last)
    doc = np.searchsorted(cut.offsets, begin, side="right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(begin - cut.offsets[doc], pa.int64()), pa.array(stop - cut.offsets[doc], pa.int64())], ["start", "stop"]
    )
    n_docs = len(cut.offsets) - 1
    lists = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int32)
    kept = np.concatenate([[0], np.cumsum(~removed, dtype=np.int32)])[cut.offsets].astype(np.int32)
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "n_bytes": pa.array(np.diff(cut.offsets), pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(lists), spans),
            "kept": pa.BinaryArray.from_buffers(
                pa.binary(), n_docs, [None, pa.py_buffer(kept), pa.py_buffer(cut.data[~removed].tobytes())]
            ),
        }
    )
