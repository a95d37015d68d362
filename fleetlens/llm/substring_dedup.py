"""Substring dedup with one compressed FM-index per shard.

A window is a fixed number of consecutive words. A word is removed if a window that covers it
also starts in a document with a smaller id.

Texts are cut into segments: runs of windows that have the same anchor, the least hash among their
runs of ``ANCHOR`` words. Equal windows have equal anchors, so all their segments meet in
the shard of the anchor. Segments whose anchor is in one document only stay at home. A shard
builds an FM-index over its distinct segments, streams the segments through it by backward
search, and where the matching statistics reach the window length it takes the least id over the
occurrences. Each pack sends a segment once, however many of its documents have it, and gets the answers back
in the order sent.

Edge cases: a null or empty text has no words and its kept text is empty. Rows with a null id
neither lose words nor make others lose any. Rows with the same id do not remove from each other. Texts
shorter than a window stay whole, with white space made single spaces. Other columns are not used.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packs
from .fm_index import FMIndex
from .words import Words, grams, range_hashes, words_of

WINDOW = 13
ANCHOR = 5
NO_ID = np.iinfo(np.int64).max


class Segments:
    """Segments of a pack: occurrences in the texts, and the distinct ones sorted by anchor and content."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.words = words_of(table.column("text"))
        ids = table.column("doc_id")
        self.has_id = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(NO_ID))
        begin, last, value = _cut(self.words, window, anchor)
        keep = self.has_id[self.words.doc[begin]] if len(begin) else np.zeros(0, bool)
        self.begin, self.windows, anchors = begin[keep], (last - begin + 1)[keep], value[keep]
        self.end = self.begin + self.windows - 1 + window
        content = range_hashes(self.words.hash, self.begin, self.end)
        order = np.lexsort((content, anchors))
        a, c = anchors[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.kind = np.empty(len(order), np.int64)  # of each occurrence its distinct segment
        self.kind[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.sample = order[starts]
        self.anchor = a[starts]
        owner = self.ids[self.words.doc[self.begin]]
        self.least = np.minimum.reduceat(owner[order], starts) if len(starts) else owner
        pairs = np.unique(np.stack([self.anchor[self.kind].view(np.int64), owner]), axis=1) if len(owner) else np.zeros((2, 0))
        self.anchors, self.anchor_docs = np.unique(np.ascontiguousarray(pairs[0]).astype(np.int64).view(np.uint64), return_counts=True)


def _cut(words: Words, window: int, anchor: int):
    """First window, last window and anchor of every segment; windows are numbered by their first word."""
    n = len(words.hash) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = grams(words, anchor, seed=anchor, inside_only=False)[0]
    where = np.arange(len(value))
    span, width = 1, window - anchor + 1

    def better(v, p, shift, count):
        left, right = v[:count], v[shift : shift + count]
        take = right < left
        return np.where(take, right, left), np.where(take, p[shift : shift + count], p[:count])

    while span < width:
        shift = min(span, width - span)
        value, where = better(value, where, shift, len(value) - shift)
        span += shift
    inside = words.doc[:n] == words.doc[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (where[at[1:]] != where[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], value[at[first]]


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of several ranges, one after the other."""
    ends = np.cumsum(size)
    index = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return data[index]


def deduped(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; ``kept`` is the text that stays."""

    def keys(table: pa.Table):
        cut = Segments(table, window, anchor)
        return cut.anchors, cut.anchor_docs

    def ship(table: pa.Table, tallied: pa.Table) -> pa.Table:
        cut = Segments(table, window, anchor)
        repeated = packs.counts_in_order(tallied) > 1
        wanted = np.flatnonzero(repeated[np.searchsorted(cut.anchors, cut.anchor)])
        at = packs.range_starts(cut.anchor[wanted], n)
        words, rows = cut.words, []
        for part, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a == b:
                continue
            index = wanted[a:b]
            some = cut.sample[index]
            begin = words.start[cut.begin[some]]
            size = words.end[cut.end[some] - 1] - begin
            text = gathered(words.data, begin, size).tobytes()
            rows.append(
                (
                    part,
                    packs.squeezed(packs.differences(index)),
                    packs.squeezed(size.astype(np.int32)),
                    packs.squeezed(cut.least[index]),
                    packs.zstandard.compress(text, 1),
                )
            )
        pack = table.column("pack")[0].as_py() if table.num_rows else 0
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int32(), *[pa.binary()] * 4]
        names = ["part", "kinds", "sizes", "least", "text"]
        return pa.table(
            {"pack": pa.array([pack] * len(rows), pa.int32())}
            | {k: pa.array(v, t) for k, v, t in zip(names, columns, kinds, strict=True)}
        )

    def search(table: pa.Table) -> pa.Table:
        sizes = [packs.restored(x, np.int32) for x in table.column("sizes").to_pylist()]
        least = np.concatenate([packs.restored(x, np.int64) for x in table.column("least").to_pylist()])
        text = b"".join(packs.zstandard.decompress(x) for x in table.column("text").to_pylist())
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        segments = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text)]
        )
        words = words_of(segments)
        begin, end = words.first[:-1], words.first[1:]
        content = range_hashes(words.hash, begin, end)
        _, sample, back = np.unique(content, return_index=True, return_inverse=True)
        least_of = np.full(len(sample), NO_ID)
        np.minimum.at(least_of, back, least)
        # Distinct segments one after the other, each followed by symbol 0.
        length = (end - begin)[sample]
        stop = np.cumsum(length + 1) - 1
        start = stop - length
        symbols = np.zeros(int(stop[-1]) + 1, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[stop] = False
        vocabulary, coded = np.unique(words.hash, return_inverse=True)
        symbols[inside] = gathered(coded + 1, begin[sample], length)
        index = FMIndex(symbols, len(vocabulary) + 1, window)
        _, found = index.match(symbols, start, stop)
        first = index.class_least(np.repeat(least_of, length + 1))
        least_at = np.where(found >= 0, first[found], NO_ID)
        # Answers of each pack: how far below the segment's own least id each window's least id is.
        n_windows = (end - begin) - window + 1
        answers = np.repeat(least, n_windows) - gathered(least_at, start[back], n_windows)
        cuts = np.cumsum([int(n_windows[a:b].sum()) for a, b in _bounds(sizes)])[:-1]
        return pa.table(
            {
                "pack": table.column("pack"),
                "part": table.column("part"),
                "kinds": table.column("kinds"),
                "below": pa.array([packs.squeezed(x) for x in np.split(answers, cuts)], pa.binary()),
            }
        )

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        cut = Segments(table, window, anchor)
        words = cut.words
        least_at = np.zeros(0, np.int64)
        offset = np.full(len(cut.sample), -1, np.int64)
        at = 0
        for kinds, below in zip(answers.column("kinds").to_pylist(), answers.column("below").to_pylist(), strict=True):
            index = np.cumsum(packs.restored(kinds, np.int64))
            n_windows = cut.windows[cut.sample[index]]
            values = np.repeat(cut.least[index], n_windows) - packs.restored(below, np.int64)
            offset[index] = at + np.cumsum(n_windows) - n_windows
            at += len(values)
            least_at = np.concatenate([least_at, values])
        asked = np.flatnonzero(offset[cut.kind] >= 0)
        size = cut.windows[asked]
        place = np.repeat(cut.begin[asked], size) + _steps(size)
        least = gathered(least_at, offset[cut.kind[asked]], size)
        place = place[least < cut.ids[words.doc[place]]]
        edge = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        begin, length = words.start[keep], words.end[keep] - words.start[keep]
        ends = np.cumsum(length + 1)
        joined = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        index = np.repeat(ends - 1 - length, length) + _steps(length)
        joined[index] = gathered(words.data, begin, length)
        n_words = np.diff(words.first)
        n_kept = np.bincount(words.doc[keep], minlength=words.n_docs)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_kept)])]
        raw = joined.tobytes()
        kept = [raw[a : max(b - 1, a)].decode() for a, b in zip(upto[:-1], upto[1:], strict=True)]
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_words - n_kept, pa.int64()),
                "kept": pa.array(kept, pa.string()),
            }
        )

    rows, n = packs.packed(docs)
    shipped = packs.beside(
        rows,
        packs.tally(rows, n, keys),
        ship,
        "pack int, part int, kinds binary, sizes binary, least binary, text binary",
    )
    answers = shipped.groupBy("part").applyInArrow(search, "pack int, part int, kinds binary, below binary")
    return packs.beside(rows, answers, remove, "doc_id long, n_words long, n_removed long, kept string")


def _steps(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of several ranges."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)


def _bounds(blocks):
    ends = np.cumsum([len(x) for x in blocks])
    return zip(ends - [len(x) for x in blocks], ends, strict=True)
