"""Alignment of two tokenizers by merge-path partitioning.

Both token sequences of a text cover the same bytes, so their alignment is a merge of two sorted lists
of token ends. The ends of many documents in a row make one long merge. Diagonals of that merge, a
fixed number of ends apart, are searched by bisection for the place where each cuts the two lists;
between two diagonals lies a piece of equal work that knows all it needs: its tokens, the next token
of either list, and the borders of its documents. Long documents run over many pieces, short ones
share one.

A piece emits one overlap per end, between the token that ends there and the token of the other
list that is open, so every overlapping pair comes once. Both lists ending at one byte close a group. A
document that lies in several pieces has its groups, sums and distinct pairs put together from them.

How many documents hold an id pair linked is counted by hash ranges of the A id, so the highest count
of an A id is known in the same place; a piece asks for its distinct pairs once.

Edge cases: a null or empty text, and a text whose tokens of either kind don't spell a space and the
text, has no tokens: zeros and no groups. Rows with equal ids or equal texts are documents of their own.
Null ids are kept. Other columns are not used.
"""

import json
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .memory import fresh_start, lean, lean_beside
from .packs import differences, restored, squeezed
from .words import mixed, sliced

#: Folder of the vocabulary files, and their names.
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ends of A and B in a piece, and bytes of text that are tokenized before pieces are cut.
PIECE_ENDS = 1 << 19
SLICE_BYTES = 3 << 20
#: Compression of tokens; sequences of ids repeat as words do.
LEVEL = 6
#: Pieces in a pack, which asks for its distinct pairs once; and packs that answer to one hash range, on average.
PACK_PIECES = 16
PACKS_A_RANGE = 4
#: How the pre-tokenizer of A cuts a text (fixed value of that vocabulary).
A_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DOC_SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
)
PART_SCHEMA = (
    "row long, piece long, doc_id long, n_a long, n_b long, n_links long, n_best long, count_sum long, "
    "closed long, head_a string, head_b string, inner string, tail_a string, tail_b string"
)


@dataclass
class Vocabulary:
    """Bytes of every token id, one after the other."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]):
        size = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def spells(self, ids: np.ndarray, text: np.ndarray) -> bool:
        size = self.size[ids]
        ends = np.cumsum(size)
        if int(ends[-1] if len(ends) else 0) != len(text):
            return False
        index = np.repeat(self.start[ids] - (ends - size), size) + np.arange(len(text))
        return bool((self.data[index] == text).all())


def byte_characters() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def a_encoder(path: str):
    """(encode, Vocabulary) of the byte-level file; special tokens are plain text to it."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model["added_tokens"]}
    byte_of = byte_characters()
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    # Ids follow the order of merges, so the ranks give the same tokens as the file's own list of merges.
    encoder = tiktoken.Encoding(path, pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoder.encode_to_numpy(text, disallowed_special=()), Vocabulary.of(tokens)


@lru_cache(maxsize=2)
def b_encoder(path: str):
    """(encode, Vocabulary) of the piece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def token(i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    return model.encode, Vocabulary.of([token(i) for i in range(model.vocab_size())])


class Tokenizers:
    """Both tokenizers; texts are tokenized as a whole, which costs less than to look up their words."""

    def __init__(self, a_path: str, b_path: str):
        self.a_encode, self.a = a_encoder(a_path)
        self.b_encode, self.b = b_encoder(b_path)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        # B puts the space before the text by itself.
        return self.a_encode(" " + text).astype(np.int64), np.array(self.b_encode(text), np.int64)


def cuts(a_ends: np.ndarray, b_ends: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where every ``step``-th diagonal of the merge cuts the two lists; equal ends stay together.

    All diagonals are bisected at once. On a tie the end of A comes first.
    """
    n, m = len(a_ends), len(b_ends)
    diagonal = np.arange(step, n + m, step)
    low, high = np.maximum(diagonal - m, 0), np.minimum(diagonal, n)
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        at = np.where(open_, middle, 0)
        # a_ends[middle] belongs before the diagonal if it is not beyond the B end it would displace.
        before = a_ends[np.minimum(at, n - 1)] <= b_ends[np.clip(diagonal - at - 1, 0, m - 1)]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    i, j = low, diagonal - low
    tied = (i > 0) & (j < m)
    tied[tied] = a_ends[i[tied] - 1] == b_ends[j[tied]]
    j = j + tied
    return np.concatenate([[0], i, [n]]), np.concatenate([[0], j, [m]])


def _pieces(key: int, table: pa.RecordBatch, both: Tokenizers, step: int):
    """Rows of the piece table for some documents, numbered from ``key`` on."""
    ids = table.column("doc_id").to_pylist()
    a_all, b_all, ends = [], [], np.zeros(len(ids), np.int64)
    for k, text in enumerate(table.column("text").to_pylist()):
        if not text:
            continue
        whole = np.frombuffer(b" " + text.encode(), np.uint8)
        a, b = both.tokens(text)
        if both.a.spells(a, whole) and both.b.spells(b, whole):
            a_all.append(a)
            b_all.append(b)
            ends[k] = len(whole)
    doc_ends = np.cumsum(ends)
    a = np.concatenate([np.zeros(0, np.int64), *a_all])
    b = np.concatenate([np.zeros(0, np.int64), *b_all])
    a_size, b_size = both.a.size[a], both.b.size[b]
    a_ends, b_ends = np.cumsum(a_size), np.cumsum(b_size)
    i, j = cuts(a_ends, b_ends, step)
    upto = np.maximum(np.append(0, a_ends)[i], np.append(0, b_ends)[j])  # last byte at which a piece has an end
    # A document that a diagonal parts has its pieces to itself: it begins and ends with a cut.
    inner = upto[1:-1][upto[1:-1] < (doc_ends[-1] if len(ids) else 0)]
    parted = np.unique(np.searchsorted(doc_ends, inner, side="right"))
    borders = np.concatenate([doc_ends[parted] - ends[parted], doc_ends[parted]])
    some_i = np.concatenate([i[1:-1], np.searchsorted(a_ends, borders, side="right")])
    some_j = np.concatenate([j[1:-1], np.searchsorted(b_ends, borders, side="right")])
    at, once = np.unique(some_i + some_j, return_index=True)
    once = once[(at > 0) & (at < len(a) + len(b))]
    i, j = np.concatenate([[0], some_i[once], [len(a)]]), np.concatenate([[0], some_j[once], [len(b)]])
    upto = np.maximum(np.append(0, a_ends)[i], np.append(0, b_ends)[j])
    stop = np.searchsorted(doc_ends, upto, side="right")
    stop[-1] = len(ids)
    for p in range(len(i) - 1):
        # Documents that end before the piece begins are done; the last one may go on in the next piece.
        first = int(stop[p]) if p else 0
        last = int(stop[p + 1])
        goes_on = p + 2 < len(i) and last < len(ids) and int(upto[p + 1]) > (int(doc_ends[last - 1]) if last else 0)
        docs = slice(first, last + goes_on)
        a_some, b_some = slice(i[p], i[p + 1] + 1), slice(j[p], j[p + 1] + 1)  # with the next token of either
        a_base = int(a_ends[i[p]] - a_size[i[p]]) if i[p] < len(a) else int(upto[p])
        b_base = int(b_ends[j[p]] - b_size[j[p]]) if j[p] < len(b) else int(upto[p])
        before = int(doc_ends[first - 1]) if first else 0
        came_in = bool(p and before < int(upto[p]))
        pack = key + p // PACK_PIECES
        yield {
            "pack": -1 - pack if came_in or goes_on else pack,  # apart, as they are put together apart
            "piece": key + p,
            "first": key + first,
            "goes_on": bool(goes_on),
            "came_in": came_in,
            "ids": ids[docs],
            "doc_ends": doc_ends[docs].tolist(),
            "bases": [a_base, b_base],
            "counts": [int(i[p + 1] - i[p]), int(j[p + 1] - j[p])],
            "a": zstandard.compress(a[a_some].astype(np.uint16).tobytes(), LEVEL),
            "b": zstandard.compress(b[b_some].astype(np.uint16).tobytes(), LEVEL),
        }


PIECE_FIELDS = pa.schema(
    [
        ("pack", pa.int64()),
        ("piece", pa.int64()),
        ("first", pa.int64()),
        ("goes_on", pa.bool_()),
        ("came_in", pa.bool_()),
        ("ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int64())),
        ("bases", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("a", pa.binary()),
        ("b", pa.binary()),
    ]
)
PIECE_SCHEMA = (
    "pack long, piece long, first long, goes_on boolean, came_in boolean, ids array<long>, doc_ends array<long>, "
    "bases array<long>, counts array<long>, a binary, b binary"
)


class Piece:
    """Overlaps of one piece: id pair, document, and where groups close."""

    def __init__(self, row: dict, a_size: np.ndarray, b_size: np.ndarray):
        self.number, self.first = row["piece"], row["first"]
        self.ids, self.n_docs = row["ids"], len(row["ids"])
        n, m = row["counts"]
        a, b = (np.frombuffer(zstandard.decompress(row[k]), np.uint16).astype(np.int64) for k in ("a", "b"))
        a_ends = row["bases"][0] + np.cumsum(a_size[a])
        b_ends = row["bases"][1] + np.cumsum(b_size[b])
        self.a, self.b, self.a_ends, self.b_ends = a[:n], b[:m], a_ends[:n], b_ends[:m]
        doc_ends = np.array(row["doc_ends"], np.int64)
        # The token of the other list that is open where a token ends.
        b_open = np.searchsorted(b_ends, self.a_ends)
        a_open = np.searchsorted(a_ends, self.b_ends)
        both = a_ends[np.minimum(a_open, len(a) - 1)] == self.b_ends if len(a) else np.zeros(m, bool)
        self.common = self.b_ends[both]
        alone = np.flatnonzero(~both)
        self.pair_a = np.concatenate([self.a, a[a_open[alone]]])
        self.pair_b = np.concatenate([b[b_open], self.b[alone]])
        self.a_doc = np.searchsorted(doc_ends, self.a_ends)
        self.b_doc = np.searchsorted(doc_ends, self.b_ends)
        self.common_doc = np.searchsorted(doc_ends, self.common)
        self.doc = np.concatenate([self.a_doc, self.b_doc[alone]])
        self.whole = np.ones(self.n_docs, bool)
        if self.n_docs and row["came_in"]:
            self.whole[0] = False
        if self.n_docs and row["goes_on"]:
            self.whole[-1] = False
        self.keys, self.back = np.unique(self.pair_a << 16 | self.pair_b, return_inverse=True)

    def documents_with(self) -> np.ndarray:
        """Of each key, how many of the documents that lie in this piece alone hold it."""
        some = self.whole[self.doc]
        width = max(len(self.keys), 1)
        distinct = np.unique(self.doc[some] * width + self.back[some])
        return np.bincount(distinct % width, minlength=len(self.keys))

    def sums(self, counts: np.ndarray, best: np.ndarray) -> list[np.ndarray]:
        """n_a, n_b, n_links, n_best, count_sum of every document, as far as it lies in this piece."""
        of_link = counts[self.back]
        order = np.argsort(self.doc, kind="stable")
        upto = np.concatenate([[0], np.cumsum(of_link[order])])
        at = np.searchsorted(self.doc[order], np.arange(self.n_docs + 1))
        return [
            np.bincount(self.a_doc, minlength=self.n_docs),
            np.bincount(self.b_doc, minlength=self.n_docs),
            np.bincount(self.doc, minlength=self.n_docs),
            np.bincount(self.doc[(of_link == best[self.back]) & (of_link > 0)], minlength=self.n_docs),
            upto[at[1:]] - upto[at[:-1]],
        ]

    def listed(self, docs: np.ndarray):
        """Ids of A and of B between the closing ends, joined by commas, and how many belong to each of ``docs``.

        A document has a string for each end that closes a group in it, and one for what is open at its end here.
        """
        out = []
        closing = np.concatenate([self.common_doc, np.arange(self.n_docs)])
        ends = np.concatenate([self.common, np.full(self.n_docs, np.iinfo(np.int64).max)])
        order = np.lexsort((ends, closing))
        slot_of_end = np.empty(len(order), np.int64)
        slot_of_end[order] = np.arange(len(order))
        per_doc = np.bincount(closing, minlength=self.n_docs)
        base = np.cumsum(per_doc) - per_doc
        closed_before = np.searchsorted(self.common_doc, np.arange(self.n_docs))
        keep = np.isin(np.arange(self.n_docs), docs)
        slots = np.flatnonzero(np.repeat(keep, per_doc))
        for tokens, token_ends, token_doc in ((self.a, self.a_ends, self.a_doc), (self.b, self.b_ends, self.b_doc)):
            slot = base[token_doc] + np.searchsorted(self.common, token_ends) - closed_before[token_doc]
            some = keep[token_doc]
            at = np.searchsorted(slot[some], slots)
            offsets = np.append(at, int(some.sum())).astype(np.int32)
            strings = pa.array(tokens[some]).cast(pa.string())
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), strings), ","))
        return out[0], out[1], per_doc[keep]


def _ranged(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct pairs by the hash of their A id, and where each of ``n`` hash ranges begins in it, with the end."""
    hashes = mixed((keys >> 16).astype(np.uint64))
    order = np.argsort(hashes, kind="stable")
    borders = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return order, np.concatenate([[0], np.searchsorted(hashes[order], borders), [len(keys)]]).astype(np.int64)


def _joined(pairs: pa.Array, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pairs), ";")


def _fields(schema: str) -> pa.Schema:
    """Arrow fields of a schema of longs and strings."""
    pairs = [field.split() for field in schema.split(", ")]
    return pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in pairs])


def _long(values) -> pa.Array:
    return pa.array(values, pa.int64())


def _whole(piece: Piece, counts: np.ndarray, best: np.ndarray) -> pa.Table:
    """Results of the documents that lie in this piece alone."""
    docs = np.flatnonzero(piece.whole)
    a, b, slots = piece.listed(docs)
    last = np.cumsum(slots) - 1  # the open place, empty in a whole document
    closed = np.ones(len(a), bool)
    closed[last] = False
    groups = pc.binary_join_element_wise(a, b, "|").filter(pa.array(closed))
    n_a, n_b, n_links, n_best, count_sum = (x[docs] for x in piece.sums(counts, best))
    return pa.table(
        {
            "doc_id": _long([piece.ids[d] for d in docs]),
            "n_a": _long(n_a),
            "n_b": _long(n_b),
            "n_groups": _long(slots - 1),
            "n_links": _long(n_links),
            "n_best": _long(n_best),
            "count_sum": _long(count_sum),
            "groups": _joined(groups, slots - 1),
        }
    )


def _parts(piece: Piece, counts: np.ndarray, best: np.ndarray) -> pa.Table:
    """What this piece has of the documents that others share."""
    docs = np.flatnonzero(~piece.whole)
    a, b, slots = piece.listed(docs)
    pairs = pc.binary_join_element_wise(a, b, "|")
    start = np.cumsum(slots) - slots
    sums = [x[docs] for x in piece.sums(counts, best)]
    rows = []
    for k, d in enumerate(docs):
        head, tail = int(start[k]), int(start[k] + slots[k] - 1)
        rows.append(
            {
                "row": piece.first + int(d),
                "piece": piece.number,
                "doc_id": piece.ids[d],
                **{name: int(x[k]) for name, x in zip(("n_a", "n_b", "n_links", "n_best", "count_sum"), sums, strict=True)},
                "closed": tail - head,
                "head_a": a[head].as_py(),
                "head_b": b[head].as_py(),
                "inner": ";".join(pairs.slice(head + 1, max(tail - head - 1, 0)).to_pylist()),
                "tail_a": a[tail].as_py() if tail > head else "",
                "tail_b": b[tail].as_py() if tail > head else "",
            }
        )
    return pa.Table.from_pylist(rows, _fields(PART_SCHEMA))


def _stitch(table: pa.Table) -> pa.Table:
    """One document from its parts: the open group of a piece goes on in the head of the next."""
    groups, open_a, open_b = [], [], []
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    for r in rows:
        open_a.append(r["head_a"])
        open_b.append(r["head_b"])
        if r["closed"]:
            groups.append(",".join(filter(None, open_a)) + "|" + ",".join(filter(None, open_b)))
            groups += [r["inner"]] if r["closed"] > 1 else []
            open_a, open_b = [r["tail_a"]], [r["tail_b"]]
    row = {"doc_id": rows[0]["doc_id"], "n_groups": sum(r["closed"] for r in rows), "groups": ";".join(groups)}
    row |= {name: sum(r[name] for r in rows) for name in ("n_a", "n_b", "n_links", "n_best", "count_sum")}
    return pa.Table.from_pylist([row], _fields(DOC_SCHEMA))


@lean
def _counted(table: pa.Table) -> pa.Table:
    """Of one hash range: the documents of every pair, and the most that any pair of its A id has."""
    blocks = [np.cumsum(restored(x, np.int64)) for x in table.column("keys").to_pylist()]
    counts = [restored(x, np.int64) for x in table.column("counts").to_pylist()]
    found, back = np.unique(np.concatenate(blocks), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, back, np.concatenate(counts))
    starts = np.flatnonzero(np.diff(found >> 16, prepend=-1))
    best = np.repeat(np.maximum.reduceat(total, starts), np.diff(np.append(starts, len(found))))
    stops = np.cumsum([len(x) for x in blocks])[:-1]
    return pa.table(
        {
            "pack": table.column("pack"),
            "part": table.column("part"),
            "counts": pa.array([squeezed(x) for x in np.split(total[back], stops)], pa.binary()),
            "best": pa.array([squeezed(x) for x in np.split(best[back], stops)], pa.binary()),
        }
    )


def _answers(table: pa.Table) -> list[np.ndarray]:
    """Counts and best counts of a pack's pairs, in the order in which they were sent."""
    order = np.argsort(table.column("part").to_numpy())
    out = []
    for name in ("counts", "best"):
        blobs = table.column(name).to_pylist()
        out.append(np.concatenate([np.zeros(0, np.int64), *(restored(blobs[i], np.int64) for i in order)]))
    return out


def pieces(docs: DataFrame, a_path: str, b_path: str, step: int, slice_bytes: int) -> DataFrame:
    """The piece table: tokens of all documents, cut along the diagonals of their merge."""

    def tokenize(batches):
        from pyspark import TaskContext

        fresh_start()
        key = TaskContext.get().partitionId() << 40
        both = Tokenizers(a_path, b_path)
        for batch in batches:
            for some in sliced(batch, "text", slice_bytes):
                rows = list(_pieces(key, some, both, step))
                key += some.num_rows + len(rows)
                yield pa.RecordBatch.from_pylist(rows, PIECE_FIELDS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tokenize, PIECE_SCHEMA)


def aligned(
    docs: DataFrame,
    folder: str = FOLDER,
    step: int = PIECE_ENDS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per document: tokens of either kind, groups, links, links to the best partner of their A id,
    sum of the links' counts, and the groups as text (``a1,a2|b1;a3|b2,b3``)."""
    a_path, b_path = f"{folder}/{A_FILE}", f"{folder}/{B_FILE}"
    a_size, b_size = a_encoder(a_path)[1].size, b_encoder(b_path)[1].size
    # Tokens are made once and written: numbers of pieces and rows stay the same, and a lost executor costs no tokenizing.
    cut = written(pieces(docs, a_path, b_path, step, slice_bytes), "pieces")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, math.ceil(cut.select("pack").distinct().count() / PACKS_A_RANGE))

    def pieces_of(rows: pa.Table):
        for row in sorted(rows.to_pylist(), key=lambda r: r["piece"]):
            yield row, Piece(row, a_size, b_size)

    @lean
    def ask(rows: pa.Table) -> pa.Table:
        """Blocks of distinct pairs: of the pack with the documents that lie in one piece, and of each other document."""
        keys, counts, shared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for _, piece in pieces_of(rows):
            keys.append(piece.keys)
            counts.append(piece.documents_with())
            for d in np.flatnonzero(~piece.whole):
                shared.append((piece.first + int(d), piece.keys[np.unique(piece.back[piece.doc == d])]))
        found, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, back, np.concatenate(counts))
        blocks = ranged_blocks(rows.column("pack")[0].as_py(), None, found, total)
        return block_table(blocks + [(None, row, None, some, np.ones(len(some), np.int64)) for row, some in shared])

    def ranged_blocks(pack, row, keys: np.ndarray, counts: np.ndarray):
        order, at = _ranged(keys, n)
        keys, counts = keys[order], counts[order]
        return [(pack, row, int(p), keys[at[p] : at[p + 1]], counts[at[p] : at[p + 1]]) for p in np.flatnonzero(np.diff(at))]

    def block_table(blocks) -> pa.Table:
        kinds = [("pack", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
        cells = [(p, r, k, squeezed(differences(keys)), squeezed(counts)) for p, r, k, keys, counts in blocks]
        columns = list(zip(*cells, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])

    def once(table: pa.Table) -> pa.Table:
        """Distinct pairs of a document that lies in several pieces, as blocks that expect no answer."""
        found = np.unique(np.concatenate([np.cumsum(restored(x, np.int64)) for x in table.column("keys").to_pylist()]))
        return block_table(ranged_blocks(None, table.column("row")[0].as_py(), found, np.ones(len(found), np.int64)))

    def answered(result, wanted, schema: str):
        @lean_beside
        def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
            some = rows.filter(pa.array([wanted(r) for r in rows.select(["ids", "goes_on", "came_in"]).to_pylist()]))
            if not some.num_rows:
                return _fields(schema).empty_table()
            found = [np.zeros(0, np.int64), *(piece.keys for _, piece in pieces_of(rows))]
            found = np.unique(np.concatenate(found))
            order, _ = _ranged(found, n)
            counts, best = (np.empty(len(found), np.int64) for _ in range(2))
            counts[order], best[order] = _answers(answers)
            out = []
            for _, piece in pieces_of(some):
                at = np.searchsorted(found, piece.keys)
                out.append(result(piece, counts[at], best[at]))
            return pa.concat_tables(out)

        return apply

    def has_whole(row: dict) -> bool:
        return len(row["ids"]) > row["goes_on"] + row["came_in"]

    def has_part(row: dict) -> bool:
        return row["goes_on"] or row["came_in"]

    block_schema = "pack long, row long, part int, keys binary, counts binary"
    asked = written(cut.groupBy("pack").applyInArrow(ask, block_schema), "pairs")
    shared = asked.where("row IS NOT NULL").groupBy("row").applyInArrow(once, block_schema)
    answers = (
        asked.where("row IS NULL")
        .union(shared)
        .groupBy("part")
        .applyInArrow(_counted, "pack long, part int, counts binary, best binary")
        .where("pack IS NOT NULL")
    )
    known = cut.groupBy("pack").cogroup(written(answers, "answers").groupBy("pack"))  # its exchanges are used twice
    whole = known.applyInArrow(answered(_whole, has_whole, DOC_SCHEMA), DOC_SCHEMA)
    parts = known.applyInArrow(answered(_parts, has_part, PART_SCHEMA), PART_SCHEMA)
    return whole.union(parts.groupBy("row").applyInArrow(_stitch, DOC_SCHEMA))
