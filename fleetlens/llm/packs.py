"""Documents in packs, and hash tallies over all packs.

A pack is a set of documents small enough for one task, chosen by hash. A tally counts 64-bit keys
over all packs: every pack sorts its distinct keys and sends one block per hash range in which it has
any; every range counts its blocks and sends the counts back in the same order, so no key travels
twice and nothing is joined key by key. There are never more blocks than keys. Within a pack a key is counted before it is sent, so a key that a
third of all documents share costs each pack one entry and no range more than one per pack.
"""

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import texts_of

#: Bytes of text per pack and, on average, per hash range; a task needs up to 60 times as much memory.
PACK_BYTES = 3 << 20


def packed(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> tuple[DataFrame, int]:
    """Bundles (pack, ids, sizes, text) of documents, and the number of packs, which grows with the bytes of text.

    A task bundles the documents that it has for a pack, so that their texts are compressed together
    before they are shuffled. A null text counts as empty. ``opened`` gives the documents of bundles.
    """
    text = F.col("text")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(at_least, math.ceil(total / pack_bytes))
    pack = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")

    def bundle(batches):
        for batch in batches:
            batch = batch.take(pa.compute.sort_indices(batch.column("pack")))
            packs_ = batch.column("pack").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], packs_[1:] != packs_[:-1]])) if len(packs_) else []
            rows = [batch.slice(a, b - a) for a, b in zip(starts, [*starts[1:], len(packs_)], strict=False)]
            texts = [texts_of(r.column("text")) for r in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "pack": pa.array([r.column("pack")[0].as_py() for r in rows], pa.int32()),
                    "ids": pa.array([r.column("doc_id").to_pylist() for r in rows], pa.list_(pa.int64())),
                    "sizes": pa.array([np.diff(at) for _, at in texts], pa.list_(pa.int64())),
                    "text": pa.array([zstandard.compress(t.tobytes(), 1) for t, _ in texts], pa.binary()),
                }
            )

    rows = docs.select(pack.alias("pack"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(bundle, "pack int, ids array<long>, sizes array<long>, text binary"), n


def opened(bundles: pa.Table) -> pa.Table:
    """(pack, doc_id, text) of the documents of bundles."""
    ids = [x for row in bundles.column("ids").to_pylist() for x in row]
    sizes = [x for row in bundles.column("sizes").to_pylist() for x in row]
    offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
    data = b"".join(zstandard.decompress(x) for x in bundles.column("text").to_pylist())
    text = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    number = bundles.column("pack")[0].as_py() if len(ids) else 0
    return pa.table(
        {"pack": pa.array([number] * len(ids), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "text": text}
    )


def squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; sorted ones shrink most if given as differences."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def restored(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def differences(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0)) if len(keys) else keys


def range_starts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal hash ranges begins among sorted keys, with their number at the end."""
    borders = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]]).astype(np.int64)


def tally(
    packs: DataFrame, n: int, keys: Callable[..., tuple[np.ndarray, np.ndarray]], known: DataFrame | None = None
) -> DataFrame:
    """(pack, part, found): of each pack the counts over all packs of its keys in one range.

    ``keys`` gives the sorted distinct keys of a pack and the count of each in the pack. It must
    give the same for the same rows. With ``known``, an earlier tally, it gets the pack's rows of that as well.
    """

    def send(table: pa.Table, *tallied: pa.Table) -> pa.Table:
        # The order of rows may differ when a task runs again; the sorted keys don't depend on it.
        found, counts = keys(table, *tallied)
        at = range_starts(found, n)
        pack = table.column("pack")[0].as_py() if table.num_rows else 0
        parts = np.flatnonzero(np.diff(at))
        rows = [
            (squeezed(differences(found[a:b])), squeezed(counts[a:b].astype(np.int64)))
            for a, b in zip(at[parts], at[parts + 1], strict=True)
        ]
        return pa.table(
            {
                "pack": pa.array([pack] * len(parts), pa.int32()),
                "part": pa.array(parts, pa.int32()),
                "keys": pa.array([k for k, _ in rows], pa.binary()),
                "counts": pa.array([c for _, c in rows], pa.binary()),
            }
        )

    def count(table: pa.Table) -> pa.Table:
        blocks = [np.cumsum(restored(b, np.uint64), dtype=np.uint64) for b in table.column("keys").to_pylist()]
        counts = [restored(b, np.int64) for b in table.column("counts").to_pylist()]
        every = np.concatenate(blocks)
        order = np.argsort(every)
        ranked = every[order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else []
        sums = np.add.reduceat(np.concatenate(counts)[order], begins) if len(ranked) else []
        back = np.empty(len(every), np.int64)  # zero high bytes shrink to almost nothing
        if len(ranked):
            back[order] = np.repeat(sums, np.diff(np.append(begins, len(ranked))))
        stops = np.cumsum([len(b) for b in blocks])[:-1]
        return pa.table(
            {
                "pack": table.column("pack"),
                "part": table.column("part"),
                "found": pa.array([squeezed(x) for x in np.split(back, stops)], pa.binary()),
            }
        )

    schema = "pack int, part int, keys binary, counts binary"
    if known is None:
        sent = packs.groupBy("pack").applyInArrow(lambda bundles: send(opened(bundles)), schema)
    else:
        sent = beside(packs, known, lambda table, tallied: send(table, tallied), schema)
    return sent.groupBy("part").applyInArrow(count, "pack int, part int, found binary")


def counts_in_order(table: pa.Table) -> np.ndarray:
    """Counts of a pack's sorted keys from its rows of a tally."""
    order = np.argsort(table.column("part").to_numpy())
    blobs = table.column("found").to_pylist()
    found = [restored(blobs[i], np.int64) for i in order]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def beside(packs: DataFrame, other: DataFrame, function, schema: str) -> DataFrame:
    """``function(pack's documents, pack's rows of other)`` for every pack."""

    def apply(bundles: pa.Table, rows: pa.Table) -> pa.Table:
        return function(opened(bundles), rows)

    return packs.groupBy("pack").cogroup(other.groupBy("pack")).applyInArrow(apply, schema)
