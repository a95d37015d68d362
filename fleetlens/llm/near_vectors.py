"""Embedding near-dedup with spherical-cap filters.

The filters are the directions of random product codes: after a random rotation the space is cut
into blocks, each with some random unit vectors, and every choice of one vector per block is a filter.
Several codes, each with its own rotation, make the filters less dependent than one large code does. A
vector is list-decoded to all filters whose inner product with it exceeds a threshold: partial
sums over the blocks are extended only while the best possible rest still reaches it. Vectors of
a filter are compared exactly, in double precision.

The number of filters grows with the number of vectors, so a filter's list stays short. The
threshold is fitted on random pairs at exactly the least similarity, so that at most ``MISSES`` of them
share no filter; closer pairs are missed far less. Because the code is random, that holds whatever
the data. A pair that shares several filters counts under the smallest. Long lists are cut into
blocks, and every pair of blocks is a task. Equal vectors are one class and compared once.

Vectors of different lengths have codes and filters of their own.

Edge cases: vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing.
Vectors link with those of their own length only, whatever their size. Rows with a null id link with nothing, have a null component and are
not kept. Repeated rows are members of their class and count as links. Other columns are not used.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .graph import components

COSINE = 0.9
BLOCKS = 2
CODES = 16
#: Filters per vector in the table, and the share of pairs at the least similarity that may be missed.
FILTERS_PER_VECTOR = 1 / 3
LEAST_FILTERS = 512
MISSES = 0.005
TRIALS = 1000
SEED = 11
#: Vectors per block of a long list.
LIST_BLOCK = 256


class ProductCodes:
    """``codes`` product codes, each of ``size`` to the power of ``blocks`` directions in ``dims`` dimensions."""

    def __init__(self, dims: int, size: int, blocks: int = BLOCKS, codes: int = CODES, seed: int = SEED):
        random = np.random.Generator(np.random.PCG64(seed))
        blocks = max(1, min(blocks, dims))
        cuts = [dims * k // blocks for k in range(blocks + 1)]
        self.ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.codes = []
        for _ in range(codes):
            rotation = np.linalg.qr(random.standard_normal((dims, dims)))[0]
            parts = [random.standard_normal((size, b - a)) for a, b in self.ranges]
            parts = [p / np.linalg.norm(p, axis=1, keepdims=True) / math.sqrt(blocks) for p in parts]
            self.codes.append((rotation, parts))
        self.dims, self.size, self.threshold = dims, size, 0.0
        self.filters = codes * size**blocks

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that exceed the threshold, by row."""
        found = [self._decode(unit, code, k) for k, code in enumerate(self.codes)]
        row, name = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], name[order]

    def _decode(self, unit: np.ndarray, code, number: int) -> tuple[np.ndarray, np.ndarray]:
        rotation, codewords = code
        turned = unit @ rotation
        parts = [turned[:, a:b] @ words.T for (a, b), words in zip(self.ranges, codewords, strict=True)]
        rest = np.zeros(len(unit))
        bounds = []  # for each block the best that the later blocks can add
        for part in reversed(parts):
            bounds.append(rest)
            rest = rest + part.max(axis=1, initial=-np.inf)
        row, sums, name = np.arange(len(unit)), np.zeros(len(unit)), np.full(len(unit), number, np.int64)
        for part, bound in zip(parts, reversed(bounds), strict=True):
            first = part.max(axis=1, initial=-np.inf)
            open_rows = sums + first[row] + bound[row] >= self.threshold
            row, sums, name = row[open_rows], sums[open_rows], name[open_rows]
            total = sums[:, None] + part[row]
            at, pick = np.nonzero(total >= (self.threshold - bound[row])[:, None])
            sums, name, row = total[at, pick], name[at] * self.size + pick, row[at]
        return row, name

    def fit(self, cosine: float, misses: float = MISSES) -> "ProductCodes":
        """Set the largest threshold, in steps, at which random pairs at ``cosine`` share a filter often enough."""
        random = np.random.Generator(np.random.PCG64(SEED + 1))
        dims = self.dims
        x, y = random.standard_normal((2, TRIALS, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * y
        self.threshold = 4.5 / math.sqrt(dims)
        while True:
            pairs = [np.stack(self.decode(v)) for v in (x, y)]
            keys = [p[0] * self.filters + p[1] for p in pairs]
            met = np.unique(pairs[0][0][np.isin(keys[0], keys[1])])
            if 1 - len(met) / TRIALS <= misses or self.threshold < 0.5 / math.sqrt(dims):
                return self
            self.threshold *= 0.97


def _unit(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    with np.errstate(over="ignore"):
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
    odd = ~((norm > 1e-150) & (norm < 1e150))[:, 0]
    if odd.any():  # squares that leave the range of doubles
        rows = rows.copy()
        rows[odd] /= np.abs(rows[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.linalg.norm(rows[odd], axis=1, keepdims=True)
    return rows / norm


def _compare(cosine: float):
    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        weight = table.column("weight").to_numpy()
        block = table.column("block").to_numpy()
        here = table.column("filter")[0].as_py()
        unit = _unit(table.column("embedding"))
        linked = unit @ unit.T >= cosine
        if len(np.unique(block)) > 1:
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        lists = table.column("filters").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy()
        some = linked.any(axis=1)
        earlier = (flat < here) & some[owner]
        if earlier.any():
            # Pairs that share a smaller filter are counted there.
            _, column = np.unique(flat[earlier], return_inverse=True)
            for low in range(0, int(column.max()) + 1, 4096):
                mine = (column >= low) & (column < low + 4096)
                has = np.zeros((len(ids), 4096), np.float32)
                has[owner[earlier][mine], column[mine] - low] = 1
                linked &= has @ has.T == 0
        root = np.arange(len(ids))
        while True:
            least = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(axis=1, initial=len(ids)))
            least = least[least]
            if (least == root).all():
                break
            root = least
        some = linked.any(axis=1)
        return pa.table(
            {
                "id": pa.array(ids[some]),
                "root": pa.array(ids[root[some]]),
                "links": pa.array((linked @ weight)[some].astype(np.int64)),
            }
        )

    return compare


def linked(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    good = F.col("vec_id").isNotNull() & finite & F.exists(e, lambda x: x != 0)
    lengths = rows.where(good).groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()
    if not lengths:
        none = F.lit(0).cast("long").alias("n_links")
        return vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), none,
            F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"),
        )
    codes, first = {}, 0
    for dims, count in lengths:
        if count > 1:  # a single vector of its length has no partner
            per_code = max(LEAST_FILTERS, count * FILTERS_PER_VECTOR) / CODES
            code = ProductCodes(dims, max(2, math.ceil(per_code ** (1 / BLOCKS)))).fit(cosine)
            codes[dims] = code, first
            first += code.filters

    same = ["h1", "h2"]
    usable = F.coalesce(good, F.lit(False))
    hashed = rows.select(
        "vec_id",
        "embedding",
        *(F.when(usable, F.xxhash64(F.lit(k), "embedding")).alias(h) for k, h in enumerate(same)),
    )
    classes = written(
        hashed.where(F.col("h1").isNotNull())
        .groupBy(*same)
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")),
        "vectors",
    )

    def decode(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            found = [np.zeros((2, 0), np.int64)]
            for dims in np.unique(sizes):
                if int(dims) in codes:
                    code, first = codes[int(dims)]
                    mine = np.flatnonzero(sizes == dims)
                    row, name = code.decode(_unit(lists.take(pa.array(mine))))
                    found.append(np.stack([mine[row], name + first]))
            row, name = np.concatenate(found, axis=1)
            order = np.argsort(row, kind="stable")
            row, name = row[order], name[order]
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "filters": pa.ListArray.from_arrays(pa.array(offsets), pa.array(name))}
            )

    listed = written(classes.select("id", "embedding").mapInArrow(decode, "id long, filters array<long>"), "filters")
    entries = listed.select("id", F.explode("filters").alias("filter"))
    sizes = entries.groupBy("filter").count().where("count > 1")
    blocks = written(sizes.select("filter", F.ceil(F.col("count") / LIST_BLOCK).cast("int").alias("blocks")), "lists")
    places = entries.join(blocks, "filter").groupBy("id").agg(F.collect_list(F.struct("filter", "blocks")).alias("in"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    links = written(
        classes.drop(*same)
        .join(listed, "id")
        .join(places, "id")
        .select("id", "weight", "embedding", "filters", F.inline("in"))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "filter",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block", "id", "weight", "embedding", "filters",
        )
        .groupBy("filter", "low", "high")
        .applyInArrow(_compare(cosine), "id long, root long, links long"),
        "links",
    )
    groups = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = written(
        classes.drop("embedding")
        .join(groups, "id", "left")
        .join(counts, "id", "left")
        .select(
            *same,
            F.coalesce("component", "id").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        ),
        "known",
    )
    component = F.coalesce("component", "vec_id")
    return hashed.drop("embedding").join(known, same, "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
