"""N-gram Jaccard join: size-aware, with small sets by subsets and large sets by inverted lists.

Sets are distinct word shingles. Two sets link when their Jaccard similarity reaches a threshold.
All shingles are ordered by document frequency, rarest first. Similar sets must share k of their
first |x| - ceil(t |x|) + k shingles, so

* a small set is indexed under every pair of the first shingles with k = 2,
* a large set is put on the list of each of the first shingles with k = 1.

The boundary size is where subset keys and list entries cost least; sets just below it are on the
lists as well, so that no pair across it is lost. Shingles of one document only can't be shared and make
no keys. Equal sets are one class, named by its fingerprint, and joined once.

Keys are never rows of their own. A pack of sets sends each distinct key once, with its least set, to the
key's hash range, and gets back the least set that any pack has for it: the key's hub. Sets with a
common hub belong to one cluster. Clusters are compared in blocks, every pair of
blocks in a task of its own, so a large group of near copies is split and no list of
pairs is ever made: a task returns links as one row per set.

Edge cases: a null or empty text has no shingles and links with nothing; its component is its own id.
A text with fewer words than a shingle is one shingle. Rows with a null id take the component of
their equal texts, if any has an id. Repeated rows are members of their class. Other columns are not used.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from . import packs
from .graph import components
from .memory import lean, lean_beside
from .words import Words, grams, mixed, words_of

SHINGLE = 4
PERCENT = 85
#: Sets per block of a cluster: a share of the cluster within these limits.
BLOCK_LEAST, BLOCK_MOST, BLOCKS = 128, 1024, 24
#: Shingles counted at once when blocks are compared.
COLUMNS = 4096
#: What a list entry costs in subset keys: it also meets sets that share one rare shingle by chance.
LIST_COST = 2
#: Keys and list entries per pack of sets.
PACK_KEYS = 400_000


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all documents, and (document, index of shingle) pairs in order."""
    hashes, at = grams(words, n, seed=n)
    found, docs = [hashes], [words.doc[at]]
    lengths = np.diff(words.first)
    for short in range(1, n):
        whole = np.flatnonzero(lengths == short)
        if len(whole):
            hashes, at = grams(words, short, seed=short)
            keep = np.isin(at, words.first[whole])
            keep &= lengths[words.doc[at]] == short
            found.append(hashes[keep])
            docs.append(words.doc[at[keep]])
    every, back = np.unique(np.concatenate(found), return_inverse=True)
    width = max(len(every), 1)
    pair = np.unique(np.concatenate(docs).astype(np.int64) * width + back)
    return every, pair // width, pair % width


def _needed(n, percent: int):
    """Least number of shingles that a set of ``n`` shares with any similar set."""
    return -(-percent * n // 100)


def described(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n, f1, f2, lone, tokens): set size, 128-bit fingerprint, how many shingles no other
    document has, and the other ones from rare to common; tokens are null if the set can't link."""

    @lean
    def keys(table: pa.Table):
        every, _, index = shingle_sets(words_of(table.column("text"), lower=True), shingle)
        return every, np.bincount(index, minlength=len(every))

    @lean_beside
    def describe(table: pa.Table, tallied: pa.Table) -> pa.Table:
        every, doc, index = shingle_sets(words_of(table.column("text"), lower=True), shingle)
        df = packs.counts_in_order(tallied).astype(np.int64)[index]
        hashes = every[index]
        n_docs = table.num_rows
        order = np.lexsort((hashes, df, doc))
        doc, df, hashes = doc[order], df[order], hashes[order]
        n = np.bincount(doc, minlength=n_docs)
        lone = np.bincount(doc[df == 1], minlength=n_docs)
        sums = []
        for salt in (0x51ED270B, 0x2545F491):
            total = np.zeros(n_docs, np.uint64)
            np.add.at(total, doc, mixed(hashes ^ np.uint64(salt)))
            sums.append(total.view(np.int64))
        can = n - _needed(n, percent) + 1 - lone >= 1
        keep = (df > 1) & can[doc]
        lists = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=n_docs))])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n": pa.array(n, pa.int64()),
                "f1": pa.array(sums[0]),
                "f2": pa.array(sums[1]),
                "lone": pa.array(lone, pa.int64()),
                "tokens": pa.ListArray.from_arrays(
                    pa.array(lists, pa.int32(), mask=np.append(~can | (np.diff(lists) == 0), False)),
                    pa.array(hashes[keep].view(np.int64)),
                ),
            }
        )

    rows, n = packs.packed(docs)
    return packs.beside(
        rows,
        packs.tally(rows, n, keys),
        describe,
        "doc_id long, n long, f1 long, f2 long, lone long, tokens array<long>",
    )


def _boundary(sets: DataFrame, percent: int) -> int:
    """Largest size of a small set: where subset keys of small and list entries of large sets cost least."""
    first = F.col("first")
    costs = (
        sets.groupBy(F.floor(4 * F.log2("n")).alias("step"))
        .agg(F.sum(first * (first + 1) / 2).alias("subsets"), F.sum(first).alias("entries"))
        .collect()
    )  # a row per quarter of a power of two
    best, least = 0, math.inf
    for border in [-1, *sorted(r["step"] for r in costs)]:
        size = math.ceil(2 ** ((border + 1) / 4)) - 1
        low = percent * size / 100
        cost = sum(r["subsets"] for r in costs if r["step"] <= border)
        cost += LIST_COST * sum(r["entries"] for r in costs if 2 ** ((r["step"] + 1) / 4) > low)
        if cost <= least:
            best, least = size, cost
    return best


def _keys(table: pa.Table, border: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Subset keys of small sets and list keys of large ones, and the set of each."""
    ids, n, first = (table.column(c).to_numpy() for c in ("id", "n", "first"))
    lists = table.column("tokens").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
    begin, size = at[:-1] - at[0], np.minimum(np.diff(at), first + 1)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(n <= border)
    for j in range(1, int(size[small].max(initial=0))):
        small = small[size[small] > j]
        for i in range(j):
            pair = flat[begin[small] + i] * np.uint64(0x9FB21C651E98DF25) + flat[begin[small] + j]
            keys.append(mixed(pair + np.uint64(1)))
            owners.append(ids[small])
    large = np.flatnonzero(n * 100 > border * percent)
    size = np.minimum(size, first)[large]
    ends = np.cumsum(size)
    index = np.repeat(begin[large] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return np.concatenate([*keys, mixed(flat[index])]), np.concatenate([*owners, np.repeat(ids[large], size)])


def _hubs(sets: DataFrame, border: int, percent: int) -> DataFrame:
    """(id, hub): distinct pairs of a set and the least set with which it shares a key."""
    first = F.col("first")
    pairs = F.when(F.col("n") <= border, first * (first + 1) / 2).otherwise(0)
    entries = F.when(F.col("n") * 100 > border * percent, first).otherwise(0)
    total = sets.agg(F.sum(pairs + entries)).first()[0] or 0
    n = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PACK_KEYS))
    dealt = sets.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("pack"), "id", "n", "first", "tokens")

    def least_first(table: pa.Table):
        """Sorted distinct keys of a pack and the least set of each."""
        keys, owners = _keys(table, border, percent)
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        return keys[new], owners[new]

    @lean
    def send(table: pa.Table) -> pa.Table:
        keys, least = least_first(table)
        at = packs.range_starts(keys, n)
        parts = np.flatnonzero(np.diff(at))
        pack = table.column("pack")[0].as_py() if table.num_rows else 0
        blocks = [(packs.squeezed(packs.differences(keys[a:b])), packs.squeezed(least[a:b])) for a, b in zip(at[parts], at[parts + 1], strict=True)]
        return pa.table(
            {
                "pack": pa.array([pack] * len(parts), pa.int32()),
                "part": pa.array(parts, pa.int32()),
                "keys": pa.array([k for k, _ in blocks], pa.binary()),
                "least": pa.array([x for _, x in blocks], pa.binary()),
            }
        )

    @lean
    def meet(table: pa.Table) -> pa.Table:
        """The least set of each key over all packs, given back in the order sent, as what must be added to the own one."""
        blocks = [np.cumsum(packs.restored(b, np.uint64), dtype=np.uint64) for b in table.column("keys").to_pylist()]
        least = np.concatenate([packs.restored(b, np.int64) for b in table.column("least").to_pylist()])
        found, back = np.unique(np.concatenate(blocks), return_inverse=True)
        hub = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(hub, back, least)
        below = (hub[back].view(np.uint64) - least.view(np.uint64)).view(np.int64)  # mostly 0, and may wrap
        stops = np.cumsum([len(b) for b in blocks])[:-1]
        return pa.table(
            {
                "pack": table.column("pack"),
                "part": table.column("part"),
                "hub": pa.array([packs.squeezed(x) for x in np.split(below, stops)], pa.binary()),
            }
        )

    @lean_beside
    def edges(table: pa.Table, answers: pa.Table) -> pa.Table:
        found, least = least_first(table)
        order = np.argsort(answers.column("part").to_numpy())
        blobs = answers.column("hub").to_pylist()
        below = np.concatenate([np.zeros(0, np.int64), *(packs.restored(blobs[k], np.int64) for k in order)])
        hubs = (least.view(np.uint64) + below.view(np.uint64)).view(np.int64)
        keys, owners = _keys(table, border, percent)
        hub = hubs[np.searchsorted(found, keys)]
        pair = np.unique(np.stack([owners, hub])[:, owners != hub], axis=1)
        return pa.table({"a": pa.array(pair[0]), "b": pa.array(pair[1])})

    sent = dealt.groupBy("pack").applyInArrow(send, "pack int, part int, keys binary, least binary")
    answers = sent.groupBy("part").applyInArrow(meet, "pack int, part int, hub binary")
    return dealt.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(edges, "a long, b long")


def _compare(percent: int):
    @lean
    def compare(table: pa.Table) -> pa.Table:
        """Links among the sets of one pair of blocks: each set's number of linked rows and a link root."""
        ids = table.column("id").to_numpy()
        block = table.column("block").to_numpy()
        n = table.column("n").to_numpy()
        weight = table.column("weight").to_numpy()
        lists = table.column("tokens").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        _, token, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = seen[token] > 1
        token, owner = np.unique(token[shared], return_inverse=True)[1], owner[shared]
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        common = np.zeros((len(ids), len(ids)), np.float32)
        for low in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
            a, b = np.searchsorted(token, [low, low + COLUMNS])
            has = np.zeros((len(ids), COLUMNS), np.float32)
            has[owner[a:b], token[a:b] - low] = 1
            common += has @ has.T
        both = common.astype(np.int64)
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        if len(np.unique(block)) > 1:
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
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


def joined(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    Links are at least ``percent`` per cent Jaccard similar; n_links counts the other rows linked.
    """
    rows = written(described(docs, percent, shingle), "sets")
    same = ["n", "f1", "f2"]
    # A class is named by its fingerprint, so ids that stand on several rows don't mix classes.
    classes = written(
        rows.where(F.col("n") > 0)
        .groupBy(*same)
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("weight"))
        .withColumn("id", F.xxhash64(*same)),
        "classes",
    )
    # One row of each class; copies have other ids and don't meet here.
    sets = written(
        rows.where(F.col("tokens").isNotNull())
        .join(classes, [*(rows[c] == classes[c] for c in same), rows["doc_id"] == classes["least"]])
        .select(
            classes["id"],
            rows["n"],
            "weight",
            (rows["n"] - F.ceil(rows["n"] * percent / F.lit(100)) + 1 - F.col("lone")).alias("first"),
            "tokens",
        )
        .dropDuplicates(["id"]),
        "candidates",
    )
    near = _hubs(sets, _boundary(sets, percent), percent)
    clusters = written(components(near), "clusters")
    size = F.col("count")
    block_size = F.least(F.greatest(size / BLOCKS, F.lit(BLOCK_LEAST)), F.lit(BLOCK_MOST))
    sizes = written(
        clusters.groupBy("component").count().withColumn("blocks", F.ceil(size / block_size)).drop("count"), "sizes"
    )
    placed = clusters.join(sizes, "component").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    links = written(
        sets.drop("first")
        .join(placed, "id")
        .withColumn("other", other)
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select("component", "low", "high", "block", "id", "n", "weight", "tokens")
        .groupBy("component", "low", "high")
        .applyInArrow(_compare(percent), "id long, root long, links long"),
        "links",
    )
    groups = written(components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))), "groups")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    # Components are named by their smallest document.
    named = groups.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("first_doc"))
    known = written(
        classes.join(groups.join(named, "component"), "id", "left")
        .join(counts, "id", "left")
        .select(
            *same,
            F.coalesce("first_doc", "least").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        ),
        "known",
    )
    return rows.join(known, same, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )
