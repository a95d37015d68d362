"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, then counted exactly.

Everything is per language. Texts fall into pieces at punctuation and line ends, pieces into words.

First pass: every pack sends its n-grams, as short hashes with their counts, to hash partitions. A
partition keeps a Misra-Gries summary: the blocks of the packs are merged two by two, and where the merged
one has more counters than its capacity, the largest counter that has no room is taken off all of them and those at or
below zero go. With more counters than the partition's mass divided by the threshold, what is taken off
stays below the threshold, so every n-gram that is frequent survives. Short hashes only add counts
to it. Longer n-grams are looked at where all shorter ones inside them survived.

Second pass: survivors are counted exactly by their 64-bit hashes, and the first pack that has one
spells it. The rest is relational: a phrase is joined to the counts of its parts at every cut, and to the
phrases one word longer.

Edge cases: a null or empty text, or one of separators only, has no words. A null language counts as ``und``
and shares it with documents that say so. Repeated rows count as often as they occur. A word is
kept as it is but for A-Z; words may be of any length. Other columns are not used.
"""

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import packs
from .memory import lean, lean_beside
from .words import _hashes, mixed, texts_of

#: Least occurrences of a phrase, words of the longest one, and phrases returned for each language.
LEAST = 100
LONGEST = 5
TOP = 2000
#: Orders of n-grams that are summarised together; each level needs what survived the one before.
LEVELS = ((1, 2), (3, 4, 5))
#: Bytes of text per pack.
PACK_BYTES = 2 << 20
#: Bits of a short hash beyond those of the number of n-grams.
SPARE_BITS = 8
#: Hexadecimal digits of the language's hash, before each text.
HEADER = 16
#: floor(1000 a n / (l r)). Products pass 64 bits; decimals of 38 digits hold them, and ``div`` drops the fraction.
SCORE = (
    "(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)))"
    " div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
)

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True
_DIGIT = np.zeros(256, np.uint64)
_DIGIT[[*b"0123456789ABCDEF"]] = np.arange(16)


class Phrases:
    """Words of a pack: byte range, hash within the language, piece; and its n-grams."""

    def __init__(self, table: pa.Table):
        data, offsets = texts_of(table.column("text"))
        self.data, n = data, len(data)
        begin = offsets[:-1]
        digits = _DIGIT[data[begin[:, None] + np.arange(HEADER)]] if len(begin) else np.zeros((0, HEADER), np.uint64)
        self.lang = np.zeros(len(begin), np.uint64)
        for k in range(HEADER):
            self.lang = self.lang << np.uint64(4) | digits[:, k]
        word = ~_APART[data]
        word[(begin[:, None] + np.arange(HEADER)).reshape(-1)] = False  # the header parts the texts as well
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        breaks = np.cumsum(_BREAK[data], dtype=np.int64)[self.start] if n else self.start
        self.piece = np.cumsum((np.diff(breaks, prepend=0) != 0) | (np.diff(self.doc, prepend=0) != 0))
        self.hash = mixed(_hashes(data, self.start, self.end, True) ^ self.lang[self.doc])
        self.alive: dict[int, np.ndarray] = {}

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first words) of the n-grams inside a piece whose known shorter n-grams are alive."""
        total = len(self.hash) - order + 1
        if total < 1:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        some = self.piece[:total] == self.piece[order - 1 :]
        shorter = max((n for n in self.alive if n < order), default=0)
        for k in range(order - shorter + 1 if shorter else 0):
            some &= self.alive[shorter][k : k + total]
        at = np.flatnonzero(some)
        value = np.full(len(at), order * 2 + 1, np.uint64)
        for k in range(order):
            value = mixed(value * np.uint64(0x9FB21C651E98DF25) + self.hash[at + k])
        return value, at

    def level(self, orders, mask: np.uint64):
        """Sorted distinct short hashes of the n-grams of a level with their counts, and how to go on once it is known which survive."""
        found = [self.grams(order) for order in orders]
        keys, back, counts = np.unique(
            np.concatenate([h for h, _ in found]) & mask, return_inverse=True, return_counts=True
        )

        def survive(flags: np.ndarray):
            kept = flags[back]
            at = 0
            for order, (hashes, first) in zip(orders, found, strict=True):
                self.alive[order] = np.zeros(len(self.hash), bool)
                self.alive[order][first[kept[at : at + len(hashes)]]] = True
                at += len(hashes)

        return keys, counts, survive

    def survivors(self):
        """(hashes, first words, orders) of all n-grams that survived."""
        out = []
        for order, alive in sorted(self.alive.items()):
            at = np.flatnonzero(alive)
            value = np.full(len(at), order * 2 + 1, np.uint64)
            for k in range(order):
                value = mixed(value * np.uint64(0x9FB21C651E98DF25) + self.hash[at + k])
            out.append((value, at, np.full(len(at), order)))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def spelled(self, first: int, order: int) -> str:
        words = (self.data[a:b].tobytes() for a, b in zip(self.start[first : first + order], self.end[first : first + order], strict=True))
        return b" ".join(words).lower().decode()  # lower() of bytes changes A-Z only


def summary(keys: np.ndarray, counts: np.ndarray, capacity: int):
    """Misra-Gries: at most ``capacity`` counters; the largest that has no room is taken off all others."""
    if len(keys) <= capacity:
        return keys, counts
    off = np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
    keep = counts > off
    return keys[keep], counts[keep] - off


def merged(a, b, capacity: int):
    """Merge of two summaries over different rows."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([a[1], b[1]])[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return summary(keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts, capacity)


def heavy(blocks, least: int) -> np.ndarray:
    """Sorted keys that survive the merge of ``blocks`` (sorted keys, counts); all of ``least`` or more occurrences are among them."""
    capacity = int(sum(int(counts.sum()) for _, counts in blocks)) // least + 1
    level = [summary(*block, capacity) for block in blocks]
    while len(level) > 1:
        level = [merged(*level[k : k + 2], capacity) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0][0]


def _blocks(table: pa.Table):
    keys = [np.cumsum(packs.restored(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    return list(zip(keys, [packs.restored(x, np.int64) for x in table.column("counts").to_pylist()], strict=True))


def _sent(table: pa.Table, keys: np.ndarray, counts: np.ndarray, n: int) -> pa.Table:
    """Rows (pack, part, keys, counts) of a pack's sorted keys, one for each hash range that has any."""
    at = packs.range_starts(keys, n)
    pack = table.column("pack")[0].as_py() if table.num_rows else 0
    parts = np.flatnonzero(np.diff(at))
    blocks = [(packs.squeezed(packs.differences(keys[a:b])), packs.squeezed(counts[a:b].astype(np.int64))) for a, b in zip(at[parts], at[parts + 1], strict=True)]
    return pa.table(
        {
            "pack": pa.array([pack] * len(parts), pa.int32()),
            "part": pa.array(parts, pa.int32()),
            "keys": pa.array([k for k, _ in blocks], pa.binary()),
            "counts": pa.array([c for _, c in blocks], pa.binary()),
        }
    )


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(code, size, phrase, f): phrases of 1 to ``longest`` words and at least ``least`` occurrences in their
    language, whose hash is ``code``; and, with size 0, the words of each language in a pack."""
    levels = [tuple(n for n in orders if n <= longest) for orders in LEVELS]
    levels = [orders for orders in levels if orders]
    header = F.lpad(F.hex(F.xxhash64(F.coalesce("lang", F.lit("und")))), HEADER, "0")
    rows, n = packs.packed(docs.select("doc_id", F.concat(header, F.coalesce("text", F.lit(""))).alias("text")), pack_bytes)
    bits = min(64, math.ceil(math.log2(n * pack_bytes)) + SPARE_BITS)
    mask = np.uint64(((1 << 64) - 1) & ~((1 << (64 - bits)) - 1))

    def opened(table: pa.Table, answers: pa.Table | None, done: int) -> Phrases:
        """The pack's words, with what survived of the first ``done`` levels."""
        phrases = Phrases(table)
        for k in range(done):
            keys, _, survive = phrases.level(levels[k], mask)
            some = answers.filter(pa.compute.equal(answers.column("level"), k))
            flags, at = np.zeros(len(keys), bool), packs.range_starts(keys, n)
            for part, found in zip(some.column("part").to_pylist(), some.column("found").to_pylist(), strict=True):
                size = at[part + 1] - at[part]
                flags[at[part] : at[part + 1]] = np.unpackbits(np.frombuffer(zstandard.decompress(found), np.uint8))[:size]
            survive(flags)
        return phrases

    def survive(level: int):
        @lean
        def of_range(table: pa.Table) -> pa.Table:
            blocks = _blocks(table)
            kept = heavy(blocks, least)
            found = [_among(keys, kept) for keys, _ in blocks]
            return pa.table(
                {
                    "pack": table.column("pack"),
                    "part": table.column("part"),
                    "level": pa.array([level] * len(found), pa.int32()),
                    "found": pa.array([zstandard.compress(np.packbits(x).tobytes(), 1) for x in found], pa.binary()),
                }
            )

        return of_range

    sent_schema = "pack int, part int, keys binary, counts binary"
    answer_schema = "pack int, part int, level int, found binary"


    def send(level: int):
        @lean_beside
        def of_pack(table: pa.Table, known: pa.Table | None) -> pa.Table:
            keys, counts, _ = opened(table, known, level).level(levels[level], mask)
            return _sent(table, keys, counts, n)

        return of_pack

    first_level = send(0)
    sent = rows.groupBy("pack").applyInArrow(lambda bundles: first_level(packs.opened(bundles), None), sent_schema)
    answers = written(sent.groupBy("part").applyInArrow(survive(0), answer_schema), "survivors")
    for level in range(1, len(levels)):
        sent = packs.beside(rows, answers, send(level), sent_schema)
        found = written(sent.groupBy("part").applyInArrow(survive(level), answer_schema), "survivors")
        answers = answers.union(found)

    @lean_beside
    def exact(table: pa.Table, known: pa.Table) -> pa.Table:
        hashes, _, _ = opened(table, known, len(levels)).survivors()
        return _sent(table, *np.unique(hashes, return_counts=True), n)

    @lean
    def count(table: pa.Table) -> pa.Table:
        """Exact counts of frequent phrases for the first pack that has them, 0 for the others."""
        order = np.argsort(table.column("pack").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        blocks = _blocks(table)
        every, first, back = np.unique(np.concatenate([k for k, _ in blocks]), return_index=True, return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, back, np.concatenate([c for _, c in blocks]))
        answer = np.zeros(len(back), np.int64)
        answer[first] = np.where(total >= least, total, 0)
        stops = np.cumsum([len(k) for k, _ in blocks])[:-1]
        return pa.table(
            {
                "pack": table.column("pack"),
                "part": table.column("part"),
                "level": pa.array([len(levels)] * table.num_rows, pa.int32()),
                "found": pa.array([packs.squeezed(x) for x in np.split(answer, stops)], pa.binary()),
            }
        )

    @lean_beside
    def spell(table: pa.Table, known: pa.Table) -> pa.Table:
        phrases = opened(table, known, len(levels))
        hashes, at, orders = phrases.survivors()
        _, sample = np.unique(hashes, return_index=True)
        total = packs.counts_in_order(known.filter(pa.compute.equal(known.column("level"), len(levels))))
        mine = np.flatnonzero(total)
        langs, words = np.unique(phrases.lang[phrases.doc], return_counts=True)
        first = at[sample[mine]]
        size = orders[sample[mine]]
        texts = [phrases.spelled(int(a), int(m)) for a, m in zip(first, size, strict=True)]
        return pa.table(
            {
                "code": pa.array(np.concatenate([phrases.lang[phrases.doc[first]], langs]).view(np.int64)),
                "size": pa.array(np.concatenate([size, np.zeros(len(langs), np.int64)]), pa.int32()),
                "phrase": pa.array(texts + [""] * len(langs), pa.string()),
                "f": pa.array(np.concatenate([total[mine], words]), pa.int64()),
            }
        )

    asked = packs.beside(rows, answers, exact, sent_schema)
    counts = written(asked.groupBy("part").applyInArrow(count, answer_schema), "exact")
    return packs.beside(rows, answers.union(counts), spell, "code long, size int, phrase string, f long")


def _among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(keys), bool)
    return found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, pack_bytes: int = PACK_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    known = written(frequent(docs.select("doc_id", "text", "lang"), least, longest, pack_bytes), "phrases")
    totals = known.where("size = 0").groupBy("code").agg(F.sum("f").alias("n"))
    parts = known.where("size > 0").select("code", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    candidates = known.where("size > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "code",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("tail"),
    )
    heads = parts.withColumnsRenamed({"part": "head", "part_f": "l"})
    tails = parts.withColumnsRenamed({"part": "tail", "part_f": "r"})
    scored = (
        cut.join(heads, ["code", "head"])
        .join(tails, ["code", "tail"])
        .join(totals, "code")
        .groupBy("code", "phrase", "a", "n")
        .agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("least"))
    )
    # A phrase inside a longer one that is as frequent is also inside one that is one word longer.
    longer = F.explode(
        F.array_distinct(
            F.array(
                F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "),
                F.array_join(F.slice(words, F.lit(2), F.col("size")), " "),
            )
        )
    )
    held = (
        candidates.where("size > 2")
        .select("code", longer.alias("phrase"), F.col("a").alias("held_f"))
        .groupBy("code", "phrase")
        .agg(F.max("held_f").alias("held_f"))
    )
    alone = scored.join(held, ["code", "phrase"], "left").where("held_f IS NULL OR held_f < a")
    langs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang")).distinct()
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        alone.join(langs.withColumn("code", F.xxhash64("lang")), "code")
        .select("lang", "phrase", "a", "n", "least.score", "least.l", "least.r")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
