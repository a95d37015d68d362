"""Language-model scores with stupid backoff.

The score of a word after its two predecessors is c(abc) / c(ab) if the trigram is in the table,
else 0.4 times c(bc) / c(b) if the bigram is, else 0.16 times c(c) over the number of all words.
Counts are over all documents. Tables of bigrams and trigrams keep n-grams seen at least
``MIN_COUNT`` times, so a document's own single occurrence is no evidence for it.

N-grams are hashed to 64 bits and counted by hash ranges (see ``packs``); the counts are joined to
the n-grams of each document and the logarithms summed per document. Longer n-grams are only counted
where all their bigrams are in the table, since others can't be seen often enough either.

Edge cases: a null or empty text has 0 words, sum 0 and a null mean. Repeated rows count as often
as they occur and score alike. Null ids are kept. Other columns are not used.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packs
from .common import n_words
from .words import Words, grams, words_of

ORDER = 3
MIN_COUNT = 2
BACKOFF = 0.4
SCHEMA = "doc_id long, n_words long, log10_sum double, log10_mean double, n_longest long, n_backed_off long"


def _short(words: Words, order: int):
    """Unigrams and bigrams: (hashes, first words) of each, all distinct hashes, and where each is among them."""
    each = [grams(words, n, seed=n) for n in range(1, min(order, 2) + 1)]
    found, back, counts = np.unique(
        np.concatenate([h for h, _ in each]), return_inverse=True, return_counts=True
    )
    return each, found, np.split(back, [len(each[0][0])]), counts


def _long(words: Words, order: int, repeated: np.ndarray):
    """(hashes, first words) of the longer n-grams whose bigrams all start at a ``repeated`` word."""
    out = []
    for n in range(3, order + 1):
        hashes, at = grams(words, n, seed=n)
        some = np.ones(len(at), bool)
        for k in range(n - 1):
            some &= repeated[at + k]
        out.append((hashes[some], at[some]))
    return out


def scored(
    docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF
) -> DataFrame:
    """One row per document: words, sum and mean of log10 scores, words scored by the longest n-gram
    their place allows, and by a shorter one."""
    total = docs.agg(F.sum(n_words(F.col("text")))).first()[0] or 0

    def short_keys(table: pa.Table):
        _, found, _, counts = _short(words_of(table.column("text")), order)
        return found, counts

    def starts(words: Words, short, found: np.ndarray) -> np.ndarray:
        repeated = np.zeros(len(words.hash), bool)
        each, _, back, _ = short
        if len(each) > 1:
            repeated[each[1][1]] = found[back[1]] >= min_count
        return repeated

    def long_keys(table: pa.Table, tallied: pa.Table):
        words = words_of(table.column("text"))
        repeated = starts(words, _short(words, order), packs.counts_in_order(tallied))
        hashes = [h for h, _ in _long(words, order, repeated)]
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_counts=True)

    def score(table: pa.Table, tallied: pa.Table) -> pa.Table:
        words = words_of(table.column("text"))
        found = packs.counts_in_order(tallied)
        short = _short(words, order)
        each, keys, back, _ = short
        counts = [found[b].astype(np.float64) for b in back]
        long = _long(words, order, starts(words, short, found))
        if long:
            _, back = np.unique(np.concatenate([h for h, _ in long]), return_inverse=True)
            sizes = np.cumsum([len(h) for h, _ in long])[:-1]
            counts += np.split(found[len(keys) :][back].astype(np.float64), sizes)
            each = each + long
        n = len(words.hash)
        # by_end[k]: count of the (k + 1)-gram that ends at each word, 0 where there is none.
        by_end, by_start = [], []
        for k, (_, at) in enumerate(each):
            ends, begins = np.zeros(n), np.zeros(n)
            ends[at + k], begins[at] = counts[k], counts[k]
            by_end.append(ends)
            by_start.append(begins)
        value = np.log10(by_end[0] / max(total, 1), where=by_end[0] > 0, out=np.zeros(n))
        level = np.zeros(n, np.int64)
        place = words.place()
        for k in range(1, order):
            here = place >= k
            known = here & (by_end[k] >= min_count)
            ahead = np.zeros(n)
            ahead[k:] = by_start[k - 1][: n - k]  # the context: the same n-gram without its last word
            value[here & ~known] += np.log10(backoff)
            value[known] = np.log10(by_end[k][known] / ahead[known])
            level[known] = k
        longest = level == np.minimum(place, order - 1)
        sums = np.add.reduceat(np.append(value, 0.0), words.first[:-1]) if words.n_docs else np.zeros(0)
        lengths = np.diff(words.first)
        best = np.add.reduceat(np.append(longest, False).astype(np.int64), words.first[:-1])
        none = lengths == 0
        sums[none], best[none] = 0.0, 0
        mean = np.divide(sums, lengths, where=~none, out=np.zeros(len(sums)))
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(lengths, pa.int64()),
                "log10_sum": pa.array(sums),
                "log10_mean": pa.array(mean, mask=none),
                "n_longest": pa.array(best, pa.int64()),
                "n_backed_off": pa.array(lengths - best, pa.int64()),
            }
        )

    rows, n = packs.packed(docs)
    known = packs.tally(rows, n, short_keys)
    if order > 2:
        longer = packs.tally(rows, n, long_keys, known)
        known = known.union(longer.withColumn("part", F.col("part") + n))  # after the short ones
    return packs.beside(rows, known, score, SCHEMA)
