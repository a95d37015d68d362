"""Language identification as inference of a multilingual mixture.

Training counts hashed character n-grams of words per language. A document's words are then drawn
from a mixture of the languages: expectation-maximisation estimates the proportions from the
words' n-gram likelihoods, and the set of languages is the one with the best likelihood less a
penalty per language. The prediction is the language with the largest proportion, the score that
proportion.

Counts are summed in Spark; the model has buckets x languages numbers, whatever the corpus.

Edge cases: a null text or one without a letter is ``und`` with score 0, and so is every text if
nothing was learned. Null languages and null ids are not learned from. Rows with equal texts are predicted alike. Ties go to the first language
in code point order. Other columns pass through unless they are named like results.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import sliced

BUCKETS = 1 << 16
SMOOTHING = 0.1
ROUNDS = 12
#: Half the logarithm of the number of words, per language added, times this factor.
PENALTY = 3.0
UNKNOWN = "und"
#: Separates letters from everything else; digits and the underscore are no letters.
NO_LETTERS = re.compile(r"[\W\d_]+")
SLICE_BYTES = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of the letters of all texts: bucket, word and, per word, its text.

    Words are lower-cased and stand between blanks. Every character gives its bigram and trigram.
    """
    clean = [NO_LETTERS.sub(" ", t).strip().lower() if t else "" for t in texts]
    joined = " " + "  ".join(clean) + "  "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = codes == 32
    lengths = np.array([len(c) for c in clean], np.int64)
    begin = 1 + np.cumsum(lengths + 2) - (lengths + 2)
    letter = np.flatnonzero(~blank[:-1])
    new = np.ones(len(letter), bool)
    new[1:] = letter[1:] != letter[:-1] + 1
    word = np.cumsum(new) - 1
    owner = np.searchsorted(begin, letter[new], side="right") - 1
    a, b, c = codes[letter - 1], codes[letter], codes[letter + 1]
    two = (a * np.uint64(0x9E3779B1) ^ b * np.uint64(0x85EBCA77C2B2AE63)) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two ^ c) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.uint64(64 - (BUCKETS - 1).bit_length())
    return np.stack([two >> bits, three >> bits]).astype(np.int64), word, owner


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of every n-gram bucket per language.

    Learns from all rows of ``docs`` with a language and a text.
    """

    def count(batches):
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                grams, word, owner = _coded(texts)
                names, code = np.unique(np.array(langs, object).astype(str), return_inverse=True)
                per_letter = code[owner[word]]
                sums = np.bincount(
                    (per_letter * BUCKETS + grams).ravel(), minlength=len(names) * BUCKETS
                ).reshape(len(names), BUCKETS)
                for name, row in zip(names, sums, strict=True):
                    table[str(name)] = table.get(str(name), 0) + row
        for name, row in table.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([name] * len(some), pa.string()),
                    "bucket": pa.array(some, pa.int32()),
                    "n": pa.array(row[some], pa.int64()),
                }
            )

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = (
        rows.mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most one row per bucket and language
    )
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    table[counts["lang"].map(place).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"]
    share = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return langs, np.log(share).T.astype(np.float32)


def _mixture(like: np.ndarray, owner: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages (a row per document) and the log-likelihood they reach.

    ``like`` has a row per word, scaled to a maximum of 1; ``owner`` is its document, in order.
    """
    words = np.bincount(owner, minlength=n).astype(float)
    starts = np.searchsorted(owner, np.arange(n))
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    some = words > 0

    def per_doc(values):
        padded = np.concatenate([values, np.zeros((1, *values.shape[1:]))])
        sums = np.add.reduceat(padded, starts, axis=0)
        sums[~some] = 0
        return sums

    for _ in range(ROUNDS):
        weight = like * share[owner]
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-300)
        share = per_doc(weight) / np.maximum(words, 1)[:, None]
    reached = np.log(np.maximum((like * share[owner]).sum(axis=1), 1e-300))
    return share, per_doc(reached)


def inferred(texts: list[str], langs: list[str], model: np.ndarray, penalty: float = PENALTY):
    """Proportions per text (rows sum to 1, or are 0 where nothing can be said)."""
    n, k = len(texts), len(langs)
    grams, word, owner = _coded(texts)
    if not k or not len(word):
        return np.zeros((n, k))
    per_letter = model[grams[0]] + model[grams[1]]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    logs = np.add.reduceat(per_letter, starts, axis=0).astype(np.float64)
    logs -= logs.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(logs, -300))
    n_words = np.bincount(owner, minlength=n)
    cost = penalty / 2 * np.log(np.maximum(n_words, 2))

    full, best_full = _mixture(like, owner, n, np.ones((n, k)))
    order = np.argsort(-full, axis=1, kind="stable")
    first = np.searchsorted(owner, np.arange(n))
    single = np.add.reduceat(np.concatenate([np.maximum(logs, -300), np.zeros((1, k))]), first, axis=0)
    single[n_words == 0] = 0
    best = single.max(axis=1) - cost
    result = np.zeros((n, k))
    result[np.arange(n), single.argmax(axis=1)] = 1
    result[n_words == 0] = 0
    # No set of several languages can reach more than all of them together do.
    open_docs = np.flatnonzero((best_full - 2 * cost > best) & (n_words > 0))
    for size in range(2, k + 1):
        if not len(open_docs):
            break
        mine = np.isin(owner, open_docs)
        place = np.searchsorted(open_docs, owner[mine])
        allowed = np.zeros((len(open_docs), k))
        np.put_along_axis(allowed, order[open_docs, :size], 1, axis=1)
        share, reached = _mixture(like[mine], place, len(open_docs), allowed)
        value = reached - size * cost[open_docs]
        better = value > best[open_docs]
        best[open_docs[better]] = value[better]
        result[open_docs[better]] = share[better]
        open_docs = open_docs[best_full[open_docs] - (size + 1) * cost[open_docs] > best[open_docs]]
    return result


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and lang_shares (language to proportion, of the selected set)."""
    langs, table = learned(docs.where(~held_out(F.col("doc_id")))) if model is None else model

    @F.pandas_udf("lang_pred string, score double, lang_shares map<string,double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores, shares = [], [], []
        sizes = texts.str.len().fillna(0).cumsum() // SLICE_BYTES
        for _, part in texts.groupby(sizes, sort=False):
            found = inferred([t if isinstance(t, str) else "" for t in part], langs, table)
            for row in found:
                top = int(row.argmax()) if len(row) and row.any() else -1
                names.append(langs[top] if top >= 0 else UNKNOWN)
                scores.append(float(min(row[top], 1.0)) if top >= 0 else 0.0)
                shares.append({langs[i]: float(row[i]) for i in np.flatnonzero(row > 0)})
        return pd.DataFrame(
            {"lang_pred": names, "score": scores, "lang_shares": shares}, index=texts.index
        )

    return (
        docs.drop("lang_pred", "score", "lang_shares")
        .withColumn("_found", predict("text"))
        .select("*", "_found.lang_pred", "_found.score", "_found.lang_shares")
        .drop("_found")
    )
