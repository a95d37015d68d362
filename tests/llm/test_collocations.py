"""Phrase collocations against a plain version, and what the summaries guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import collocations

DOCS = "doc_id long, text string, lang string"


def plain(rows, least, longest=5, top=2000):
    total, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    known = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    out = []
    for (lang, words), a in known.items():
        if any(
            b >= a and other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))
            for (other, w), b in known.items()
        ):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    rows = []
    for lang in total:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)] + ["Größe", "it's", " x", "A\u0000b", "q" * 200]
    fixed = ["red green blue", "Red green blue grey", "one two one two one two", "New york"]

    def text():
        out = [rng.choice(vocabulary + fixed) for _ in range(rng.randrange(60))]
        return "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\x0b", "? "]) for w in out)

    rows = [(i, text(), rng.choice(["en", "en", "de", None, "und", ""])) for i in range(250)]
    return rows + [(None, "new york " * 30, "en"), (3, None, "en"), (4, "", "fr"), (5, " .,;\n", "de"), rows[7], rows[7]]


@pytest.mark.parametrize(("least", "top"), [(6, 2000), (25, 10)])
def test_equals_plain_version(spark, rows, least, top):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = collocations.collocations(docs, least, top=top).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, top=top)


def test_many_packs(spark, rows, monkeypatch):
    """Small packs, short hashes and one level per order give the same."""
    monkeypatch.setattr(collocations, "LEVELS", ((1,), (2,), (3,), (4,), (5,)))
    monkeypatch.setattr(collocations, "SPARE_BITS", -3)
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, collocations.collocations(docs, 6, pack_bytes=2000).collect())) == plain(rows, 6)


def test_no_documents_and_other_columns(spark):
    empty = spark.createDataFrame([], DOCS + ", phrase string, code long, n long")
    assert collocations.collocations(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), min_size=1, max_size=9), st.integers(1, 12))
def test_every_frequent_key_survives(groups, least):
    blocks = []
    for group in groups:
        keys, counts = np.unique(np.array(group, np.uint64), return_counts=True)
        blocks.append((keys, counts.astype(np.int64)))
    total = Counter(x for group in groups for x in group)
    kept = set(collocations.heavy(blocks, least).tolist())
    assert {k for k, v in total.items() if v >= least} <= kept
    assert len(kept) <= sum(total.values()) // least + 1


def test_score_is_exact(spark):
    cases = [(10**14 + 7, 10**15 + 9, 10**14 + 11, 10**14 + 13), (100, 10**16, 100, 100), (3 * 10**9, 10**13, 3 * 10**9 + 1, 5 * 10**9)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long").selectExpr(collocations.SCORE + " AS s")
    assert [r.s for r in df.collect()] == [1000 * a * n // (left * right) for a, n, left, right in cases]
