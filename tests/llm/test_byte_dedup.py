"""Suffix arrays, and removal of repeated byte strings against a plain version."""

import random
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import byte_dedup
from fleetlens.llm.suffix_array import common_prefixes, prefix_groups, suffix_array


def plain(rows, window):
    """[(id, bytes, spans, kept)] of (id, text) rows."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + window] for _, t in data for k in range(len(t) - window + 1))
    out = []
    for i, t in data:
        gone = set()
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone.update(range(k, k + window))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out.append((i, len(t), [tuple(s) for s in spans], bytes(b for k, b in enumerate(t) if k not in gone)))
    return out


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = byte_dedup.deduped(docs, **options).collect()
    return sorted(repr((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))) for r in got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)

    def text(n, letters="abcdeé "):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, line = text(90), text(26)
    out = [text(rng.choice([0, 1, 19, 20, 21, 60, 300])) for _ in range(60)]
    out += [text(rng.randrange(40)) + passage + text(rng.randrange(40)) for _ in range(40)]  # one passage in many texts
    out += [text(30) + line + text(30) + line for _ in range(30)]
    out += [text(25) + passage[10:60] + text(25), passage, passage, passage[5:80]]
    out += ["ab" * 300, "x" * 700, "ba" * 20, "\x00" * 50, "\x00\x01" * 30, None, "", None, "日本語" * 30]
    out += [out[3] + "tail", out[70][:50] + out[71][20:]]
    return [*enumerate(out), (None, passage), (5, passage + line), (5, passage + line)]


@pytest.mark.parametrize("hot", [1000, 5, 0])
def test_equals_plain_version(spark, rows, hot):
    """In shards, with hot anchors, and with all anchors hot."""
    want = sorted(map(repr, plain(rows, 20)))
    assert found(spark, rows, window=20, anchor=8, hot=hot) == want


def test_many_packs_and_short_segments(spark, rows, monkeypatch):
    monkeypatch.setattr(byte_dedup, "LONGEST", 7)
    monkeypatch.setattr(byte_dedup, "CHUNK", 37)
    want = sorted(map(repr, plain(rows, 20)))
    for hot in (1000, 30):
        assert found(spark, rows, window=20, anchor=8, hot=hot, pack_bytes=500) == want


def test_anchor_as_long_as_a_window(spark, rows):
    assert found(spark, rows, window=30, anchor=30) == sorted(map(repr, plain(rows, 30)))


def test_nothing_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, pack int, kept string")
    assert byte_dedup.deduped(empty).collect() == []
    one = spark.createDataFrame([(1, None, 7, "x"), (2, "a" * 500, 7, "y")], "doc_id long, text string, pack int, kept string")
    got = {r.doc_id: (r.n_bytes, len(r.kept)) for r in byte_dedup.deduped(one).collect()}
    assert got == {1: (0, 0), 2: (500, 0)}


@pytest.mark.parametrize("letters", [1, 2, 4, 257])
@pytest.mark.parametrize("n", [0, 1, 2, 9, 300])
def test_suffix_array(n, letters):
    symbols = np.random.default_rng(n).integers(0, letters, n).astype(np.uint16)
    symbols[n // 2 :] = symbols[: n - n // 2]
    text = symbols.tolist()
    order = suffix_array(symbols)
    assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
    for k, shared in enumerate(common_prefixes(symbols, order)):
        a, b = (text[order[k - 1] :], text[order[k] :]) if k else ([], [])
        same = [x == y for x, y in zip(a, b, strict=False)]
        assert shared == (same.index(False) if False in same else len(same))


@pytest.mark.parametrize("depth", [1, 6, 7, 20, 64, 400])
@pytest.mark.parametrize("letters", [1, 3, 257])
@pytest.mark.parametrize("n", [0, 1, 9, 700])
def test_prefix_groups(n, letters, depth):
    """Positions are one group exactly where the next symbols are equal, and no deeper."""
    symbols = np.random.default_rng(n + depth).integers(0, letters, n).astype(np.uint16)
    symbols[n // 2 :] = symbols[: n - n // 2]
    text = symbols.tolist()
    groups = prefix_groups(symbols, depth).tolist()
    seen = {}
    for i, group in enumerate(groups):
        assert seen.setdefault(group, text[i : i + depth]) == text[i : i + depth]
    assert len(seen) == len({tuple(text[i : i + depth]) for i in range(n)})


def test_deep_copies_are_not_sorted_to_their_ends():
    """Long copies of one text take no more rounds than a window needs."""
    text = np.random.default_rng(1).integers(1, 5, 5000).astype(np.uint16)
    symbols = np.concatenate([text, [0], text, [0]])
    rounds = []
    sort = np.argsort

    def counted(keys):
        rounds.append(len(keys))
        return sort(keys)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(np, "argsort", counted)
        prefix_groups(symbols.astype(np.uint16), 400)
    assert len(rounds) == 5  # 7, 21, 63, 189 and 400 symbols


def test_window_shared_with_many_texts(spark):
    """Bytes go exactly where a window repeats, also within one text; ``n_bytes`` is the whole text's length."""
    rng = random.Random(3)
    body = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(3)]
    rows = [(1, body[0]), (2, body[0][:399] + "#" + body[1]), (3, "-" + body[1][50:450]), (4, body[2] * 2), (5, body[2][300:])]
    assert found(spark, rows) == sorted(map(repr, plain(rows, 400)))


def test_prefix_groups_of_a_long_text():
    """Beyond 2^21 symbols a round looks at two groups instead of three."""
    symbols = np.random.default_rng(2).integers(0, 2, (1 << 21) + 9).astype(np.uint16)
    groups = prefix_groups(symbols, 17)[:-16]
    codes = sum(symbols[k : len(symbols) - 16 + k].astype(np.int64) << (16 - k) for k in range(17))
    order = np.argsort(codes, kind="stable")
    assert ((np.diff(codes[order]) > 0) == (np.diff(groups[order]) > 0)).all()
    assert (np.diff(groups[order]) >= 0).all()


@pytest.mark.parametrize("width", [1, 2, 3, 8, 21, 300])
def test_sliding(width):
    values = np.random.default_rng(width).integers(0, 99, 200).astype(np.uint64)
    for best in (np.minimum, np.maximum):
        want = [best.reduce(values[k : k + width]) for k in range(len(values) - width + 1)]
        assert byte_dedup.sliding(values, width, best).tolist() == want
