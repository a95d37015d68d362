"""Alignment of two tokenizers against a plain version that uses the libraries of the two files."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers

from fleetlens.llm import token_alignment
from fleetlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (1000, None), (1001, ""), (1002, "<|endoftext|> a</s><s>"), (1003, "▁x"), (1004, "日本語 テキスト 🙂🙂 \x00 z"),
    (1005, "   "), (None, "hello hello"), (1006, "hello hello"), (1006, "hello hello"), (1007, "x"), (1008, "a" * 3000),
]


@pytest.fixture(scope="module")
def brute():
    a_model = tokenizers.Tokenizer.from_file(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}")
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=f"{token_alignment.FOLDER}/{token_alignment.B_FILE}")
    byte_of = token_alignment.byte_characters()

    def ranged(pairs):
        out, at = [], 0
        for token, size in pairs:
            out.append((token, at, at + size))
            at += size
        return out

    def tokens(text):
        if not text:
            return [], []
        a = [(x, bytes(byte_of[c] for c in a_model.id_to_token(x))) for x in a_model.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for x in b_model.encode(text):
            piece = b_model.id_to_piece(x)
            b.append((x, bytes([int(piece[3:-1], 16)]) if b_model.is_byte(x) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return [], []
        return ranged([(i, len(x)) for i, x in a]), ranged([(i, len(x)) for i, x in b])

    def align(rows):
        docs, held = [], Counter()
        for doc_id, text in rows:
            a, b = tokens(text)
            links, first = [], 0
            for token, start, end in a:
                while first < len(b) and b[first][2] <= start:
                    first += 1
                at = first
                while at < len(b) and b[at][1] < end:
                    links.append((token, b[at][0]))
                    at += 1
            groups, low = [], 0
            for stop in sorted({x[2] for x in a} & {x[2] for x in b}):
                groups.append("|".join(",".join(str(t) for t, _, e in side if low < e <= stop) for side in (a, b)))
                low = stop
            held.update(set(links))
            docs.append((doc_id, len(a), len(b), links, groups))
        best = defaultdict(int)
        for (token, _), n in held.items():
            best[token] = max(best[token], n)
        return sorted(
            repr((i, n, m, len(g), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), ";".join(g)))
            for i, n, m, links, g in docs
        )

    return align


@pytest.fixture(scope="module")
def rows(spark):
    some = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 10 = 3").select("doc_id", "text").collect()
    return [tuple(r) for r in some] + ODD


@pytest.mark.parametrize(("step", "slice_bytes"), [(1 << 20, 4 << 20), (97, 20_000), (1000, 1 << 30)])
def test_pieces_of_any_size(spark, brute, rows, step, slice_bytes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_alignment.aligned(docs, step=step, slice_bytes=slice_bytes).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_one_long_document_in_many_pieces(spark, brute):
    text = " ".join(f"wörter{i * 7919 % 1000} und, mehr-{i}" for i in range(300))
    rows = [(1, text), (2, "kurz"), (3, text)]
    got = token_alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), step=150).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_tokens_of_odd_texts(brute):
    """Random mixtures of white space, signs and letters of many kinds give the tokens that the files' own libraries give."""
    import random

    rng = random.Random(13)
    signs = [*"  \t\n\r\x0b\x1c\x1f\x85\xa0\u2003\u3000\u200b abcXYZ019.,;:!?''s're-éßж中𝒳🙂\u0301\x00\x7f", " a", " 1", "  b", "<s>", "<0x41>"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30)))) for i in range(1500)]
    both = token_alignment.Tokenizers(*(f"{token_alignment.FOLDER}/{f}" for f in (token_alignment.A_FILE, token_alignment.B_FILE)))
    want = {r[0]: r[1:3] for r in map(eval, brute(rows))}
    for i, text in rows:
        a, b = both.tokens(text)
        spelt = both.a.spells(a, np.frombuffer((" " + text).encode(), np.uint8)) and both.b.spells(b, np.frombuffer((" " + text).encode(), np.uint8))
        assert want[i] == ((len(a), len(b)) if spelt else (0, 0)), repr(text)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_a long, piece long")
    assert token_alignment.aligned(empty).collect() == []


def test_query_on_whole_texts(spark, brute):
    import hashlib

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op13_token_alignment"](spark, FOLDER).collect()
    want = {}
    for r in map(eval, brute(rows)):
        want[r[0]] = (*r[1:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "")
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_diagonals_cut_into_equal_pieces():
    rng = np.random.default_rng(3)
    a = np.unique(np.append(rng.integers(1, 5000, 900), 5000))
    b = np.unique(np.append(rng.integers(1, 5000, 300), 5000))
    merged = sorted([(int(x), 0) for x in a] + [(int(x), 1) for x in b])
    i, j = token_alignment.cuts(a, b, 50)
    for x, y, at in zip(i[1:-1], j[1:-1], range(50, len(merged), 50), strict=True):
        assert 0 <= x + y - at <= 1  # one more where two equal ends would be parted
        head = merged[: x + y]
        assert x == sum(side == 0 for _, side in head)
        assert max(head)[0] < merged[x + y][0]
