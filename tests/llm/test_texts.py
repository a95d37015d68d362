"""Operators on texts, against brute force and held-out rows."""

import hashlib
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import (
    decontamination,
    language_id,
    license_scan,
    lm_scores,
    mixing,
    secret_scan,
    substring_dedup,
    url_filter,
    words,
)
from fleetlens.llm.common import n_words
from fleetlens.llm.fm_index import FMIndex

ODD = [None, "", " \t\n", "a", "é", "one  two\n", "\x0bx\x0c y\r", "nbsp\u00a0stays", "zero\x00byte", "x" * 300_000, "a b " * 40_000]


def test_words_equal_the_pattern(spark, docs):
    for column in (pa.array(ODD), pa.chunked_array([pa.array(ODD[:4]), pa.array(ODD[4:])]), pa.array(ODD).slice(3, 5)):
        got = words.words_of(column)
        texts = column.to_pylist()
        want = [(i, w) for i, t in enumerate(texts) for w in brute.words(t)]
        assert [(int(d), bytes(got.data[a:b]).decode()) for d, a, b in zip(got.doc, got.start, got.end)] == want
        assert len(set(got.hash.tolist())) == len({w for _, w in want})
    counted = docs(list(enumerate(ODD))).select("doc_id", n_words(F.col("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in counted} == {i: len(brute.words(t)) for i, t in enumerate(ODD)}


def test_fm_index_matching_statistics():
    rng = random.Random(3)
    texts = [[rng.randrange(1, 5) for _ in range(rng.randrange(13, 40))] for _ in range(20)]
    texts += [texts[0][3:20] + texts[1][:15]]
    symbols = np.array([s for t in texts for s in [*t, 0]])
    index = FMIndex(symbols, 5, 13)
    held = {tuple(t[i : i + n]) for t in texts for n in range(1, 14) for i in range(len(t) - n + 1)}
    streamed = [t[2:30] for t in texts] + [[rng.randrange(1, 5) for _ in range(60)] for _ in range(10)]
    flat = np.array([s for t in streamed for s in t])
    end = np.cumsum([len(t) for t in streamed])
    length, found = index.match(flat, end - [len(t) for t in streamed], end)
    at = 0
    for text in streamed:
        for i in range(len(text)):
            want = max((n for n in range(1, 14) if i + n <= len(text) and tuple(text[i : i + n]) in held), default=0)
            assert length[at + i] == want
            assert (found[at + i] >= 0) == (want == 13)
        at += len(text)


def repeating_rows():
    rng = random.Random(8)
    word = lambda: f"v{int(300 * rng.random() ** 2)}"
    shared = [[word() for _ in range(n)] for n in (12, 13, 14, 60)]
    rows = []
    for i in range(150):
        text = [word() for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(shared)
        rows.append((i, " ".join(text)))
    rows += [(200, rows[7][1]), (200, rows[9][1]), (None, rows[11][1]), (201, None), (202, "  "), (203, "Same same " * 30)]
    rng.shuffle(rows)
    return rows


def test_substrings_equal_brute_force(docs):
    rows = repeating_rows()
    got = substring_dedup.deduped(docs(rows).withColumn("kept", F.lit(1)).withColumn("pack", F.lit("x"))).collect()
    found = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got]
    assert sorted(found, key=repr) == sorted(brute.substrings(rows), key=repr)
    assert sum(r.n_removed for r in got) > 300
    assert substring_dedup.deduped(docs([])).collect() == []


def test_lm_scores_equal_brute_force(docs):
    rows = repeating_rows()
    counts = [Counter(), Counter(), Counter()]
    for _, text in rows:
        w = brute.words(text)
        for n in range(3):
            counts[n].update(tuple(w[i : i + n + 1]) for i in range(len(w) - n))
    total = sum(counts[0].values())

    def score(w, i):
        if i >= 2 and counts[2][tuple(w[i - 2 : i + 1])] >= 2:
            return math.log10(counts[2][tuple(w[i - 2 : i + 1])] / counts[1][tuple(w[i - 2 : i])])
        if i >= 1 and counts[1][tuple(w[i - 1 : i + 1])] >= 2:
            return math.log10(counts[1][tuple(w[i - 1 : i + 1])] / counts[0][(w[i - 1],)] * (0.4 if i > 1 else 1))
        return math.log10(counts[0][(w[i],)] / total * 0.4 ** min(i, 2))

    want = sorted((repr(i), len(brute.words(t)), round(sum(score(brute.words(t), k) for k in range(len(brute.words(t)))), 6)) for i, t in rows)
    got = lm_scores.scored(docs(rows)).collect()
    assert sorted((repr(r.doc_id), r.n_words, round(r.log10_sum, 6)) for r in got) == want
    assert {r.log10_mean for r in got if r.n_words == 0} == {None}
    assert lm_scores.scored(docs([])).collect() == []


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(4)
    sounds = {"aa": "ka lo mi tu sa re", "bb": "sch er ung ein ver ich", "cc": "ño ez ción as que ll"}

    def text(lang, n):
        return " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    rows = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        rows.append((i, text(lang, rng.randrange(5, 60)), lang))
    return rows, text


def test_language_held_out_accuracy(docs, spoken):
    rows, text = spoken
    extra = [(1000, None, "aa"), (1001, "12 ... 3_4", "bb"), (1002, text("aa", 30) + " " + text("bb", 90), None), (None, text("cc", 20), "cc"), (3, rows[3][1], rows[3][2])]
    df = docs(rows + extra).withColumn("score", F.lit("clash"))
    got = language_id.identified(df).collect()
    assert len(got) == len(rows) + 5
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows)
    assert (by_id[1000].lang_pred, by_id[1000].score) == ("und", 0.0)
    assert by_id[1001].lang_pred == "und" and by_id[None].lang_pred == "cc"
    mixed = by_id[1002]
    assert mixed.lang_pred == "bb" and set(mixed.lang_shares) == {"aa", "bb"} and abs(mixed.score - 0.75) < 0.1
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_training(docs):
    got = language_id.identified(docs([(1, "some text", None), (2, None, "aa")])).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert language_id.identified(docs([])).collect() == []


ITEM = "A train leaves Boston at 40 km per hour, and Maria walks 3 miles to meet her friend while Boston sleeps. How far does she go?"


def test_decontamination(spark, docs):
    other = ITEM.replace("Boston", "Lima").replace("40", "75").replace("Maria", "John")
    torn = ITEM.replace("Boston", "Lima", 1)  # one name, two values
    rows = [(1, "noise before. " + ITEM + " and after"), (2, other), (3, torn), (4, "quite another text " * 20), (5, None), (6, ""), (7, ITEM.upper()), (1, "x " * 100_000)]
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (10, ITEM)], "item_id long, text string")
    got = decontamination.leaks(docs(rows).withColumn("item_id", F.lit("clash")), items).collect()
    found = {r.doc_id: r for r in got}
    assert {1, 2} <= set(found) and not {4, 5, 6} & set(found)
    assert found[1].exact and not found[2].exact and found[2].item_id == 10
    assert 3 not in found
    kept = decontamination.clean(docs(rows), items)
    assert {r.doc_id for r in kept.collect()} >= {3, 4, 5, 6} and kept.columns == docs([]).columns
    assert decontamination.leaks(docs([]), items).collect() == []
    assert decontamination.leaks(docs(rows), items.limit(0)).collect() == []


def test_decontamination_names_that_open_sentences(spark, docs):
    item = "Alice has 5 apples. Bob has 3 apples. How many apples do they have together?"
    other = item.replace("Alice", "Carl").replace("Bob", "Dan").replace("5", "7").replace("3", "4")
    rows = [(1, "Some words before. " + other), (2, item), (3, "Alice has a dog. Bob has none. How old are they?"), (4, "Mary Ann " + other[5:])]
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    found = [(r.doc_id, r.place, r.exact) for r in decontamination.leaks(docs(rows), items).collect()]
    assert sorted(x[0] for x in found) == [1, 2, 4]
    assert {x[0] for x in found if x[2]} == {2}
    assert {r.doc_id for r in decontamination.clean(docs(rows), items).collect()} == {3}


def test_decontamination_in_another_case(spark, docs):
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    rows = [(1, ITEM.upper()), (2, ITEM.lower()), (3, "An ordinary sentence. " + ITEM.upper()), (4, ITEM.title()), (5, ITEM)]
    found = {r.doc_id: r for r in decontamination.leaks(docs(rows), items).collect()}
    assert set(found) == {1, 2, 3, 4, 5} and all(r.exact for r in found.values())
    assert decontamination.leaks(docs([(6, ITEM)]), items).count() == 1
    upper = spark.createDataFrame([(10, ITEM.upper())], "item_id long, text string")
    assert decontamination.leaks(docs([(6, ITEM)]), upper).count() == 1


def test_decontamination_numbers_are_free(spark, docs):
    item = "There are 7 red balls and 3 blue balls in a box while 7 more are on the old table near it."
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    rows = [(1, item.replace("7", "4").replace("3", "4")), (2, item.replace("7", "9", 1)), (3, item)]
    found = {r.doc_id: (r.exact, r.n_slots) for r in decontamination.leaks(docs(rows), items).collect()}
    assert found == {1: (False, 3), 2: (False, 3), 3: (True, 3)}


def test_templates():
    tokens, values = decontamination.templates("Ann Lee ran 3.5 km. Then Bob paid $20 to Ann Lee")
    assert tokens == ["ann", decontamination.NAME, "ran", decontamination.NUMBER, decontamination.UNIT, "then", decontamination.NAME, "paid", decontamination.NUMBER, "to", decontamination.NAME]
    assert values == {1: "lee", 3: "3.5", 4: "km", 6: "bob", 8: "20", 10: "ann lee"}


def test_secrets_equal_brute_force(docs):
    key = "AKIA" + "Q7" * 8
    texts = [
        None, "", "é password: secret: abcdefghij", 'token = "' + "0af3" * 10 + '" x', f"({key})", "API_KEY='abc'", "apikey=abcd1234_.=-x",
        "Secret=short token==abcdefgh12", "f" * 31, "f" * 32 + " " + "0" * 40, "AKIA" + "B" * 11, "passwdpassword:abcdefgh", "\U0001f600 token:12345678 " * 3,
        "plain words only " * 30_000 + "token=abcdefgh",
    ]
    rows = list(enumerate(texts))
    got = secret_scan.scanned(docs(rows).withColumn("spans", F.lit(0)), [0.0] * 128 * 128).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.base] == brute.secrets(texts[r.doc_id]), texts[r.doc_id]
        assert r.spans == r.base
    clean = {r.doc_id: r.text for r in secret_scan.redacted(docs(rows), [0.0] * 128 * 128).collect()}
    assert clean[0] is None and clean[4] == "([access])" and clean[8] == texts[8]
    assert not any(brute.secrets(t) for i, t in clean.items() if i != 7)


def test_secret_models_add_random_tokens(docs):
    rng = random.Random(2)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    loose = "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(28)) + "7"
    plain = "the quick_brown_fox_jumps over version2 of some_function_name_in_module " * 5
    rows = [(i, f"{plain} token = {h} {plain}") for i, h in enumerate(hexes)]
    rows += [(100, f"see {loose} here"), (101, "call some_function_name_in_module2 now"), (102, None)]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in secret_scan.scanned(docs(rows)).collect()}
    assert got[100] == [("random", loose)] and got[101] == [] and got[102] == []
    assert secret_scan.scanned(docs([])).collect() == []


def test_mix_near_targets(docs):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 40), None, rng.choice(["a", "b", "c", "d", None] + ["big"] * 6), 1) for i in range(6000)]
    rows += [(9000, None, None, "a", 1), (None, "one two", None, "b", 1), (5, "w " * 7, None, "none", 1), (5, "w " * 7, None, "none", 1)]
    df = docs(rows).withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sum(r.size * r.copies for r in got) == pytest.approx(sum(r.size for r in got), rel=0.05)
    order = sorted({r.source for r in got if r.source}) + [None]
    sizes = {s: next(r.source_size for r in got if r.source == s) for s in order}
    goals = {s: next(r.target for r in got if r.source == s) for s in order}
    level = {s: goals[s] / (k % 3 + 1) for k, s in enumerate(order) if goals[s] < 3 * sizes[s]}
    assert sum(goals.values()) == pytest.approx(sum(sizes.values())) and max(level.values()) == pytest.approx(min(level.values()))
    assert all(goals[s] <= 3 * sizes[s] for s in order) and max(r.copies for r in got) <= 3
    for s in order[1:]:
        if sizes[s] > 1000:
            assert sum(r.size * r.copies for r in got if r.source == s) == pytest.approx(goals[s], rel=0.1)
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, got))
    out = mixing.emitted(df)
    assert out.count() == sum(r.copies for r in got) and out.columns == df.columns


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).collect() == []
    got = mixing.mix(docs([(1, None, None, "a", 0), (2, "", None, None, 0)])).collect()
    assert [(r.size, r.target, r.copies) for r in got] == [(0, 0.0, 0)] * 2


def test_url_filter(spark):
    urls = {
        None: ("", "", None, "allow"), "no scheme.com/en/": ("", "", None, "allow"),
        "http://A.Example.COM/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://myexample.com/en/": ("myexample.com", "/en/", "com/", "allow"), "http://a.com": ("a.com", "", None, "allow"),
        "http://a.net/es/1#k": ("a.net", "/es/1", "net/es/", "block"), "http://a.net/ES/1": ("a.net", "/ES/1", None, "allow"),
        "http://a.com:80/en/": ("a.com:80", "/en/", None, "allow"), "a://b://c.com/": ("b:", "//c.com/", None, "allow"),
        "https://casino-win.example.org/": ("casino-win.example.org", "/", None, "block"),
        "https://best-bets.example.org/a": ("best-bets.example.org", "/a", None, "block"), "https://u.org/?a=1&PHPSESSID=3": ("u.org", "/", None, "block"),
        "https://m.casino-win.example.com/en/3": ("m.casino-win.example.com", "/en/3", "example.com/en/", "block"),
        "https://alphabets.org/": ("alphabets.org", "/", None, "allow"), "": ("", "", None, "allow"), "http://a.com/" + "x" * 100_000: ("a.com", "/" + "x" * 100_000, "com/", "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(2, "http://A.Example.COM/en/1?x", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = url_filter.rules_table(spark)
    got = url_filter.judged(pages, rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url]
    assert {r.verdict for r in url_filter.judged(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0), rules).collect() == []


def test_url_rules_without_a_whole_token(spark):
    urls = ["http://mypills.example.org/", "http://x.bestpills-now.org/a", "http://u.org/wp-login.php5", "http://u.org/wp-login.php", "http://u.org/pillsbox", "http://u.org/php/wp/login"]
    urls += [f"http://u{i}.org/wp/login/{i}" for i in range(5)]  # php is the rarest token
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r.verdict for r in url_filter.judged(pages, url_filter.rules_table(spark)).collect()}
    assert [got[u] for u in urls] == ["block"] * 4 + ["allow"] * 7


def test_licences(spark):
    mit = "some code here\n// Released under the MIT License.\nmore code"
    rows = [
        ("a/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("a/x.txt", "nothing"), ("a/b/c/y.txt", None),
        ("a/b/LICENSE.md", "Licensed under\nthe Apache License,\nVersion 2.0"), ("a/b/z.txt", mit), ("ab/x.txt", "the mit and the gnu of it"), ("top.txt", ""), (None, mit), ("a/x.txt", "nothing"),
        ("q/LICENSE", "word " * 50_000), ("q/x.txt", "by the way " * 20_000),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, licence int")
    got = {(r.path, r.licence, r.origin, r.from_dir) for r in license_scan.scanned(files).collect()}
    assert got == {
        ("a/LICENSE", "GPL-3.0", "header", None), ("a/x.txt", "GPL-3.0", "directory", "a"), ("a/b/c/y.txt", "Apache-2.0", "directory", "a/b"),
        ("a/b/LICENSE.md", "Apache-2.0", "header", None), ("a/b/z.txt", "MIT", "header", None), ("ab/x.txt", None, None, None), ("top.txt", None, None, None),
        (None, "MIT", "header", None), ("q/LICENSE", None, None, None), ("q/x.txt", None, None, None),
    }
    assert license_scan.scanned(files).count() == len(rows)
    assert license_scan.scanned(files.limit(0)).collect() == []


def test_licence_notices_titles_and_wrapped_statements(spark):
    wrapped = "code\n# This work is licensed under\n# the GNU General Public\n# License, version 3\nmore code of another kind"
    texts = {
        "All rights reserved.": "Proprietary", "MIT License": "MIT", "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": "GPL-3.0", wrapped: "GPL-3.0",
        "Apache License\nVersion 2.0, January 2004": "Apache-2.0", license_scan.MIT_TEXT: "MIT", "the rights of all people": None, "a license to drive": None,
    }
    rows = [(f"f{i}.txt", t) for i, t in enumerate(texts)]
    got = {r.text: r.licence for r in license_scan.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == texts
    bare = spark.createDataFrame([("x", "GNU GENERAL PUBLIC LICENSE")], "path string, text string")
    assert license_scan.scanned(bare).first().licence in ("GPL-2.0", "GPL-3.0")


def test_licence_cosine_equals_brute_force(spark):

    lines = ["Licensed under CC BY-NC 4.0, see the file", "the General Public License version 2 or 3", "This work is licensed under the GNU General Public License, version 3. mit"]
    rows, idf, other = license_scan.vectors()
    for line in lines:
        tf = Counter(re.findall(license_scan.TOKEN, line.lower()))
        norm = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in tf.items()))
        cosines = Counter()
        for licence, k, token, weight in rows:
            cosines[(licence, k)] += tf[token] * idf[token] * weight / norm
        best = max((round(c, 6), name) for (name, _), c in cosines.items())
        files = spark.createDataFrame([("f", line)], "path string, text string")
        got = license_scan.headers(files, threshold=0.1).collect()
        assert got[0].score == best[0]


def test_licence_windows_equal_brute_force(spark):
    """The best cosine over all lines, windows and whole licence files, with nothing lost to the bound."""

    rng = random.Random(10)
    words = "the and or of to in is software license version public mit general 2.0 3.0 plain text here".split()
    statements = [t for _, t in license_scan.TEMPLATES]
    texts = []
    for _ in range(60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(7))]
        for _ in range(rng.randrange(3)):
            parts = rng.choice(statements).split()
            cut = rng.randrange(len(parts) + 1)
            lines[rng.randrange(len(lines) + 1) :] = [" ".join(parts[:cut]), " ".join(parts[cut:])]
        texts.append("\n".join(lines))
    paths = [f"d{k}/{'LICENSE' if k % 4 == 0 else 'x.txt'}" for k in range(len(texts))]
    rows, idf, other = license_scan.vectors()
    want = {}
    for path, text in zip(paths, texts, strict=True):
        lines = text.split("\n")
        units = [lines[i : i + k] for k in range(1, 5) for i in range(len(lines) - k + 1)] + ([lines] if path.endswith("LICENSE") else [])
        best = 0.0
        for unit in units:
            tf = Counter(re.findall(license_scan.TOKEN, "\n".join(unit).lower()))
            norm = sum((n * idf.get(t, other)) ** 2 for t, n in tf.items()) ** 0.5
            dots = Counter()
            for _, k, token, weight in rows:
                dots[k] += tf[token] * idf[token] * weight
            best = max([best, *(d / norm for d in dots.values() if norm)])
        if round(best, 6) >= license_scan.THRESHOLD:
            want[path] = round(best, 6)
    files = spark.createDataFrame(list(zip(paths, texts, strict=True)), "path string, text string").repartition(3)
    got = {r.path: r.score for r in license_scan.headers(files).collect()}
    assert want.keys() == got.keys() and len(want) > 10
    assert all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_licence_rows_of_one_path_and_without_id(spark, docs):
    mit, gpl = "Released under the MIT License", "This work is licensed under the GNU General Public License, version 3"
    files = spark.createDataFrame([("a/x", f"one\n{mit}"), ("a/x", f"two\n{gpl}"), ("a/y", "x\n" * 3 + mit)], "path string, text string")
    got = {(r.path, r.text): r.licence for r in license_scan.scanned(files).collect()}
    assert got["a/y", "x\n" * 3 + mit] == "MIT" and len({v for (p, _), v in got.items() if p == "a/x"}) == 1
    unnamed = license_scan.as_files(docs([(None, mit, "en", "s"), (None, gpl, "en", "s"), (None, None, "en", "s"), (7, "x", "en", None)]))
    got = {r.text: r.licence for r in license_scan.scanned(unnamed).collect()}
    assert got == {mit: "MIT", gpl: "GPL-3.0", None: None, "x": None}


def test_licence_units_of_common_words_stay_inside_their_row(spark):
    """Prose of template words is no candidate: copies count by their square, over lines too, and one statement must give the product."""
    rows, idf, other = license_scan.vectors()
    rng = random.Random(4)
    common = "the of and to in or any a is by it as".split()
    prose = ["\n".join(" ".join(rng.choice(common) for _ in range(40)) for _ in range(6)) for _ in range(20)]
    mit = "Released under the MIT License"
    files = spark.createDataFrame([(f"d/{'LICENSE' if i % 5 == 0 else i}", t) for i, t in enumerate([*prose, f"x\n{mit}\ny"])], "path string, text string")
    units = [r.unit for r in license_scan.candidates(files, rows, idf, other, license_scan.THRESHOLD).collect()]
    assert mit in units and all("MIT" in u for u in units)
