"""Rules by their literals find what the plain scan finds."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.operators import rule_index, scanners

RULE = "rule_no long, label string, severity string, pattern string, fix string"


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("token\\s*=", ["token"]), ("(?i)licen[sc]e", ["licen"]), ("(foo|barbaz)x?quux", ["quux"]), ("(?:alpha|beta)[0-9]", ["alpha", "beta"]),
        ("[0-9]{16}", None), ("ab?c", None), ("(abc)*x", None), ("(abc){2}", ["abc"]), ("a|bcd", None), ("\\p{L}+abc", None), ("(", None),
        ("(?<=key)value", ["value"]), ("Größe12", ["e12"]), ("", None), ("x(?!secret)yz", None), ("(?P<n>name)(?P=n)", ["name"]),
    ],
)
def test_literals(pattern, want):
    assert rule_index.literals(pattern) == want


@settings(max_examples=300, deadline=None)
@given(
    st.recursive(
        st.sampled_from(["abc", "x", "Key", "[0-9]", ".", "\\s", "^", "$"]),
        lambda inner: st.one_of(
            st.lists(inner, min_size=2, max_size=3).map("".join),
            st.lists(inner, min_size=2, max_size=3).map(lambda x: "(?:" + "|".join(x) + ")"),
            inner.map(lambda x: f"(?:{x})*"), inner.map(lambda x: f"(?:{x})+"), inner.map(lambda x: f"(?:{x})?"),
        ),
        max_leaves=8,
    ),
    st.text("abcxKeykEY01 ", max_size=14),
)
def test_every_match_holds_a_literal(pattern, text):
    found = rule_index.literals(pattern, 1)
    match = re.search(pattern, text, re.IGNORECASE)
    if match and found is not None:
        assert any(word in match[0].lower() for word in found)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    words = [f"{rng.choice(['api', 'db', 'svc'])}_{rng.randrange(3000)}" for _ in range(500)]
    shapes = ["{}", "(?i){}", "{}\\s*=", "^{}", "{}$", "(?:{}|never{})", "[0-9]+{}", "x*{}y?"]
    rules = [(n, f"r{n}", "low", rng.choice(shapes).replace("{}", w), "") for n, w in enumerate(words)]
    rules += [(9000, "digits", "high", "[0-9]{6}", ""), (9001, "back", "low", r"(q)\1", ""), (9002, "none", "low", None, "")]
    lines = [" ".join(rng.choice([rng.choice(words), "plain", "API_7 =", "1234567", "qq", "x"]) for _ in range(6)) for _ in range(300)]
    files = spark.createDataFrame([("r", f"f{k}", "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(30)], "repo string, path string, content string")
    return files, spark.createDataFrame(rules, RULE)


@pytest.mark.parametrize("chars", [1 << 22, 1500])
def test_index_equals_plain_scan(many, chars, monkeypatch):
    monkeypatch.setattr(rule_index, "AUTOMATON_CHARS", chars)
    files, rules = many
    got = sorted((r.path, r.line_no, r.rule_no) for r in rule_index.scan(files, rules).collect())
    listed = [tuple(r) for r in rules.where("pattern IS NOT NULL").orderBy("rule_no").collect()]
    want = set()
    for path, content in [(r.path, r.content) for r in files.collect()]:
        for n, line in enumerate(content.split("\n"), 1):
            want |= {(path, n, no) for no, _, _, p, _ in listed if re.search(p, line)}
    assert got == sorted(want) and len(got) > 200
    plain = scanners.custom_rules(files, [r[1:] for r in listed[:40]]).collect()
    assert {(r.path, r.line_no, r.rule_no) for r in plain} == {x for x in want if x[2] < 40}


def test_five_thousand_rules_read_contents_once(spark, many):
    files, _ = many
    rules = spark.createDataFrame([(n, "l", "low", f"needle{n:05d}", "") for n in range(5000)], RULE)
    found = rule_index.scan(files, rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("MapInArrow") == 1
    assert found.count() == 0


def test_no_rules_and_named_rest(spark, many):
    files, rules = many
    assert rule_index.scan(files, rules.limit(0)).count() == 0
    assert {r.rule_no for r in rule_index.without_literals(rule_index.with_literals(rules)).collect()} >= {9000, 9001}
