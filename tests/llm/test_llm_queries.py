"""The registered queries, the pipeline, and that nothing else needs this package."""

import re
import subprocess
import sys
from pathlib import Path

import brute
import pytest
from check_sql import base_tables, compare

import corpus_pipeline
from fleetlens.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), base_tables(FOLDER), SQL[name]).startswith("ok")


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


def test_op8_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = brute.jaccard(rows)
    got = QUERIES["op8_jaccard_join"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want


def test_op6_equals_brute_force(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op6_secret_scan"](spark, FOLDER).collect():
        spans = brute.secrets(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, *_ in spans) for kind in ("assign", "access", "hex")]
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))


def test_op3_finds_whole_items(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontamination"](spark, FOLDER).collect()}
    assert want and want <= got


def test_op2_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = [r for r in QUERIES["op2_language_id"](spark, FOLDER).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op10_finds_the_planted_lines(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op10_license_scan"](spark, FOLDER).collect():
        if "Released under the MIT License." in texts[r.doc_id].split("\n"):
            assert (r.licence, r.origin) == ("MIT", "header")


def test_pipeline_stages(spark, docs, folder):
    prose = " ".join(f"ward{i % 7} melo{i % 11} tine{i % 13}" for i in range(60))
    item = "what is the shortest way from one end of the garden to the other end if you may not walk on grass"
    rows = [(i, f"{prose} unique{i} number{i * 7} " + " ".join(f"extra{i}x{k}" for k in range(40)), "en", "s", 1) for i in range(10)]
    rows += [(20, rows[0][1], "en", "s", 1), (21, rows[1][1] + " tail", "en", "s", 1), (22, "123 456", "en", "s", 1), (23, None, None, None, None)]
    rows += [(24, "start " + item + " stop", "en", "s", 1), (25, rows[2][1][::-1] + " token = abcdefgh12345", "en", "t", 1)]
    rows += [(None, rows[3][1], "en", "s", 1), (4, rows[4][1], "en", "s", 1)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    path = folder(documents=docs(rows), benchmark=benchmark)
    step, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, path)
        assert step.columns == docs([]).columns
        kept[name] = [r.doc_id for r in step.collect()]
    assert not {22, 23} & set(kept["language_id"]) and 24 in kept["language_id"]
    assert sorted(x for x in kept["jaccard_join"] if x is not None) == [*range(10), 24, 25]
    assert 24 not in kept["decontamination"] and len(kept["decontamination"]) == len(kept["jaccard_join"]) - 1
    assert sorted(kept["secret_scan"], key=repr) == sorted(kept["decontamination"], key=repr)
    assert set(kept["source_mix"]) <= set(kept["secret_scan"])
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id or -1 for r in out) == sorted(x or -1 for x in kept["source_mix"])
    assert not any("abcdefgh12345" in (r.text or "") for r in out)


def test_stages_keep_extra_columns(spark, docs, folder):
    """Columns that are called like something a stage computes keep their values."""
    from pyspark.sql import functions as F

    names = ["_id", "_leaked", "score", "lang_pred", "size", "target", "copies", "base", "spans", "_rest", "component_id", "pack"]
    words = [f"ward{i} melo{i % 3} tine{i % 5} sola{i % 7}" for i in range(40)]
    rows = [(i, " ".join(words[i : i + 25]) + f" token = abcdefgh1234{i}", "en", "s", 1) for i in range(0, 12, 3)]
    rows += [(50, rows[0][1], "en", "s", 1), (None, "plain words here", "en", "t", 1)]
    full = docs(rows).select("*", *[F.concat(F.lit(name), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(name) for name in names])
    path = folder(documents=full.select(*names[:5], *docs([]).columns, *names[5:]), benchmark=spark.createDataFrame([(1, "none of it")], "item_id long, text string"))
    step = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, step, path)
        assert kept.columns == step.columns
        step = folder(documents=kept)
        step = spark.read.parquet(f"{step}/documents.parquet")
        found = step.collect()
        assert found and all(r[name] == f"{name}{-1 if r.doc_id is None else r.doc_id}" for r in found for name in names)


def test_stages_remove_their_tables(spark, docs, folder):
    import os

    from fleetlens.functions.tables import shared_folder

    rows = [(i, " ".join(f"w{i}x{k} common{k % 9}" for k in range(50)), "en", "s", 1) for i in range(20)]
    path = folder(documents=docs(rows), benchmark=spark.createDataFrame([(1, "none of it")], "item_id long, text string"))
    top = os.path.join(shared_folder(spark), "fleetlens")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    out = corpus_pipeline.run(spark, path)
    left = {x.rpartition("-")[0] for x in set(os.listdir(top)) - before}
    assert out.count() and "pipeline-source_mix" in left and not {"sets", "classes", "pipeline-jaccard_join"} & left


def test_pipeline_of_nothing(spark, docs, folder):
    path = folder(documents=docs([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).collect() == []


def test_nothing_else_imports_this_package():
    code = (
        "import sys; sys.modules['fleetlens.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = e.queries(); assert names and not [n for n in names if n[:2] == 'op' or n == 'pipeline']"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
