"""The stages on rows with every edge, the registered queries, and the library without this subpackage."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import __spark_entry__ as entry
import pytest
from compare import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NUMBERED = ["op1_toxicity", "op2_license_scan", "op3_language_id", "op4_exact_top_k", "op5_secret_scan", "op6_sentencepiece", "op7_exact_dedup",
            "op8_pii", "op9_minhash_near_dedup", "op10_best_fit_packing", "op11_spelling_variants", "op12_bit_plane_output", "op13_source_divergence"]


def test_all_queries_are_there():
    assert [q for q in entry.queries() if q.startswith("op")] == NUMBERED and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_license_scan", "op4_exact_top_k", "op7_exact_dedup", "op11_spelling_variants", "op13_source_divergence"])
def test_twins(spark, sf, name):
    ok, _, note = compare(spark, duck(sf), sf, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_stages(spark, sf, tmp_path):
    text = "some words that make a text long enough to have several shingles in it " * 3
    rows = [(1, text), (2, text), (3, text + "and more"), (4, None), (5, ""), (6, "write to ann@mail.example.com"), (None, "no id"), (7, "x " * 60_000),
            (8, "You idiot. " + text.replace("words", "pathetic loser")), (6, "write to ann@mail.example.com")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.01" if name == "toxicity" else sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
        docs, seen[name] = after, after.collect()
    ids = {name: sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) for name, rows in seen.items()}
    assert ids["toxicity"] == [-1, 1, 2, 3, 4, 5, 6, 6, 7] or ids["toxicity"] == [-1, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert [i for i in ids["exact_dedup"] if i < 8] == [-1, 2, 3, 5, 6, 7]  # null and empty text are equal
    assert [i for i in ids["near_dedup"] if i < 8] == [-1, 2, 5, 6, 7]
    assert not any("ann@" in (r.text or "") for r in seen["pii"])
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["pii"]}


def test_whole_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = entry.queries()["pipeline"](spark, sf)
    left = got.select("doc_id").distinct().count()
    assert 0 < left < docs.count()


def test_stages_on_an_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = out if name != "packing" else docs


def test_the_rest_works_alone(tmp_path):
    """Without this subpackage the entry imports and has its other queries."""
    shutil.copytree(os.path.join(ROOT, "folioframe"), tmp_path / "folioframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'c3_region_merge' in q and not any(n.startswith('op') for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
