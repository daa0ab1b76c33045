"""Stages on the small tables, and the entry point with and without this package."""

import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from odd_docs import texts
from winnow.llm import decontam, minhash, secrets
from winnow.llm.common import stored

ROOT = Path(__file__).resolve().parents[2]


def test_stages_take_effect(spark, documents, sf_dir):
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == documents.columns and dict(docs.dtypes) == dict(documents.dtypes)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * documents.count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.leaks(docs, bench).count() == 0
    assert minhash.near_duplicates(docs).where("class_size > 1").count() == 0
    assert not any(secrets.base_spans(t) for _, t in texts(docs))
    name, last = corpus_pipeline.STAGES[-1]
    packed = last(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in texts(docs)}


def test_odd_documents(spark, odd, none, sf_dir):
    for rows in (odd, none):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and rows.columns[:3] == ["doc_id", "start", "length"]


def test_the_rest_works_without_this_package(tmp_path):
    for name in ("winnow", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    (tmp_path / "winnow" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
