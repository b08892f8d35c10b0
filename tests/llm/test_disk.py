"""What the join and the pipeline leave on disk."""

import os
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import common, jaccard


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"{tmp_path}/{uuid.uuid4().hex}")
    return tmp_path


def texts(n=400):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 200)), f"s{i % 3}") for i in range(n)]
    return rows + [(n + i, t + " end", s) for i, t, s in rows[: n // 4]]


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def shuffles(spark):
    """Shuffles that have files."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
    return {x.split("_")[1] for x in blocks if x.startswith("shuffle_")}


def test_no_copy_of_the_documents_stays(spark, folder):
    docs = spark.createDataFrame(texts(), "doc_id long, text string, source string")
    docs.write.parquet(f"{folder}/in")
    got = jaccard.one_of_each(spark.read.parquet(f"{folder}/in"))
    assert size(folder) < 1.1 * size(f"{folder}/in")
    assert sorted(r.doc_id for r in got.collect()) == list(range(400))


def test_shuffle_files_go_with_their_query(spark, folder):
    before, setting = shuffles(spark), spark.conf.get(common.CLEANUP, None)
    with common.Scratch(spark) as work:
        table = work.keep(spark.range(1000).groupBy(F.col("id") % 7).count(), "table")
        other = work.keep(table.repartition(3, "count"), "other")
        for _ in range(50):  # they are deleted in the background
            if not (left := shuffles(spark) - before):
                break
            time.sleep(0.2)
        assert not left
        work.drop(table)
        assert other.count() == 7 and len([x for x in os.scandir(work.folder)]) == 1
    assert spark.conf.get(common.CLEANUP, None) == setting


def test_passes_give_all_keys(spark, folder):
    docs = spark.createDataFrame(texts(80), "doc_id long, text string, source string")
    with common.Scratch(spark) as work:
        join = jaccard.Join(docs, work.keep(jaccard.set_rows(docs, 5), "rows"), 5, 80, work)
        parts = [{r.key for r in join.shared_keys(at, 3).collect()} for at in range(3)]
        whole = {r.key for r in join.shared_keys().collect()}
    assert all(parts) and set.union(*parts) == whole and sum(map(len, parts)) == len(whole)


def test_stages_leave_one_table(spark, folder, monkeypatch):
    spark.createDataFrame(texts(100), "doc_id long, text string, source string").write.parquet(f"{folder}/in/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("same", lambda _, docs, __: docs), *corpus_pipeline.STAGES[-3:]])
    got = corpus_pipeline.run(spark, f"{folder}/in")
    tables = [x.name for x in os.scandir(folder) if x.name != "in"]
    assert len([x for x in tables if x.endswith("-mixing")]) == 1 and not [x for x in tables if "same" in x or "near_copies" in x]
    assert sum(size(f"{folder}/{x}") for x in tables) < 1.1 * size(f"{folder}/in")
    assert sorted(r.doc_id for r in got.collect()) == list(range(100))
