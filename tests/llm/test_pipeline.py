import os

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from textloom.llm.common import relieve_executors, scratch, shared_dir, stored, trim_jvm  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    texts = [" ".join(f"{a}{b}" for a in ("ba", "bo", "ta") for b in ("bab", "tob", "ot"))[k % 5 :] + f" ba bo tab {'bot ' * (k % 7)}" for k in range(60)]
    rows = [(k, t, "aa", "s", len(t)) for k, t in enumerate(texts)] + [(100, None, "aa", "s", 0), (101, "", None, None, None), (102, "12 34", "aa", "s", 1), (3, texts[3], "aa", "s", 1), (103, "B#T!! $$ " * 9, "aa", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("cls", __import__("pyspark").sql.functions.lit(1))
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stored(stage(spark, now, str(tmp_path)), name)
        seen[name] = [r.doc_id for r in now.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == before.columns
    assert not {100, 101, 102} & set(seen["language_id"]) and set(range(60)) <= set(seen["language_id"])
    assert 103 not in seen["quality_classifier"] and len(set(range(60)) & set(seen["quality_classifier"])) >= 58
    assert len(seen["near_duplicates"]) == len(set(seen["near_duplicates"])) > 0
    assert set(seen["best_fit_packing"]) == set(seen["near_duplicates"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["best_fit_packing"])
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stored(stage(spark, none, str(tmp_path)), name)
        assert none.count() == 0


def test_stages_leave_no_large_frames(spark, tmp_path):
    """Only the few rejected keys, which the returned plan reads, stay in the shared folder."""
    rows = [(k, f"ba bo tab {'bot ' * (k % 7)}{'tob' * (k % 3)} ot{k // 2}", "aa", "s", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = shared_dir(spark).removeprefix("file:")
    for name, least in (("language_id", set()), ("quality_classifier", {"rejected"}), ("near_duplicates", {"gone"})):
        before = set(os.listdir(folder))
        left = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == least
        assert left.count() > 0


def test_scratch_keeps_what_it_is_told(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with scratch(spark) as keep:
        with scratch(spark) as hold:
            inner, gone = hold(stored(spark.range(3), "inner")), stored(spark.range(0), "none")
            assert gone.count() == 0 and len(set(os.listdir(folder)) - before) == 2
        outer = keep(stored(inner.groupBy("id").count(), "outer"))
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"outer"} and outer.count() == 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == conf


def test_executors_collect_their_garbage(spark):
    """The session is local, so the executor is the driver's JVM."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    collected = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = collected()
    relieve_executors(spark)
    assert collected() > before


def test_the_drivers_jvm_gives_freed_memory_back(spark, monkeypatch):
    assert trim_jvm(spark).startswith("Trim native heap")
    from textloom.llm import common

    trims = []
    monkeypatch.setattr(common, "trim_jvm", trims.append)
    common.forget(spark)
    assert trims == [spark]
    # and while a frame is written
    stored(spark.range(1, numPartitions=1).selectExpr("id", "reflect('java.lang.Thread', 'sleep', 1000L * (1 + id)) as slept"), "slow")
    assert len(trims) > 1
