"""What the driver's JVM has freed goes back to the system, at the beginning and the end of every stage of the pipeline."""

import re

import pytest

import corpus_pipeline
from tillwork import session


def _resident_mb(spark):
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    return int(re.search(r"RssAnon:\s+(\d+)", open(f"/proc/{pid}/status").read())[1]) / 1024


def test_freed_native_memory_is_handed_back(spark):
    if not session.trim_driver(spark):
        pytest.skip("this JVM has no command that trims native memory")
    made = [spark.sparkContext._jvm.java.util.zip.Deflater() for _ in range(600)]
    for deflater in made[:-1]:  # the last one lies behind the others and keeps their memory from shrinking
        deflater.end()
    held = _resident_mb(spark)
    assert session.trim_driver(spark)
    left = _resident_mb(spark)
    made[-1].end()
    assert held - left > 20


def test_a_jvm_without_the_command_is_left_alone(spark, monkeypatch):
    def absent(*_):
        raise session.Py4JError("no such command")

    monkeypatch.setattr(spark.sparkContext._gateway, "new_array", absent)
    assert session.trim_driver(spark) is False


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_every_stage_trims_before_and_after(spark, odd, root, monkeypatch, name, stage):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "trim_driver", lambda s: seen.append("trim"))
    for operator in ("fit_quality", "score_quality", "one_of_each_group", "without_leaks", "fit_scanner", "redact_secrets", "mix_sources"):
        own = getattr(corpus_pipeline, operator)
        monkeypatch.setattr(corpus_pipeline, operator, lambda *a, own=own, **k: seen.append("work") or own(*a, **k))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    out = stage(spark, odd, root(labels=labels, benchmark=benchmark))
    assert seen[0] == seen[-1] == "trim" and set(seen[1:-1]) == {"work"} and "doc_id" in out.columns
