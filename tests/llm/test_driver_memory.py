"""What the driver holds while many small jobs run."""

import time

from pyspark.ml.classification import LogisticRegression

from loamwork.functions import scratch
from loamwork.llm import mixing


def test_regression_reads_its_bounded_sample_as_one_partition(spark, monkeypatch):
    rows = [(i, f"{'good plain prose' if i % 2 else 'buy ### now'} word{i % 7}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    seen, fit = [], LogisticRegression.fit

    def watched(self, df, *more):
        seen.append((df.rdd.getNumPartitions(), df.count()))
        return fit(self, df, *more)

    monkeypatch.setattr(LogisticRegression, "fit", watched)  # reads small files as a partition each
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        model = mixing.train(docs, labels)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert seen == [(1, 40)]
    assert model["first"] == 0 and any(model["scores"][1][1])


def test_grown_heap_is_collected(spark, monkeypatch):
    """Tables in a row leave the heap collected once it has grown to the share, and alone below it."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    monkeypatch.setattr(scratch, "HEAP_EVERY", 0.0)
    assert not scratch.give_back(spark, 1.1)
    assert scratch.give_back(spark, heap.totalMemory() / heap.maxMemory() / 2)
    monkeypatch.setattr(scratch, "HEAP_EVERY", 3600.0)
    assert not scratch.give_back(spark, 0.0)
    spark._loamwork_collected = -3600.0
    scratch.materialize(spark.range(3), "three")
    assert spark._loamwork_collected > 0 or heap.totalMemory() < scratch.HEAP_SHARE * heap.maxMemory()


def test_heap_is_collected_within_the_regression(spark, monkeypatch):
    """The regression's jobs write no table; the heap is looked at while they run, and no longer."""
    docs = spark.createDataFrame([(i, f"{'good plain prose' if i % 2 else 'buy ### now'}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    looked, within, fit = [], [], LogisticRegression.fit
    monkeypatch.setattr(scratch, "HEAP_EVERY", 0.02)
    monkeypatch.setattr(scratch, "give_back", lambda spark: looked.append(time.monotonic()))

    def slow(self, df, *more):
        before = len(looked)
        time.sleep(0.5)
        within.append(len(looked) - before)
        return fit(self, df, *more)

    monkeypatch.setattr(LogisticRegression, "fit", slow)
    mixing.train(docs, labels)
    after = len(looked)
    time.sleep(0.1)
    assert within[0] > 1 and len(looked) == after


def test_a_collected_heap_is_trimmed(spark, monkeypatch):
    """Native memory goes back with the heap; a JVM that has no such command is no error."""
    trimmed = []
    monkeypatch.setattr(scratch, "trim", trimmed.append)
    monkeypatch.setattr(scratch, "HEAP_EVERY", 0.0)
    assert scratch.give_back(spark, 0.0) and trimmed == [spark]
    monkeypatch.undo()
    assert scratch.trim(spark) in (True, False)
