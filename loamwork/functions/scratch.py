"""Tables in the shared scratch folder, to cut lineage durably."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_counter = itertools.count()
#: The driver's heap is collected when it has grown to this share of its limit, at most every so many seconds.
HEAP_SHARE = 0.5
HEAP_EVERY = 3.0


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local master gets a temporary folder (tests); on a
    cluster that is an error, for executors would not share the folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_loamwork_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="loamwork-")
        spark._loamwork_scratch = own
    return own


class Scratch:
    """Owns the scratch tables written while it is open, and no others.

    ``with Scratch(spark) as own: result = operator(df)``; a result reads its tables
    when it runs, so write it first, then call ``own.delete()``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.spark.__dict__.setdefault("_loamwork_scopes", []).append(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.__dict__["_loamwork_scopes"].remove(self)

    def delete(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.paths = []


def give_back(spark: SparkSession, share: float = HEAP_SHARE) -> bool:
    """Whether the driver's heap had grown to ``share`` of its limit and was collected, which returns what plans and jobs left behind.

    Left to itself the heap of many small jobs grows to its limit with little alive in it, and its pages stay with the driver.
    """
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    last = spark.__dict__.get("_loamwork_collected", -HEAP_EVERY)
    if heap.totalMemory() < share * heap.maxMemory() or time.monotonic() - last < HEAP_EVERY:
        return False
    spark._loamwork_collected = time.monotonic()
    heap.gc()
    trim(spark)
    return True


def trim(spark: SparkSession) -> bool:
    """Whether the driver's JVM gave freed native memory back, which hundreds of threads otherwise keep in arenas of their own; not every JVM can."""
    jvm, objects = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        named = jvm.java.lang.Class.forName
        # By the interface: the server's own class is not open to calls from outside its module.
        kinds, values = objects(jvm.java.lang.Class, 4), objects(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        values[2], values[3] = objects(jvm.java.lang.Object, 0), objects(jvm.java.lang.String, 0)
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


@contextlib.contextmanager
def heap_watched(spark: SparkSession) -> Iterator[None]:
    """While it is open, the driver's heap is collected as by ``materialize``, for jobs in a row that write no tables."""
    over = threading.Event()

    def watch() -> None:
        while not over.wait(HEAP_EVERY):
            give_back(spark)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    Cuts lineage durably (the files outlive executors) and runs the plan once,
    where an eager ``checkpoint()`` would run its last stage twice. The innermost
    open ``Scratch`` owns the table; without one it stays until ``release``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loamwork/{uuid.uuid4().hex[:12]}-{next(_counter)}-{name}"
    scopes = spark.__dict__.get("_loamwork_scopes") or [spark.__dict__.setdefault("_loamwork_rest", Scratch(spark))]
    scopes[-1].paths.append(path)
    df.write.parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the session's scratch tables that no ``Scratch`` owns; results that still read them fail afterwards."""
    rest = spark.__dict__.get("_loamwork_rest")
    if rest:
        rest.delete()
