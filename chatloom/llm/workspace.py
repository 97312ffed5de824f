"""Tables that an operator writes on its way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Seconds between two calls that have the driver's JVM give back native memory that it has freed.
TRIM_S = 2.0
_trimmed = [float("-inf")]


def trim_driver(spark: SparkSession) -> str | None:
    """Has the driver's C library return freed memory to the system; what the JVM says of it, None where it was too soon or it cannot.

    Hundreds of small jobs leave freed blocks in the arenas of the threads that planned and compiled them, outside the
    heap, where neither the heap's bound nor its collector reaches them. It changes no result and no live object.
    """
    if time.monotonic() - _trimmed[0] < TRIM_S:
        return None
    _trimmed[0] = time.monotonic()
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    try:
        # by reflection: the server's own class is not open to Py4J
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        arguments = gateway.new_array(jvm.Object, 4)
        arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JError:  # another JVM, or one before 17.0.9
        return None


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset on a single machine (as in tests), a local folder that this sets."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='chatloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Names tables below one new folder. save() cuts lineage: a lost executor costs a reread, not the whole job."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/chatloom-{label}-{uuid.uuid4().hex}"

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        trim_driver(self.spark)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
