"""Makes the package importable in Python workers, wherever they run, and bounds what they are sent at once."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
#: Bytes of an Arrow batch between the JVM and a Python worker, unless the session's configuration names its own bound;
#: Spark's own bound counts 10,000 rows, which are tens of megabytes of whole texts on either side.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to the executors, unless PYTHONPATH already leads them to it, and bounds Arrow batches."""
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH_KEY):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    on_path = any(p and Path(p).resolve() == _ROOT.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if on_path or getattr(context, "_chatloom_shipped", False):
        return spark
    archive = Path(tempfile.mkdtemp(prefix="chatloom-")) / "chatloom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(_ROOT.rglob("*.py")):
            out.write(module, module.relative_to(_ROOT.parent))
    context.addPyFile(str(archive))
    context._chatloom_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset on a single machine (as in tests), a local folder that this sets."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='chatloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and a lost executor costs a reread."""
    path = f"{shared_folder(frame.sparkSession)}/chatloom-{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
