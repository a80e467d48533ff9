"""Session, table and shared-folder helpers used by every part of the library."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers where PYTHONPATH or their folder doesn't already.

    Spark distributes the archive to the executors; nothing reads the driver's copy later."""
    app = spark.sparkContext.applicationId
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or _ROOT in known or Path.cwd().resolve() == _ROOT:
        return
    with tempfile.NamedTemporaryFile(suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted((_ROOT / "lodestone").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(f.name)
    atexit.register(lambda: os.path.exists(f.name) and os.unlink(f.name))
    _shipped.add(app)


#: Bytes of the Arrow batches that Python workers are handed; a worker holds two at once, the one that it reads and the one before.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have BATCH_BYTES at most, else one is as large as its task's input, up to 10,000 rows or 64 MB.

    The limit is the session's, for Spark has none for one operator; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where a session has none
    (a single machine, as in tests) a temporary folder becomes it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = current.get() if current.isDefined() else None
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="lodestone-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lodestone/{label}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lodestone_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of persist_table that no result reads any more."""
    remove(df.sparkSession, df.lodestone_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that scratch() gave."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until none is among the columns in any case."""
    used = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out
