"""Session helpers: sending this package to the executors, and the folder that all of them share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_sent: set[str] = set()
_own_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application: the executors' Python may not see the
    driver's source folder. Rows can be long texts, so Arrow batches get 1,000 of them where the session says nothing."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomframe-code-")) / "loomframe.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Where that is unset, one under a temporary folder in local mode; a
    cluster must name a folder that all its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        base = _own_folders.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loomframe-"))
    return f"{base.rstrip('/')}/loomframe/{name}-{uuid.uuid4().hex}"
