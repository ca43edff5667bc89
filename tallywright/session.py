"""A session with this library's defaults, and the library itself for executors that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_local_dir: dict[str, str] = {}


def session(name: str = "tallywright", **conf: str) -> SparkSession:
    """The running session, or a new one: UTC, adaptive execution, states of streams on disk, and what conf says (underscores stand for dots)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, which only a local master may use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tallywright-"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application; Spark distributes the archive."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tallywright-")) / "tallywright_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
