"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "tierlake", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling). ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only a local master without one gets a temporary folder.

    A cluster without the setting is refused, since executors could not share a machine-local folder.
    """
    ship_package(spark)  # operators that checkpoint have Python workers too
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tierlake-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def python_partitions(spark: SparkSession) -> int:
    """Partitions for rows that go to Python: adaptive execution would merge what takes little space but much time, so the number is given."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that they need no path to it."""
    sc = spark.sparkContext
    if any(Path(p).name == "tierlake.zip" for p in sc._python_includes):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tierlake-")) / "tierlake.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(str(target))
