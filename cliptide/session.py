"""Session, checkpoint and size-check helpers shared by every operator."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that an operator may hint as a broadcast side.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def get_session(app_name: str = "cliptide", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the workers, once per application, so that folds can be unpickled anywhere."""
    context = spark.sparkContext
    if getattr(context, "_cliptide_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="cliptide-package-")
    name = os.path.join(folder, "cliptide.zip")
    Path(name).write_bytes(packed.getvalue())
    context.addPyFile(name)
    context._cliptide_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="cliptide-checkpoint-")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iteration's result to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether a count proves that the table fits; it stops at the first row beyond the limit."""
    most = max(1, limit_bytes // max(1, row_bytes))
    return df.limit(most + 1).count() <= most


def broadcast_when_small(
    df: DataFrame, row_bytes: int, limit_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Hint a broadcast only if a count proves the table fits; otherwise leave a shuffle join.

    The count stops at the first row beyond the limit, so a large table costs no full pass.
    """
    return F.broadcast(df) if fits_broadcast(df, row_bytes, limit_bytes) else df


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has slots.

    Looks at the planned splits only. A large input has more splits than slots and is left alone,
    so nothing is shuffled at scale; a small file with one row group would keep one core busy.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
