"""Session settings the operators count on, and reliable lineage cuts."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings: adaptive re-planning splits the partitions of a hot join
# key and coalesces the small ones, so no operator fixes a partition count.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Tables whose size was measured may be broadcast to this size; estimates from files,
    # which are packed, keep the lower bound of the session.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(48 << 20),
    "spark.sql.session.timeZone": "UTC",
    # The JVM does not compile methods beyond this size. A plan of very many columns would
    # run interpreted as one; beyond the limit Spark generates code by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Start-up settings: checkpoint files are removed with the frames that read them.
CLEANING_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to a running session."""
    for key, value in ADAPTIVE_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "freightlens", master: str | None = None, **conf) -> SparkSession:
    """A session with the adaptive settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in CLEANING_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that functions
    that run there find it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_freightlens_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="freightlens-")
    root = Path(__file__).resolve().parent.parent
    context.addPyFile(shutil.make_archive(
        f"{folder}/freightlens", "zip", root_dir=root, base_dir="freightlens"))
    context._freightlens_sent = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of lineage cuts, as the cluster names it in
    ``spark.checkpoint.dir``.

    Where none is named a temporary folder serves, on a local master only: on a
    cluster every machine would write to a disk of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError(
                    "spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="freightlens-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there,
    so that a lost executor costs a re-read and not a replay. The files go when
    the result is no longer referenced, if the session cleans checkpoints (see
    ``CLEANING_CONF``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again: a
    lineage cut like :func:`reliable_checkpoint`, but compressed, read by column, and of
    a size that the optimizer knows, so that small tables are broadcast. The files stay
    until the folder goes."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stored-{uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
