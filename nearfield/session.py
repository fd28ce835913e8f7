"""Session settings and lineage cutting."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

# Vector rows are wide: 4,096 of them at 1,024 floats are a 16 MB Arrow batch.
ARROW_ROWS = 4096


def local_session(app: str = "nearfield", cpus: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a temporary one only where none is named."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        named = tempfile.mkdtemp(prefix="nearfield-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs no recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows and text bytes of a short helper table that are still sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def short_table(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a helper table once and broadcast it only if it is as short and narrow as expected."""
    held = materialise(df)
    wide = [F.sum(F.octet_length(c)) for c, kind in held.dtypes if kind in ("string", "binary")]
    total = sum((F.coalesce(part, F.lit(0)) for part in wide), F.lit(0))
    size = held.agg(F.count(F.lit(1)).alias("n"), total.alias("bytes")).first()
    return broadcast(held) if size["n"] <= rows and size["bytes"] <= BROADCAST_BYTES else held


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application (as ``--py-files`` would)."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="nearfield-")) / package.name),
            "zip",
            root_dir=package.parent,
            base_dir=package.name,
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
