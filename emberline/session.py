"""Session defaults, the folder that executors share, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HOT_ROWS_KEY = "spark.emberline.hotRows"


def build_session(app: str = "emberline", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call-site capture costs a round trip to the JVM for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    """Rows of one key above which its series is cut into chunks (default one million)."""
    return int(spark.conf.get(HOT_ROWS_KEY, "1000000"))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors of a cluster can reach.

    Without one, a session in local mode (one machine, as in tests) gets a temporary folder. On a cluster that is an
    error: each executor would write to its own disk and readers would miss rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application; needed wherever a task calls a function of it."""
    sc = spark.sparkContext
    if getattr(sc, "_emberline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "emberline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._emberline_shipped = True
