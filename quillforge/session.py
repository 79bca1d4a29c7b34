"""Session helpers: the test session and shipping this package to Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quillforge")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    session = builder.config(map=settings | conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it from anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(), "quillforge.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of at most three longs that are sent to every executor at once: about 25 MB.
BROADCAST_ROWS = 1_000_000


def sent_if_small(keys: DataFrame) -> DataFrame:
    """keys (a written table of ids, or a short list) with a broadcast hint if it has at most BROADCAST_ROWS rows; beyond that, as it is."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all tasks run on this machine one is set
    here if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
