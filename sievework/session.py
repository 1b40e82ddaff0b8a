"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What every query of this library expects of a session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Texts are long: batches of fewer rows keep what the JVM and Python hold of them small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2500",
}


def local_session(cores: int | str = 4, partitions: int = 8, **conf: str) -> SparkSession:
    """A session in one JVM, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sievework")
    base = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their workers then import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # not when it came as an archive itself
        archive = Path(tempfile.mkdtemp(prefix="sievework-ship-")).resolve() / "sievework.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the defaults that can be set on a running session, and send the package to its executors."""
    ship(spark)
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local folder is used only where the setting is missing and the session runs in one JVM, as in tests.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in this application's part of it."""
    return f"{shared_folder(spark)}/sievework/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has written into the shared folder. Results that have not been read or
    stored need them, so call it at the end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/sievework/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table into the shared folder and read it again: later steps restart from it when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
