"""Session helpers: a local session for tests and benches, and the
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Session settings the gate relies on (AQE for skew and coalescing).  Local
#: sessions get them; the library never changes a caller's session.
GATE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plan text is rendered for every execution; audits read many frames
    "spark.sql.maxPlanStringLength": "100000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tollgate") -> SparkSession:
    """A local session for tests and benches (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "false")
    )
    for key, value in GATE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, wiring it from the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is.  Only a local-mode session without the setting (tests,
    benches) gets a fresh private folder.  A cluster session without the
    setting is an error: a machine-local folder would not survive the loss
    of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a shared folder for it")
        configured = tempfile.mkdtemp(prefix="tollgate-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a derived frame: its rows are written once to
    the cluster's checkpoint folder and later plans start from there (short
    plans, and a lost executor recomputes from the files, not the lineage)."""
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the checkpoint folder and reread: its lineage
    ends there as with ``cut_lineage``, and later plans read only the columns they use."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # what led here is not needed again; Spark frees shuffle files only as the driver collects garbage
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once in each application:
    a zip in the shared folder of ``spark.checkpoint.dir``, added to the job."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{root.name}-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(data.getvalue())
    out.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(sc.applicationId)
