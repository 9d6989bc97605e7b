"""Session helpers: the factory, the shared scratch folder, and materialising intermediate results there."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows a side may have to be broadcast where its rows are a few numbers wide (some MB); beyond it a shuffle join is used.
BROADCAST_ROWS = 200_000


def build_session(app: str = "daftar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and AQE. ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir of the session.

    Only a local master (tests) may go without; then it is a folder of this machine, removed at exit.  On a cluster
    an unset folder is an error, as executors would write to their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(spark.sparkContext, "_daftar_scratch", None)
    if known is None:
        own = tempfile.mkdtemp(prefix="daftar-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        known = "file://" + own
        spark.sparkContext._daftar_scratch = known
    return known


def own_folder(spark: SparkSession) -> str:
    """This application's folder below the scratch folder."""
    return f"{scratch_dir(spark)}/daftar-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession) -> str:
    """A new path below this application's folder; the folder goes when the process ends, if not released before."""
    if not getattr(spark.sparkContext, "_daftar_release", False):
        spark.sparkContext._daftar_release = True
        atexit.register(_delete, own_folder(spark), spark._jvm, spark._jsc.hadoopConfiguration())
    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


def _delete(path: str, jvm, conf) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone; then the folder stays
        pass


def release(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` wrote in this application; frames read from them cannot be used any more."""
    _delete(own_folder(spark), spark._jvm, spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the scratch folder and read it back: ends the lineage, survives the loss of executors."""
    spark = df.sparkSession
    at = fresh(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, which should be cheap to count (cut), has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows
