"""Session helpers: one place for the configs the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Configs every grainline job wants.  AQE re-plans joins from runtime sizes
# and splits skewed join partitions; UTC keeps date maths engine-independent.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Feature tables are wide (400+ columns).  Above maxFields whole-stage
    # codegen is switched off and the interpreted projections of a long
    # chain of broadcast joins were 16x slower in our bench; Spark still
    # falls back per stage if a generated method gets too large.
    "spark.sql.codegen.maxFields": "4000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "grainline", extra: dict | None = None,
                checkpoint_dir: str | None = None) -> SparkSession:
    """Build (or reuse) a session with grainline's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide;
    ``checkpoint_dir`` (else ``spark.checkpoint.dir``) must then be a folder
    that all executors share.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``.  When it is unset, a
    session in one process (``local``, as in tests) gets a fresh scratch
    folder; on a cluster that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        master = sc.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("spark.checkpoint.dir is not set: stage tables need a folder that all executors share "
                               f"(master {master})")
        configured = tempfile.mkdtemp(prefix="grainline-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def tune(spark: SparkSession) -> None:
    """Runtime settings for applications that bring their own session (the
    library itself never changes a caller's settings): keep whole-stage
    codegen on for wide feature stages."""
    spark.conf.set("spark.sql.codegen.maxFields", DEFAULT_CONF["spark.sql.codegen.maxFields"])


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back.  Unlike ``checkpoint()`` the copy is columnar, so later scans that
    need two columns read two columns; it also cuts the lineage and survives
    executor loss."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._stage_path = path
    return out


#: Rows of a partition that a task sorts at once.
PARTITION_ROWS = 100_000


def partitions_for(df: DataFrame) -> int:
    """Partitions of about ``PARTITION_ROWS`` rows, at least one per core.
    Counts ``df`` (of a stage table: a look at the files' footers)."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PARTITION_ROWS))


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared checkpoint folder, for what an application
    writes and reads again; ``clear_stages`` deletes it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{_stage_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _stage_folder(spark: SparkSession) -> str:
    return f"grainline-tables/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete every stage table and other file (CSV, models, archives) that
    this application wrote under the checkpoint folder: call it when a run's
    results are written, frames that read stages are of no use after it."""
    _delete(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{_stage_folder(spark)}")


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more
    (frames from elsewhere are left alone)."""
    for df in tables:
        path = df.__dict__.pop("_stage_path", None)
        if path:
            _delete(df.sparkSession, path)
