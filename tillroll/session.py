"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the analysis depends on for correct results (UTC dates, ANSI
# arithmetic) or for a sane plan at scale (AQE re-planning and skew splits).
SESSION_DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "tillroll",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster pass ``master=None`` and let spark-submit decide; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEM", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        # a session that exists already takes run-time settings; static ones are the builder's
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the correctness-relevant SQL settings to an existing session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(k, SESSION_DEFAULTS[k])
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The folder comes from ``spark.checkpoint.dir`` (or one already set on the
    context).  Only a local-mode session without one (tests, laptops) gets a
    private temporary folder; a cluster session without a shared folder is a
    configuration error, because a machine-local folder would not survive the
    loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) "
                       "before running iterative operators")


def materialize(df, name: str = "table"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a scan of it.

    Used where one query reads the same expensive intermediate several times
    (the deduplicated, joined invoice lines feed a rollup and a quantile
    operator, a split feeds scaling and two model passes).  Unlike an RDD
    checkpoint the table keeps column pruning and filter pushdown, and it
    lives in the shared folder, so it survives the loss of an executor.
    """
    import uuid

    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_with(df, name: str, metrics: dict):
    """As :func:`materialize`, and the values of aggregates over the rows written, by
    name: observed while they are written, or read back from the table where the
    observation brings nothing (no task ran)."""
    from pyspark.sql import Observation

    seen = Observation()
    columns = [e.alias(n) for n, e in metrics.items()]
    table = materialize(df.observe(seen, *columns), name)
    values = seen.get
    if set(values) != set(metrics):
        values = table.agg(*columns).first().asDict()
    return table, values


BROADCAST_MAX_ROWS = 200_000


def checked_broadcast(df, max_rows: int = BROADCAST_MAX_ROWS):
    """Broadcast ``df`` only if it has at most ``max_rows`` rows; otherwise it
    goes to a shuffle join, where AQE's skew-join splitting applies.  ``df`` (per-
    group statistics joined back onto line data, so that a hot group never
    funnels into one join task) is written first: what it is made from runs
    once, and its rows are counted from the files."""
    from pyspark.sql import functions as F

    small = materialize(df, "statistics")
    return F.broadcast(small) if small.count() <= max_rows else small


def cleanup_tables(spark: SparkSession) -> bool:
    """Delete the intermediate tables written by :func:`materialize` (and the
    CSV round-trip files) under ``<checkpoint dir>/tables``.  Call it when a
    reporting job is finished -- DataFrames read from those tables become
    unusable afterwards.  Uses the Hadoop FileSystem API, so it works the same
    on HDFS, object stores and local disk."""
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        return False
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base.rstrip("/") + "/tables")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True)) if fs.exists(path) else False
