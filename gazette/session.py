"""Session helpers: configuration defaults and the checkpoint directory."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults that matter at scale: adaptive execution (runtime coalescing,
# broadcast conversion only for sides measured small, skew-join splitting)
# and Arrow for the few Python stages.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "gazette",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    On a cluster the directory comes from ``spark.checkpoint.dir`` (a shared
    folder) and is required. Only on a local master, where it may be unset
    (tests), a private temporary directory is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="gazette-ckpt-")
        try:       # informational only; some deployments refuse runtime core-conf changes
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # noqa: BLE001
            pass
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint directory for intermediate tables."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df):
    """Deal a text input into as many partitions as the caller has set in ``gazette.input.partitions``.

    Unset (the default), the scan's own splits are used. A caller whose input is
    one small file with one row group sets it, so that text work is not one task.
    """
    n = df.sparkSession.conf.get("gazette.input.partitions", None)
    return df.repartition(int(n)) if n else df


def broadcast_if_small(df, rows: int = 200_000):
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else as it is (Spark shuffles).

    Counting runs the plan, so pass a checkpointed or stored frame.
    """
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at ``path`` (any file system that Spark reads)?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gazette`` importable on executors (their Python workers run the
    Arrow-batched stages). The package is zipped once per application and
    distributed with ``addPyFile``, as ``--py-files`` would on a cluster."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    import gazette
    pkg = os.path.dirname(os.path.abspath(gazette.__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="gazette-pkg-"), "gazette.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
