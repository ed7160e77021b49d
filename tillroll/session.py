"""Session construction and the shared scratch location.

Production sessions are created by the cluster; ``build_session`` is for
tests, the bench and local runs. ``shared_dir`` always resolves scratch
space under the cluster-wide ``spark.checkpoint.dir`` so that every
executor (and a restarted driver) sees the same files.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale. AQE coalesces the shuffle partitions down
# to ``advisoryPartitionSizeInBytes`` at runtime, splits skewed join
# partitions, and turns a sort-merge join into a broadcast join when the
# measured shuffle side turns out small. The static broadcast threshold is
# Catalyst's own size check; anything above it takes the shuffle path.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tillroll", extra: dict | None = None) -> SparkSession:
    """A session with the settings above wherever nobody has set another.

    What spark-submit, the cluster's defaults or an existing session give
    stays as it is; ``shuffle_partitions`` and ``extra`` are what the caller
    asks for expressly.
    """
    existing = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName(app_name)
    if master:  # under spark-submit the cluster's master is used
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEMORY", "16g"))
            builder = builder.config("spark.ui.enabled", "false")
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if existing is None:
        given = spark.sparkContext.getConf()
        for k, v in SCALE_CONF.items():
            if not given.contains(k) and spark.conf.isModifiable(k):
                spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a
    local session gets a private folder; on a cluster that is an error, since
    a folder of one machine is not shared. Under Spark Connect there is no
    SparkContext; the server's setting is used as is.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        return spark.conf.get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _fs(spark: SparkSession, path: str):
    """Hadoop path and its file system, whatever the scheme (or the default) names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def path_is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder (none if it does not exist)."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def read_small(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_small(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a temporary name and rename it: readers see it
    whole or not at all. False, and nothing changed, where the path is taken."""
    p, fs = _fs(spark, path)
    tmp, _ = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.exists(p) and fs.rename(tmp, p):
        return True
    fs.delete(tmp, False)
    return False


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, uniquely named folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tillroll/{name}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme (for test helpers writing with plain Python)."""
    return uri[len("file:"):] if uri.startswith("file:") else uri
