"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill in settings that are
unset, so a cluster's own values (shuffle partitions, checkpoint folder, broadcast limits) win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "floodspark",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session for local runs and tests. UI stays off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", os.environ.get("FLOODSPARK_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is. Where it is
    unset, a local run (tests) gets a fresh folder under the local temp area; a cluster gets an error.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not cur:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="floodspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    try:
        spark.sparkContext.setCheckpointDir(cur)
    except Exception:  # Spark Connect sessions have no SparkContext
        pass
    return cur


def cut(df):
    """Materialise into the shared checkpoint folder (``spark.checkpoint.dir``): later passes read this
    instead of recomputing it, and a lost executor does not replay the whole lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``floodspark`` importable on executors (pandas UDFs and grouped-map functions refer to
    it): the package is zipped once per application and added with ``addPyFile``, Spark's own way of
    distributing Python code (``--py-files`` does the same at submit time)."""
    import uuid
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: code is shipped by the client
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = scratch_path(spark, "pyfiles")
    local = base[len("file:"):] if base.startswith("file:") else base
    if "://" in local:                       # object store / HDFS: the driver serves the file itself
        local = tempfile.mkdtemp(prefix="floodspark-pyfiles-")
    os.makedirs(local, exist_ok=True)
    path = os.path.join(local, f"floodspark-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("floodspark", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(path)
    _SHIPPED.add(app)
