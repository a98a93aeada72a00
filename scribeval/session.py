"""Spark session settings used by the library, the tests and the bench.

On a cluster the session normally exists already (spark-submit, notebooks);
``configure`` only fills in settings the library relies on and never overrides
what the cluster set (``spark.checkpoint.dir`` above all).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in the library assumes.
REQUIRED_CONF = {
    # All instants are compared in UTC (turn events, run timestamps).
    "spark.sql.session.timeZone": "UTC",
    # Parquet TIMESTAMP columns written without a zone would otherwise become
    # TIMESTAMP_NTZ, which watermarks reject.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
}

# Settings that help at scale; applied only when the session has none.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts make large rows; keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # The JVM compiles no method of more than 8,000 bytes: a stage with a larger
    # one (the normaliser's) would be interpreted, row by row.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "scribeval", extra: dict | None = None) -> SparkSession:
    """Local/test session: UI off, small shuffle partition count, UTC."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("SCRIBEVAL_MASTER", "local[*]"))
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SCRIBEVAL_DRIVER_MEMORY", "16g"))
    )
    for k, v in {**DEFAULT_CONF, **REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required settings to an existing session and make sure a
    checkpoint directory exists (the cluster's one if it named one)."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``scribeval`` importable in the Python workers (pandas UDFs,
    stateful streaming, UDTFs) wherever the driver runs from: the package is
    zipped once per SparkContext and distributed with ``addPyFile``."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_scribeval_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="scribeval-pyfiles-"), "scribeval.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._scribeval_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the session names none (local tests) a fresh scratch folder is
    created; on a cluster the setting is expected to point at shared storage.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="scribeval-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the checkpoint folder and return a
    lazy scan of it.  Cuts the lineage like ``checkpoint()`` but computes the
    input a single time (an eager RDD checkpoint runs it twice unless
    cached), and the read-back scan keeps column pruning and filter
    pushdown."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
