"""Session construction and lineage cutting.

Lineage is cut by writing a parquet table under the cluster's checkpoint
folder (``spark.checkpoint.dir``).  When the session has no such folder
configured (unit tests, local runs) ``<warehouse>/_txsentinel_checkpoints``
is used, which every executor can reach wherever the warehouse can.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def get_session(master: str | None = None, app: str = "txsentinel",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    prepare(spark)
    return spark


#: Bytes of one Arrow batch handed to Python; Spark's own default (64 MB) holds that much, several
#: times over, in every worker.
ARROW_BATCH = "4m"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a generated method above which Spark evaluates a stage operator by operator, in small
#: methods.  HotSpot does not compile methods of more than 8,000 bytes; Spark's own default (65,535)
#: lets them run in the interpreter.
METHOD_BYTES = "8000"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder, package shipped to the Python workers, Arrow batches of bounded bytes and
    generated methods that are compiled, unless the session sets its own (idempotent)."""
    checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_ARROW_BYTES) == "67108864b":
        spark.conf.set(_ARROW_BYTES, ARROW_BATCH)
    if spark.conf.get(_METHOD_LIMIT) == "65535":
        spark.conf.set(_METHOD_LIMIT, METHOD_BYTES)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``txsentinel`` importable in executors' Python workers (UDFs,
    applyInPandas, mapInPandas) by shipping it as a zip with addPyFile."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(write_shared_file(spark, "txsentinel.zip", buf.getvalue()))
    _SHIPPED.add(key)


def write_shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write ``data`` as one file in a fresh folder under the shared checkpoint
    folder (through the Hadoop FileSystem) and return its URI."""
    sc = spark.sparkContext
    target = checkpoint_dir(spark).rstrip("/") + f"/files/{uuid.uuid4().hex}/{name}"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    return target


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - conf may be absent
            configured = None
    if not configured:
        wh = spark.conf.get("spark.sql.warehouse.dir")
        configured = wh.rstrip("/") + "/_txsentinel_checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Used where later steps must see one fixed evaluation of ``df`` (range
    partition ids, sampled boundaries) even if executors are lost and tasks
    are recomputed.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
