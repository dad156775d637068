"""Score table sinks and sources.

A score store is a folder with data folders, one per write, and a manifest that
says which of them holds each model.  A write fills a new data folder aside and
then moves a new manifest into place, so readers see the table before the write
or after it, never a part; a write that dies leaves the old table as it was.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MANIFEST = "manifest.json"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """model -> data folder (empty for a store that does not exist)."""
    _, fs, target = _file_system(spark, f"{path}/{MANIFEST}")
    if not fs.exists(target):
        return {}
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _announce(spark: SparkSession, path: str, manifest: dict[str, str]) -> None:
    """Move a new manifest over the old one in one step."""
    jvm, fs, target = _file_system(spark, f"{path}/{MANIFEST}")
    aside = jvm.org.apache.hadoop.fs.Path(path, f"_{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) \
        .rename(fs.makeQualified(aside), fs.makeQualified(target), options)


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The long score table, one directory per model.

    mode='overwrite': the store holds these models only.  mode='update': models of ``scores`` take
    the place of their earlier scores, others stay.  Data folders that no manifest names any more
    are left for readers that still use them (``drop_unused`` removes them)."""
    if mode not in ("overwrite", "update"):
        raise ValueError(f"mode {mode!r}: overwrite or update")
    spark, path = scores.sparkSession, path.rstrip("/")
    folder = f"data-{uuid.uuid4().hex}"
    scores.write.partitionBy("model").parquet(f"{path}/{folder}")
    _, fs, target = _file_system(spark, f"{path}/{folder}")
    found = [f.getPath().getName() for f in fs.listStatus(target) if f.isDirectory()]
    models = {unquote(name.split("=", 1)[1]): folder for name in found if name.startswith("model=")}
    _announce(spark, path, {**(_manifest(spark, path) if mode == "update" else {}), **models})


def read_scores(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """Read back; only the directories of the wanted models are read."""
    path = path.rstrip("/")
    manifest = _manifest(spark, path)
    if not manifest:
        raise FileNotFoundError(f"no score table under {path}")
    wanted = {m: f for m, f in manifest.items() if models is None or m in models}
    out = None
    for folder in sorted(set(wanted.values()) or set(list(manifest.values())[:1])):
        mine = sorted(m for m, f in wanted.items() if f == folder)
        part = spark.read.parquet(f"{path}/{folder}").where(F.col("model").isin(mine) if mine else F.lit(False))
        out = part if out is None else out.unionByName(part)
    return out


def drop_unused(spark: SparkSession, path: str) -> list[str]:
    """Remove data folders that the manifest does not name; returns their names."""
    path = path.rstrip("/")
    used = set(_manifest(spark, path).values())
    jvm, fs, target = _file_system(spark, path)
    gone = [f.getPath().getName() for f in fs.listStatus(target)
            if f.getPath().getName().startswith("data-") and f.getPath().getName() not in used]
    for name in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path, name), True)
    return sorted(gone)


def align_scores(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach labels to per-model outputs by key (not by position).

    ``predictions`` (tx_id, model, score, prediction); ``labels`` (tx_id, label).
    """
    return predictions.join(labels, "tx_id", "inner").select(
        "tx_id", "model", "label", "score", "prediction")
