"""Score a stream of JSON feature records with every detector.

All detector scoring paths are projections, MLlib transforms or
``pandas_udf``s, so the streaming query is stateless and runs in append
mode.

``ResponseSink`` answers every record: scores of the accepted ones go to one
table, rejected ones with their reason to another, and the responses are built
from both.  A micro-batch writes into folders named by its batch id and is
announced by a marker once both are complete.  A batch that is replayed after a
failure overwrites its own folders, so replaying adds nothing, and readers see
announced batches only.

Helpers here also drive a stream to completion over a folder of files
(``availableNow``), with a checkpoint location under the session's checkpoint
folder, which is how the batch = stream checks run.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txsentinel.plans.training import score_all
from txsentinel.session import checkpoint_dir, shuffle_partitions
from txsentinel.sources.json_records import parse_tx_json

#: Micro-batches a replay is cut into, whatever the number of files.
REPLAY_BATCHES = 8

SCORE_SCHEMA = "tx_id long, model string, score double, prediction int"
REJECT_SCHEMA = "tx_id long, reason string"


def score_stream(records: DataFrame, detectors: dict, value: str = "value") -> DataFrame:
    """Streaming (tx_id, value JSON) -> long score rows of every detector.

    The scores only: rejected records are answered by ``ResponseSink``."""
    parsed = parse_tx_json(records, value).where("is_valid = 1")
    return score_all(detectors, parsed)


class ResponseSink:
    """Two tables under ``base`` -- scores and rejects -- written by ``foreachBatch``."""

    def __init__(self, spark: SparkSession, base: str, detectors: dict, value: str = "value"):
        self.spark, self.base, self.detectors, self.value = spark, base.rstrip("/"), detectors, value

    def write(self, records: DataFrame, batch_id: int) -> None:
        """One micro-batch: parsed once, each sink overwritten in the batch's own folder."""
        parsed = parse_tx_json(records, self.value).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = parsed.where("is_valid = 1"), parsed.where("is_valid = 0")
            score_all(self.detectors, good).drop("label").write.mode("overwrite").parquet(
                self._folder("scores", batch_id))
            bad.select("tx_id", F.col("reject_reason").alias("reason")).write.mode("overwrite").parquet(
                self._folder("rejects", batch_id))
            self._path(f"announced/{batch_id}", create=True)
        finally:
            parsed.unpersist()

    def start(self, records: DataFrame, checkpoint: str | None = None):
        """The streaming query; it takes what is available and stops."""
        return (records.writeStream.foreachBatch(self.write)
                .option("checkpointLocation", checkpoint or f"{self.base}/checkpoint")
                .trigger(availableNow=True).start())

    def scores(self) -> DataFrame:
        return self._read("scores", SCORE_SCHEMA)

    def rejects(self) -> DataFrame:
        return self._read("rejects", REJECT_SCHEMA)

    def responses(self) -> DataFrame:
        """tx_id, status, reason and one struct (is_fraud, score) per model; every record once."""
        models = [F.first(F.when(F.col("model") == m, F.struct((F.col("prediction") == 1).alias("is_fraud"), "score")),
                          ignorenulls=True).alias(m) for m in self.detectors]
        answered = self.scores().groupBy("tx_id").agg(*models).select(
            "tx_id", F.lit("analysed").alias("status"), F.lit(None).cast("string").alias("reason"), *self.detectors)
        verdict = F.lit(None).cast("struct<is_fraud:boolean,score:double>")
        return answered.unionByName(self.rejects().select(
            "tx_id", F.lit("rejected").alias("status"), "reason", *[verdict.alias(m) for m in self.detectors]))

    def announced(self) -> list[int]:
        """Ids of the complete batches."""
        fs, path = self._path("announced")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def _folder(self, sink: str, batch_id: int) -> str:
        return f"{self.base}/{sink}/batch_id={batch_id}"

    def _path(self, name: str, create: bool = False):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if create:
            fs.create(path, True).close()
        return fs, path

    def _read(self, sink: str, schema: str) -> DataFrame:
        ids = self.announced()
        if not ids:
            return self.spark.createDataFrame([], schema)
        table = self.spark.read.schema(f"{schema}, batch_id long").parquet(f"{self.base}/{sink}")
        return table.where(F.col("batch_id").isin(ids)).drop("batch_id")


def json_record_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    schema = T.StructType([T.StructField("tx_id", T.LongType()),
                           T.StructField("value", T.StringType())])
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def files_per_trigger(spark: SparkSession, path: str, batches: int = REPLAY_BATCHES) -> int:
    """Files of a landing folder that one micro-batch takes so that ``batches`` take them all.

    A micro-batch costs its state partitions and commits whatever it holds, so their number must not
    follow the number of files."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return max(1, -(-len(files) // batches))


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stream's state: no more than run at once, as every one of them opens its store and
    its Python worker in every micro-batch."""
    return min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)


def run_to_table(stream_df: DataFrame, name: str) -> DataFrame:
    """Run a streaming query over everything available, return the sink table.

    Sink and checkpoint live under the session's checkpoint folder, so the
    query restarts exactly-once from its checkpoint after a failure.
    """
    spark = stream_df.sparkSession
    base = checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex}"
    before = shuffle_partitions(spark)
    spark.conf.set("spark.sql.shuffle.partitions", state_partitions(spark))
    try:  # a query runs in a copy of the session that is taken when it starts
        q = (stream_df.writeStream.format("parquet").outputMode("append")
             .option("path", base + "/out").option("checkpointLocation", base + "/chk")
             .trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(base + "/out")


def write_stream_input(df: DataFrame, name: str, order: str | tuple[str, ...],
                       n_files: int | None = None) -> str:
    """Write ``df`` as consecutive slices of ``order`` into one landing folder, so that a file
    stream replays them in order (oldest first).

    One write: rows are range-partitioned and sorted on ``order`` (NULL last, so no row is lost),
    and every part file, also of a partition that is cut into several, is one slice.  There are as
    many partitions as a shuffle of the session has, unless ``n_files`` says otherwise.  File names
    and times follow the slices.  Uses the Hadoop FileSystem API, so it works on any cluster file
    system; a rename that fails raises.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/") + f"/landing/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    staging = jvm.org.apache.hadoop.fs.Path(base + "/staging")
    landing = jvm.org.apache.hadoop.fs.Path(base + "/files")
    fs = landing.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(landing)
    keys = [F.col(c).asc_nulls_last() for c in ((order,) if isinstance(order, str) else order)]
    parts = n_files or shuffle_partitions(spark)
    df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.parquet(staging.toString())
    found = sorted(st.getPath().getName() for st in fs.globStatus(
        jvm.org.apache.hadoop.fs.Path(staging, "part-*")))
    # part-<partition>-<job>-c<file>: by partition, then by file inside it
    found.sort(key=lambda f: (f.split("-")[1], f.rsplit("-c", 1)[-1]))
    for i, part in enumerate(found):
        target = jvm.org.apache.hadoop.fs.Path(landing, f"slice-{i:05d}.parquet")
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging, part), target):
            raise OSError(f"cannot move {part} to {target.toString()}")
        fs.setTimes(target, 1_000_000_000_000 + 1000 * i, -1)
    return base + "/files"
