"""What the operators share: the shared folder, cut lineage, bounded chunks of documents."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: space and 0x09 to 0x0D.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python worker turns into arrays at once.
CHUNK = 8 << 20
LOWEST = -(1 << 63)


#: Rows of text in an Arrow batch, where the session leaves Spark's default of 10,000.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts must stay small: JVM and Python each hold some of them at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The temporary folders of local sessions, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see; only local sessions without the setting get a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = _local_folders.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="wardlight-")
        _local_folders[spark.sparkContext.applicationId] = top
    return f"{top.rstrip('/')}/wardlight-{uuid.uuid4().hex}"


#: Whether Spark deletes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """df as parquet in folders of `by`; its shuffle files go at once.

    The driver's garbage collection alone would leave those of the last write until the one after it.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def delete_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of one operator's steps, in a folder of the shared folder that goes when its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, shared_folder(spark), 0

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.count += 1
        write_table(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """df as a table that outlives the steps."""
        out = materialize(df)
        release_shuffles(self.spark)
        delete_table(self.spark, self.folder)
        return out


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more.

    Spark does so when the JVM driver collects garbage, which may be hours away; until then each
    step of an operator would keep its shuffle on disk. There is no public call for this.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of text for which there is a hash bucket.
BUCKET_BYTES = 8 << 20


def n_buckets_bits(texts: DataFrame, each: int = BUCKET_BYTES) -> int:
    """log2 of the number of hash buckets: one for each so many bytes of text, whatever the session's settings, so that a bucket stays bounded."""
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(3, (-(-total // each) - 1).bit_length())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th tells rows apart that repeat a doc_id with another text; a null doc_id is the lowest."""
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))


def text_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def chunks(batches, limit: int = CHUNK):
    """Lists of rows (tuples in column order; `text` as bytes) of at most `limit` bytes of text, or one row."""
    rows, size = [], 0
    for batch in batches:
        columns = [text_bytes(c) if n == "text" else c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)]
        at = batch.schema.names.index("text")
        for row in zip(*columns):
            if rows and size + len(row[at] or b"") > limit:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += len(row[at] or b"")
    if rows:
        yield rows


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def merge_intervals(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the half-open intervals cover; touching intervals join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return starts[new], ends[np.concatenate((new[1:] - 1, [len(ends) - 1]))]
