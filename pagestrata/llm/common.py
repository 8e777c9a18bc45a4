"""What the operators of this subpackage share: reading tables, picking columns, the shared folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the table documents, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch that goes to Python. Spark's 10,000 are too many where a row is a whole document.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch, so that Python workers hold a few megabytes of text at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def pick(df: DataFrame, *names: str, **fresh: str) -> DataFrame:
    """The named columns only, by exact spelling, whatever other columns there are.

    Columns that differ from a wanted one only in case, or that carry the same name twice, don't
    make the reference ambiguous: the first exact match counts. ``fresh`` renames (new=old). Every
    operator starts here, so batches for Python are made small here too.
    """
    small_batches(df.sparkSession)
    have = df.columns
    plain = df.toDF(*(f"c{i}_" for i in range(len(have))))
    wanted = [(n, n) for n in names] + list(fresh.items())
    return plain.select(*(F.col(f"c{have.index(old)}_").alias(new) for new, old in wanted))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where master and executors are one process, as in tests, a folder of our own does where it is unset.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: intermediate results need a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="pagestrata-")
        atexit.register(shutil.rmtree, known.removeprefix("file://"), ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and the files outlive executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that nothing needs any longer; it learns of them only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Intermediate results of one operator that it reads several times and needs no longer when it returns.

    They lie on the executors' disks, not in the shared folder; what is lost with an executor is computed again from its lineage.
    A result that outlives the operator, or that is made from one that is kept, is written with saved instead: plans
    that hold each other's plans grow without bound.
    """

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for df in self.held:
            df.unpersist()

    def __call__(self, df: DataFrame, now: bool = False) -> DataFrame:
        """df, kept from its first use on, or from now on."""
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        if now:
            self.held[-1].count()
        return self.held[-1]


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one by one, null as empty."""
    for x in column:
        yield x.as_py() or ""


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, for what is much larger after it than before."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def light(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; they are counted, so df is best one that is kept or written."""
    return F.broadcast(df) if df.count() <= rows else df
