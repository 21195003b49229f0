"""Shared plumbing of the training-data operators.

Rules that every operator here follows:

* A document is one input row.  ``key`` columns name it: the id and a 64-bit
  hash of its text, so repeated ids with different texts stay apart.
* A null text has no words, bytes or characters.  A null id is kept, and counts
  as larger than every other id wherever ids are compared.
* Only the named columns are read, so further columns, whatever their names,
  have no effect.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes that travel to a Python worker at once; keeps a worker's memory small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Stands for a null id where ids are compared.
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """From now on batches for Python workers are bounded in rows and in bytes, so that a
    thousand very long texts are many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): all that most operators read of a table."""
    spark = docs.sparkSession
    bounded(spark)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch that yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], Iterable[bool]]) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which ``keep`` is true."""
    bounded(df.sparkSession)
    return map_batches(df, lambda batch: [batch.filter(pa.array([bool(k) for k in keep(batch)], pa.bool_()))], df.schema)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: Bytes of input for each slot, and the largest number of slots.
SLOT_BYTES, MOST_SLOTS = 8 << 20, 1 << 17


def slots(df: DataFrame) -> int:
    """Slots that packed arrays are dealt to: one for every ``SLOT_BYTES`` of input, so that
    what a task loads stays the same however large the input is, and some more than shuffle
    partitions, so that those of small clusters stay small.  The size is Spark's estimate
    of the tables that ``df`` is made of; one without an estimate counts as empty."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 60)
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 128
    return max(least, min(MOST_SLOTS, size // SLOT_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    On one machine, as in tests, a temporary folder takes its place where that setting is missing; a cluster needs it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/matchloom/{uuid.uuid4().hex}"


def give_back(spark: SparkSession) -> None:
    """The driver's free memory goes back to the system: what its JVM keeps outside the heap,
    as every thread pool and compiler leaves some in each of dozens of arenas, and what its
    Python keeps.  Nothing happens where a JVM (before 17.0.9) or a C library has no such call."""
    jvm = spark._jvm
    try:
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts lineage, and is
    computed once however often it is read.  It goes when the driver ends."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_col, n: int):
    """crc32 of an id's decimal text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % n
