"""What the operators of this subpackage share: written tables, row ids, set-up of tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A column name that no input is expected to have; operators put their own columns under it.
OWN = "__loom_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark is
    local (tests). A cluster without the setting raises: its executors would each write to a disk of their own."""
    own = f"{OWN}shared_dir"
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, own, None)
        if not folder:
            local = tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            folder = f"file://{local}"
            setattr(spark.sparkContext, own, folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/corpusloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def with_row_ids(df: DataFrame, name: str = f"{OWN}row") -> DataFrame:
    """Each row gets a number of its own; rows that are equal in every column still differ here.

    For tables read from Parquet it follows from the file's name and the row's place in it, so it is the same in each plan
    that reads the table, however many executors there are and however files are split. Numbers of two files overlap with a
    chance of about 2 * rows / 2^62. Other tables are numbered by partition and written, so that all plans see one numbering.
    """
    place = F.shiftrightunsigned(F.xxhash64("_metadata.file_path"), 2) + F.col("_metadata.row_index")
    try:
        found = df.withColumn(name, place)
        found.schema  # noqa: B018  resolves the hidden columns
        return found
    except AnalysisException:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


#: Row numbers that a join may broadcast; 8 bytes each, and their hash table.
BROADCAST_ROWS = 1 << 21


def few(numbers: DataFrame) -> DataFrame:
    """`numbers`, a written table of a few numbers a row, with a broadcast hint if it has few rows; else Spark may shuffle."""
    return F.broadcast(numbers) if numbers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else numbers


def without(rows: DataFrame, numbers: DataFrame, row: str = f"{OWN}row") -> DataFrame:
    """The rows whose number isn't in the written, one-column table `numbers`; texts are shuffled only beyond BROADCAST_ROWS."""
    return rows.join(few(numbers.toDF(row)), row, "left_anti")


#: Rows of a batch that goes to a Python worker, where rows hold whole texts.
BATCH_ROWS = 2_048


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers of at most BATCH_ROWS rows, from here on in this session; a smaller setting stays. JVM and
    worker each hold a batch on its way in and on its way out. Results don't depend on it."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo `folds`; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id) == 0
