"""Small helpers the operators of this package share."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_ready, keep

__all__ = ["ROWS_PER_BATCH", "files_for", "fold", "free_name", "keep", "prepared", "read", "run_groups", "text_batches"]

#: Rows of an Arrow batch: texts may be long, and a batch is what a Python worker holds at once.
ROWS_PER_BATCH = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """Settings the Python steps rely on: batches small enough for whole texts."""
    checkpoint_ready(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """``name``, longer by underscores until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def run_groups(rows: int, size: int) -> int:
    """How many groups of about ``size`` rows to form."""
    return max(1, math.ceil(rows / size))


def files_for(rows: DataFrame, each: int) -> int:
    """To how many partitions to coalesce a table with as many rows as ``rows``, a kept table, or fewer, before it is
    written: one for ``each`` rows, at least two for each core. However many partitions a shuffle has, a small table is
    then a few files: for each new one Hadoop without its native library starts a process to set permissions, and each
    is opened anew by all who read the table."""
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, run_groups(rows.count(), each))


def text_batches(batches, text: str = "text"):
    """Each Arrow batch with its texts as UTF-8 bytes (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        yield batch, [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def crc_of(doc_id: Column) -> Column:
    """crc32 of an id written as text (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fold(n: int, rest: int) -> Column:
    """Whether a document belongs to one fold of ``n``."""
    return F.pmod(crc_of(F.col("doc_id")), F.lit(n)) == rest
