"""What several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For bytes.translate: A-Z to a-z and nothing else.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, survives a lost executor, and is read column by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote; no result that is still to be computed may read it."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(conf).delete(path, True)


def in_fold(doc_id: Column, fold: int, folds: int = 5) -> Column:
    """True where crc32 of doc_id as text leaves the remainder `fold`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def whole_text(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """All columns of docs in one struct, `row`: whatever they are called, no name of an operator's own meets them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def portions(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of a column of texts, so that what a task holds doesn't follow the longest rows of a batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = (np.cumsum(sizes) - sizes) // most
    bounds = [*np.flatnonzero(np.diff(groups, prepend=-1)).tolist(), batch.num_rows]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield batch.slice(a, b - a)


def distinct(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value stands first, and of all values the place in that list."""
    codes = values.dictionary_encode().indices.to_numpy()
    return np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1)), codes
