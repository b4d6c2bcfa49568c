"""Segment files: a clear header of 21 bytes, then an encrypted payload that the header authenticates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from daybook.sources import segment_files
from daybook.sources.segment_files import HEADER, MAGIC, VERSION
from daybook.sources.shared import cut


def _int(data: Column, at: int, size: int) -> Column:
    """Big-endian unsigned bytes."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def header_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """df with start_ms, sample_rate, num_samples, duration_ms, end_ms and status of the clear header: ok, short, bad_magic or bad_version."""
    c = F.col(content)
    status = F.when(F.octet_length(c) < HEADER, "short").when(F.substring(c, 1, 4) != F.lit(bytearray(MAGIC)), "bad_magic").when(_int(c, 4, 1) != VERSION, "bad_version").otherwise("ok")
    ok = F.col("status") == "ok"
    df = df.withColumn("status", status)
    df = df.withColumn("sample_rate", F.when(ok, _int(c, 5, 4)).cast("int")).withColumn("start_ms", F.when(ok, _int(c, 9, 8))).withColumn("num_samples", F.when(ok, _int(c, 17, 4)).cast("int"))
    duration = F.when(F.col("sample_rate") > 0, F.floor(F.col("num_samples").cast("long") * 1000 / F.col("sample_rate")))
    return df.withColumn("duration_ms", duration.cast("long")).withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))


def scan_segments(spark: SparkSession, path: str, leftovers: bool = False, share: int = segment_files.SHARE) -> DataFrame:
    """(path, size, start_ms, sample_rate, num_samples, duration_ms, end_ms, status) of *.bseg files below path, in no order.

    Of each file the header is read and nothing else; open_segments fetches payloads by path. Leftovers of writes (.tmp) are listed only if
    asked for, with that status. Whoever wants the oldest first sorts the rows, which are a few numbers each.
    """
    spark.dataSource.register(segment_files.SegmentSource)
    rows = spark.read.format("segments").option("share", share).load(path).drop("modified_ms")
    return rows if leftovers else rows.filter("status <> 'leftover'")


def sweep_segments(spark: SparkSession, path: str, before_ms: int | None = None) -> DataFrame:
    """Removes leftovers of writes and files whose header can't be read, of those last changed before `before_ms` if that is given; (path, status) of what went."""
    spark.dataSource.register(segment_files.SegmentSource)
    bad = spark.read.format("segments").load(path).filter("status <> 'ok'")
    if before_ms is not None:
        bad = bad.filter(F.col("modified_ms") < before_ms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, file = segment_files.file_of(name)
                if store.get_file_info(file).type == fs.FileType.File:  # a task that is run again finds it gone
                    store.delete_file(file)
            yield batch

    return cut(bad.select("path", "status").mapInArrow(run, "path string, status string"))


def write_segments(files: DataFrame, folder: str) -> None:
    """Writes files (name, blob) below the folder, which all executors reach: all of them are there in the end, or none."""
    files.sparkSession.dataSource.register(segment_files.SegmentSource)
    files.select("name", "blob").write.format("segments").mode("append").save(folder)


def with_payload(segments: DataFrame, content: str = "content", portion: int = 16 << 20) -> DataFrame:
    """segments (path, ..) with the bytes of their files, null where there is none any more; a task holds about `portion` bytes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [], 0
            for k, name in enumerate(batch.column("path").to_pylist()):
                store, file = segment_files.file_of(name)
                try:
                    with store.open_input_file(file) as opened:
                        held.append(opened.read())
                except FileNotFoundError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= portion or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(held)).columns, pa.array(held, pa.binary())], [*batch.schema.names, content])
                    at, held, size = k + 1, [], 0

    return segments.mapInArrow(run, StructType([*segments.schema.fields, StructField(content, BinaryType())]))


def open_segments(segments: DataFrame, key: bytes, content: str = "content") -> DataFrame:
    """segments with pcm_bytes; null where the payload was tampered with, belongs to another key or has the wrong number of samples.

    Without a column of contents, those of readable files are fetched by path; the others stay, with null.
    """
    if content not in segments.columns:
        readable = with_payload(segments.filter("status = 'ok'"), content)
        return open_segments(readable, key, content).drop(content).unionByName(segments.filter("status <> 'ok'").withColumn("pcm_bytes", F.lit(None).cast("binary")))
    c = F.col(content)
    iv_len = _int(c, HEADER, 1).cast("int")
    sealed = F.substring(c, F.lit(HEADER + 2), F.octet_length(c))
    plain = F.try_aes_decrypt(sealed, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.substring(c, 1, HEADER))
    right = (F.col("status") == "ok") & (iv_len == 12)
    return segments.withColumn("pcm_bytes", F.when(right, plain)).withColumn("pcm_bytes", F.when(F.octet_length("pcm_bytes") == F.col("num_samples") * 2, F.col("pcm_bytes")))


def _bytes(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def seal_segments(df: DataFrame, key: bytes) -> DataFrame:
    """df (start_ms, sample_rate, num_samples, pcm_bytes) with blob, the file's bytes. The IV is random, so blobs differ each time."""
    header = F.concat(F.lit(bytearray(MAGIC + bytes([VERSION]))), _bytes(F.col("sample_rate").cast("long"), 4), _bytes(F.col("start_ms").cast("long"), 8), _bytes(F.col("num_samples").cast("long"), 4))
    # without an IV given, Spark draws one and puts it in front
    sealed = F.aes_encrypt("pcm_bytes", F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), header)
    return df.withColumn("blob", F.concat(header, F.lit(bytearray([12])), sealed))


def pcm_to_samples(data: Column | str) -> Column:
    """16-bit little-endian bytes to samples."""

    def samples(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 2 * 2], "<i2"))

    return F.pandas_udf(samples, "array<smallint>")(data)


def samples_to_pcm(samples: Column | str) -> Column:
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else np.asarray(s, "<i2").tobytes())

    return F.pandas_udf(packed, "binary")(samples)


def as_floats(samples: Column) -> Column:
    return F.transform(samples, lambda s: (s / 32768).cast("float"))
