"""Byte ranges of files and files in parts: read and written by tasks, on any file system that pyarrow opens.

A file is listed by Spark with its length only. Tasks read the ranges that a plan asks for. A file to be
written is a table of parts (file_name, part, content): its parts come to one task in order and are
streamed, so no file is ever held whole.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or in local mode
    where that is unset a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """Writes ``df`` under the scratch folder and rereads it. Steps that read their input more than once
    read this then, instead of computing what came before again each time; a lost executor costs no
    more than what ran last."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str) -> tuple:
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_range(path: str, start: int, size: int) -> bytes:
    """At most ``size`` bytes of a file from ``start`` on."""
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        return f.read_at(size, start)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """file_name, path and length of files; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "length")


def write_parts(parts: DataFrame, folder: str) -> DataFrame:
    """Writes files (file_name, part, content) into a folder, each through one task that streams its
    parts in order. Returns file_name and n_bytes. A file appears under its name once it is whole, so a
    task that runs again does no harm."""
    spark = parts.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        system.create_dir(inner, recursive=True)
        name = out = temp = None
        size, done = 0, []

        def close() -> None:
            out.close()
            system.move(temp, f"{inner}/{name}")
            done.append((name, size))

        for batch in batches:
            for file_name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file_name != name:
                    if out is not None:
                        close()
                    name, size, temp = file_name, 0, f"{inner}/.{file_name}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(temp)
                data = content.as_buffer() if content.is_valid else b""
                out.write(data)
                size += len(data)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file_name", "n_bytes"])

    ordered = parts.repartition("file_name").sortWithinPartitions("file_name", "part").select("file_name", "content")
    rows = ordered.mapInArrow(run, "file_name string, n_bytes long").collect()  # a row a file
    return spark.createDataFrame([tuple(r) for r in rows], "file_name string, n_bytes long")
