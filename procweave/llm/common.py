"""Shared helpers: table reads, shared-folder tables, Arrow batch iteration."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir``, else (local tests) a temp folder set once."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Applications whose staged tables are deleted when the driver ends.
_STAGING: set[str] = set()


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back (survives lost executors).

    The tables of an application are in a folder of its own, deleted when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"
    if folder not in _STAGING:
        _STAGING.add(folder)
        atexit.register(_delete, spark, folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session has not been stopped
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def delete_staged(df: DataFrame) -> None:
    """Delete the files of a :func:`stage` table that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/llm-" in folder:
            _delete(df.sparkSession, folder)


def free_name(df: DataFrame, base: str = "_llm_mark") -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for a broadcast join if a count proves it to have at most ``rows`` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def packed(df: DataFrame, text: str = "text", level: int = 1) -> DataFrame:
    """``df`` with its (never null) text column as zstd bytes, for joins that move texts: about two thirds of
    the bytes that a shuffle's own compression leaves."""
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level).compress
        for batch in chunks(batches, text, 4 << 20):
            body = pa.array([pack(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([body if i == at else c for i, c in enumerate(batch.columns)], names=names)

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, kinds)


def unpack(values: list[bytes]) -> list[bytes]:
    """Texts (UTF-8) of :func:`packed` bytes."""
    import zstandard

    read = zstandard.ZstdDecompressor().decompress
    return [read(v) for v in values]


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Re-slice Arrow batches so that the text column of each slice holds about ``max_bytes`` (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n, start = batch.num_rows, 0
        if col.nbytes <= max_bytes:
            if n:
                yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        used = 0
        for i in range(n):
            if i > start and used + sizes[i] > max_bytes:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += int(sizes[i])
        if start < n:
            yield batch.slice(start, n - start)
