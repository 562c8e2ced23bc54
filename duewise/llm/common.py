"""Input tables, staged results in the shared folder, and Arrow helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.session import ensure_checkpoint_dir

#: Removes the shuffle files of a finished execution; a staged table never reads them again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Intermediate tables of one operator run, as Parquet under ``spark.checkpoint.dir``.

    A staged table cuts lineage on storage that outlives executors, and its shuffle files are freed at once.
    ``drop`` deletes a table that later steps no longer read; what is left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def stage(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.option("compression", compression).parquet(self.path(name))
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names or ("",):
            path = hadoop(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | dict], schema: str | T.StructType
) -> DataFrame:
    """Apply ``function`` to each Arrow batch; it returns the columns of the output by name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


_OWN: dict[str, tuple] = {}


def per_worker(kind: str, key, make: Callable[[], object]):
    """What ``make`` gives, kept by the Python worker over its tasks; one value of each kind."""
    if kind not in _OWN or _OWN[kind][0] != key:
        _OWN[kind] = (key, make())
    return _OWN[kind][1]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def list_array(values: pa.Array, lengths) -> pa.Array:
    """An Arrow list column from flat values and the length of each row's list."""
    import numpy as np

    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def fingerprint(column) -> list:
    """Two 64-bit hashes of a column, by independent functions: a 128-bit key for equality of long values."""
    return [F.xxhash64(column), F.xxhash64(F.lit(17), F.reverse(column))]


def schema_with(df: DataFrame, **added: T.DataType) -> T.StructType:
    """The schema of ``df`` and further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added.items())])
