"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import glob
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch that a Python stage hands back; keeps a worker's memory flat.
OUT_ROWS = 1024

#: Words are maximal runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for what jobs hand on: spark.checkpoint.dir, or the checkpoint folder that the caller has set.

    Only where Spark is one process and neither is set, a folder of this machine takes its place; on a cluster that fails.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def one_thread():
    """Products of matrices inside take one thread: small ones are no faster with more, which only wait for each other. Where numpy has another BLAS than its own OpenBLAS, nothing changes."""
    found = glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*"))
    library = ctypes.CDLL(found[0]) if found else None
    name = next((n for n in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "openblas_{}_num_threads") if hasattr(library, n.format("set"))), None)
    before = getattr(library, name.format("get"))() if name else None
    try:
        if name:
            getattr(library, name.format("set"))(1)
        yield
    finally:
        if name:
            getattr(library, name.format("set"))(before)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside takes its shuffle files along when it is done; nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared checkpoint folder and reads it again; lineage ends there."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared checkpoint folder that are deleted at the end of a block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


class Bounded(dict):
    """A worker's cache that starts afresh when its keys and values come to ``limit`` bytes; long keys aren't kept."""

    def __init__(self, limit: int = 64 << 20, longest: int = 256):
        super().__init__()
        self.limit = self.room = limit
        self.longest = longest

    def keep(self, key: str | bytes, value: object, size: int = 0) -> None:
        """``size``: the bytes of the value beyond those of a number."""
        n = len(key)
        if n > self.longest:
            return
        self.room -= 4 * n + size + 160  # a character takes four bytes at most
        if self.room < 0:
            self.clear()
            self.room = self.limit
        self[key] = value


_held: dict[Hashable, object] = {}


def worker_state(name: Hashable, make: Callable[[], object]) -> object:
    """State that a Python worker keeps over the tasks of one operator; that of the operator before is let go first.

    Workers outlive stages, so the states of all operators of a pipeline would else add up in them.
    """
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def give_back() -> None:
    """Hands memory that Python has freed back to the system, where the C library can do so."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_batches(df: DataFrame, make: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow whose state is made once for each task: make() returns batch -> iterable of column dicts."""
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                for columns in step(batch):
                    yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    return df.mapInArrow(run, struct)


def arrow_schema(struct: T.StructType) -> pa.Schema:
    simple = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BooleanType: pa.bool_()}

    def of(kind: T.DataType) -> pa.DataType:
        return pa.list_(of(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[type(kind)]

    return pa.schema([(f.name, of(f.dataType)) for f in struct.fields])


def slices(batch: pa.RecordBatch, rows: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
