"""Helpers shared by the operators: table access and Arrow text buffers.

The reports select the columns they need from their input by name before
anything else, so extra columns never clash with theirs. Where an operator
hands input columns on beside its own, ``handed_on`` renames those whose name
it adds itself.
"""

from __future__ import annotations

import os
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tillroll.session import shared_dir

# Text handled at once inside a task: bounds the working set of the numpy
# code whatever the size of the Arrow batch Spark hands over.
SLICE_BYTES = 2 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Arrow batches between Spark and the workers, which Spark bounds by rows first:
# 10,000 rows of long texts are held several times over by either side.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Also lets Python workers of a local session import this
    package from any working directory; a cluster gets it by --py-files."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """The frame, whose texts go to the workers in batches of BATCH_BYTES unless the session has its own bound.

    The bound counts when a plan is run, which callers do after an operator
    has returned it, so it stays set in the session.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_BYTES))
    return df


def field(df: DataFrame, name: str, alias: str | None = None) -> StructField:
    """The schema field of a column, always nullable."""
    f = df.schema[name]
    return StructField(alias or name, f.dataType, True)


def schema(*fields: StructField) -> StructType:
    return StructType(list(fields))


def handed_on(columns: list[str], added: list[str]) -> list[str]:
    """The names under which input columns are handed on: ``in_<name>`` where the
    operator adds a column of that name (Spark ignores case), else unchanged."""
    own, taken = {c.lower() for c in added}, {c.lower() for c in [*columns, *added]}
    out = []
    for c in columns:
        name = c
        while name.lower() in own or (name != c and name.lower() in taken):
            name = f"in_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # of the written frames
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # names of those in buckets


def written(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the files, not a
    recomputation of everything before. Nothing reads the shuffle files of a
    finished step again, so Spark is told to remove them when the write ends;
    by itself it does so only when the driver's garbage collector meets them.

    With a ``key`` the frame is dealt out by it into buckets, as many as there
    are shuffle partitions: later joins on the key move the other side only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark, name)}/{uuid.uuid4().hex[:8]}"
    own = {CLEANUP: "true", BATCH: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in own}
    bucketed = f"{name}_{uuid.uuid4().hex}" if key else None
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        if key:
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            (df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path)
             .bucketBy(n, key).saveAsTable(bucketed))
        else:
            df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    spark.sparkContext._jvm.System.gc()  # for what other actions left
    back = spark.table(bucketed) if key else spark.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    if key:
        _TABLES[back] = bucketed
    return back


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of written frames that nothing reads any more."""
    for df in frames:
        path = _PATHS.pop(df, None) if df is not None else None
        if path:
            if named := _TABLES.pop(df, None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {named}")  # the name only
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its n + 1 offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return buf, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of text.

    A single longer text forms a slice of its own; no row is split.
    """
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cum = np.cumsum(sizes)
        start = 0
        while start < n:
            base = cum[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(cum, base + max_bytes, side="right")))
            yield b.slice(start, end - start)
            start = end


_MODELS: dict[str, Any] = {}  # of this worker process; one at most


def worker_model(key: str | None = None, load: Callable[[], Any] | None = None) -> Any:
    """The model of an operator, loaded once per worker process and let go when the next operator begins there.

    Workers serve one task after another for as long as the application lives,
    so what an operator keeps in them stands beside the needs of all later ones.
    Operators without a model call it too, to let go of what was there.
    """
    if key not in _MODELS:
        _MODELS.clear()
        if load is not None:
            _MODELS[key] = load()
    return _MODELS.get(key)


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
