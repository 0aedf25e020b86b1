"""What several operators share: the shared folder, slices of Arrow batches, and safe column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakValueDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z for `translate`, which leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SENT, SENT_MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
HASHED, ADVISORY = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_written: list[tuple[SparkSession, str]] = []
_tables: WeakValueDictionary[str, DataFrame] = WeakValueDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    It is set here only where it is unset and the master runs in this one process (tests); on a cluster an
    unset folder is an error, because a machine's own temporary folder is invisible to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
            folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def write_shared(df: DataFrame, name: str, by: str | None = None, hashed: bool = False) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: a cut of the lineage that survives lost executors.
    With `by`, a column of few values, each value has a folder of its own and is read without the others. With `hashed`,
    joins hash a side none of whose shuffled partitions is larger than Spark's advisory size, as measured, instead of sorting both,
    and a side is broadcast if it is small as measured, never by an estimate: that takes compressed files for their rows.

    The folder is removed by :func:`drop_shared` or :func:`clean_shared`, at the latest when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean_shared)
    _written.append((spark, path))
    # the shuffle files of the job go when it ends; without this they stay until the driver collects its garbage
    wanted = {CLEAN_UP: "true"}
    if hashed:
        wanted |= {HASHED: spark.conf.get(ADVISORY), SENT_MEASURED: spark.conf.get(SENT_MEASURED, None) or spark.conf.get(SENT), SENT: "-1"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    _tables[path] = table = spark.read.schema(df.schema).parquet(path)
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_shared(table: DataFrame) -> None:
    """Delete a table that :func:`write_shared` has returned; nothing may read it afterwards."""
    for spark, path in [x for x in _written if _tables.get(x[1]) is table]:
        _written.remove((spark, path))
        _tables.pop(path)
        _delete(spark, path)


def clean_shared() -> None:
    """Delete every table that :func:`write_shared` has written; results that still read them must be done."""
    while _written:
        spark, path = _written.pop()
        _tables.pop(path, None)
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is the cluster's to clean then
            return


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less the columns that an operator is about to add: on a clash of names the operator's column wins."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def listed(column: pa.Array) -> list:
    """The texts or bytes of a column, null as None: as `to_pylist`, but without an object of Arrow's for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def listed_runs(column: pa.ListArray, values: list) -> list[list]:
    """The `values` of a column of lists, one for each of its flattened ones, by row; a null row has none."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `most` bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", most: int = 4 << 20) -> DataFrame:
    """`each` over slices of about `most` bytes of every partition, as one Arrow-to-Arrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                yield each(part)

    return df.mapInArrow(run, schema)
