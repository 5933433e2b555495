"""Shared helpers: scratch tables in the cluster's shared folder and stable row identifiers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is unset and all tasks run in this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="wirelake-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/wirelake/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system; a session that has ended is left alone."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the queries run inside go as soon as each query has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            discard(df.sparkSession, path)


def tidy() -> None:
    """Give memory that a worker no longer uses back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


BROADCAST_IDS = 1_000_000


def small_side(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written narrow table, marked for broadcast only while it has at most ``most`` rows.

    Rows of a few numbers are meant: the limit is some tens of MB. Beyond it the join is shuffled.
    """
    return F.broadcast(df) if df.count() <= most else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


TEXTS_AT_ONCE = 512
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of at most BATCH_ROWS rows, unless the session names a size of its own."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def map_texts(rows: DataFrame, made: Callable[[list[str | None]], dict[str, pa.Array | list]], text_col: str = "text", done: Callable[[], None] | None = None, **columns: str) -> DataFrame:
    """rows with the column of texts replaced by the columns that made gives for a list of texts.

    All other columns pass through as Arrow arrays, so 64-bit numbers stay exact beside nulls. ``done``
    is called when a partition ends.
    """
    small_batches(rows.sparkSession)
    schema = extended(rows.drop(text_col).schema, **columns)
    types = {k: _ARROW[v] for k, v in columns.items()}
    keep = [c for c in rows.columns if c != text_col]

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                part = whole.slice(at, TEXTS_AT_ONCE)
                got = made(part.column(text_col).to_pylist())
                own = [v if isinstance(v, pa.Array) else pa.array(v, type=types[k]) for k, v in ((k, got[k]) for k in types)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *own], names=[*keep, *types])
        if done is not None:
            done()
        tidy()

    return rows.select(*keep, text_col).mapInArrow(apply, schema)


def where_texts(rows: DataFrame, stay: Callable[[list[str | None]], list[bool]], text_col: str = "text", done: Callable[[], None] | None = None) -> DataFrame:
    """The rows whose text stay() takes, with all their columns as they are."""
    small_batches(rows.sparkSession)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                part = whole.slice(at, TEXTS_AT_ONCE)
                yield part.filter(pa.array(stay(part.column(text_col).to_pylist()), type=pa.bool_()))
        if done is not None:
            done()
        tidy()

    return rows.mapInArrow(apply, rows.schema)


def with_row_uid(docs: DataFrame, name: str = "_uid", locator: str | None = None) -> DataFrame:
    """Add a 64-bit row identifier that a recomputation gives again, and on request the row's locator as text.

    It hashes the file and the row's place in it. Rows that don't come straight from files are
    written to the shared folder first.
    """

    def added(df: DataFrame) -> DataFrame:
        at = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
        return df.withColumns({name: F.xxhash64(*at)} | ({locator: F.concat_ws("#", *at)} if locator else {}))

    try:
        return added(docs)
    except AnalysisException:
        return added(materialize(docs, "rows"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A copy of schema with more columns; StructType.add would change a DataFrame's own schema."""
    more = [T.StructField(k, _TYPES[v]) for k, v in columns.items()]
    return T.StructType([*schema.fields, *more])


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "longs": T.ArrayType(T.LongType())}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "longs": pa.list_(pa.int64())}
