"""Shared pieces: scratch tables in the cluster's shared folder, text batches, safe column names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only separators of words in the text contracts.
WS = r"[\x20\x09-\x0D]+"
#: Characters handed to a Python kernel at once; a longer text goes alone.
BATCH_CHARS = 4_000_000
#: Bytes of rows that Spark hands to Python at once, at most (one longer row goes alone).
BATCH_BYTES = 8 << 20

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder for this application's scratch tables, below ``spark.checkpoint.dir``.

    Where that setting is absent, a local master (a test, say) gets a temporary folder; on a
    cluster executors would not share one, so that is an error. The folder goes when the JVM
    ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
            base = "file://" + tempfile.mkdtemp(prefix="pagemark-")
        root = f"{base.rstrip('/')}/scratch-{app}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[app] = root
    return _roots[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than its own running tasks. The
    schema is given on reading, so an empty table keeps its columns.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/scratch-" in parent and parent.rsplit("/", 2)[-2] == root.rsplit("/", 1)[-1]:
                path = jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(conf).delete(path, True)


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named c0, c1, ... by place, and the new name of each old one.

    Spark matches names without regard to case, so a table with ``text`` and ``TEXT`` cannot be
    read by name. Here names are matched exactly, the first of equal ones counts, and columns
    that an operator adds under other names can clash with none of the table's.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(reversed(df.columns), reversed(names)))


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; an absent column counts as null. Other columns do no harm."""
    placed, at = by_place(df)
    return placed.select(*[(F.col(at[c]) if c in at else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """One thing a Python worker keeps between tasks; asking for another lets go of it.

    Workers serve many steps, so what each keeps would otherwise add up.
    """
    if key not in _held:
        if _held:
            _held.clear()
            _give_back()
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` characters each."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 16
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ``BATCH_BYTES``.

    Spark's own 64 MB is held several times over by each task, in the JVM and in Python. A
    lower setting stays as it is. The setting is read when a plan runs, so it stays lowered for
    the rest of the session.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_texts(df: DataFrame, kernel: Callable[[list[str]], dict], fields: T.StructType, column: str = "text", keep: bool = False) -> DataFrame:
    """Add to each row what ``kernel`` makes of its text; null counts as the empty text.

    ``kernel`` gets a list of texts and returns a dict of equally long columns. The column
    ``column`` is dropped unless ``keep``.
    """
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if keep or c != column]
    schema = T.StructType([*[df.schema[c] for c in rest], *fields])
    kinds = {f.name: _arrow(f.dataType) for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(column))
            at = 0
            while at < len(col):
                n = min(512, len(col) - at)
                texts = [x or "" for x in col.slice(at, n).to_pylist()]
                for a, b in chunks(texts):
                    out = kernel(texts[a:b])
                    part = batch.slice(at + a, b - a)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(part.schema.get_field_index(c)) for c in rest] + [pa.array(out[k], type=t) for k, t in kinds.items()],
                        names=[*rest, *kinds],
                    )
                at += n

    return df.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in t])
    return {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "integer": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}[t.typeName()]


def fields(**types: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v) if " " in v or "<" in v else _plain(v), True) for k, v in types.items()])


def _plain(name: str) -> T.DataType:
    return {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType()), "strings": T.ArrayType(T.StringType())}[name]
